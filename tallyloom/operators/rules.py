"""A four-valued rule engine over measured facts: pass, fail, unknown, skipped.

A rule's result is a struct (status, reason, measured).  Which failures block is decided in
one place, and the verdict of a subject follows from its results alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.scalars import haversine_m, orientation, visit_window

#: Fixed values.
BLOCKING = ("orientation", "min_duration", "min_resolution")
STATUSES = ("pass", "fail", "unknown", "skipped")
DECODER_SLACK_S, CLOCK_SLACK_MS = 0.05, 60_000
#: Sources of a capture time, the best last.
CAPTURE_SOURCES = ("mvhd", "udta_day", "apple_quicktime")


def _result(status: Column, reason: Column, measured: Column) -> Column:
    return F.struct(status.alias("status"), reason.cast("string").alias("reason"), measured.cast("string").alias("measured"))


def _judged(value: Column, ok: Column, failed: str, absent: str) -> Column:
    """Unknown without a value, else pass or fail."""
    status = F.when(value.isNull(), "unknown").when(ok, "pass").otherwise("fail")
    reason = F.when(value.isNull(), absent).when(~ok, failed)
    return _result(status, reason, value)


def orientation_rule(width: Column, height: Column, wanted: Column | str) -> Column:
    wanted = F.lit(wanted) if isinstance(wanted, str) else wanted
    found = orientation(width, height)
    judged = _judged(found, found == wanted, "wrong_orientation", "no_dimensions")
    return F.when(wanted.isNull() | (wanted == "any"), _result(F.lit("skipped"), F.lit("no_requirement"), found)).otherwise(judged)


def min_duration_rule(container_s: Column, decoder_s: Column, least_s: Column | float, still: Column | None = None) -> Column:
    """The decoder's duration counts where it differs from the container's by more than a little."""
    least = least_s if isinstance(least_s, Column) else F.lit(least_s)
    value = F.when(container_s.isNull() | (F.abs(decoder_s - container_s) > DECODER_SLACK_S), F.coalesce(decoder_s, container_s)).otherwise(container_s)
    judged = _judged(value, value >= least, "too_short", "no_duration")
    return judged if still is None else F.when(F.coalesce(still, F.lit(False)), _result(F.lit("skipped"), F.lit("still_image"), value)).otherwise(judged)


def min_resolution_rule(width: Column, height: Column, short_edge: Column | int, long_edge: Column | int) -> Column:
    low, high = F.least(width, height), F.greatest(width, height)
    known = F.when(width.isNotNull() & height.isNotNull(), F.concat_ws("x", low.cast("string"), high.cast("string")))
    return _judged(known, (low >= short_edge) & (high >= long_edge), "too_small", "no_dimensions")


def captured_at(stated_ms: Column, container_ms: Column) -> Column:
    """(at_ms, source): what the creator states, else what the file holds."""
    source = F.when(stated_ms.isNotNull(), "creator_stated").when(container_ms.isNotNull(), "container").otherwise("unknown")
    return F.struct(F.coalesce(stated_ms, container_ms).alias("at_ms"), source.alias("source"))


def capture_choice(candidates: Column) -> Column:
    """Of candidates (at_ms, source, has_offset) the least ambiguous: with an offset first, then by source.

    ``disagreement_ms`` is how far the others are from it; beyond a minute the choice is of low confidence.
    """
    rank = lambda c: F.coalesce(*[F.when(c["source"] == name, i) for i, name in enumerate(CAPTURE_SOURCES)], F.lit(-1))
    placed = F.transform(candidates, lambda c: F.struct(c["has_offset"].cast("int").alias("sure"), rank(c).alias("rank"), c["at_ms"].alias("at_ms"), c["source"].alias("source")))
    best = F.array_max(placed)
    off = F.array_max(F.transform(candidates, lambda c: F.abs(c["at_ms"] - best["at_ms"])))
    confidence = F.when(off > CLOCK_SLACK_MS, "low").when(best["sure"] == 1, "high").otherwise("assumed")
    return F.when(F.size(candidates) > 0, F.struct(best["at_ms"].alias("at_ms"), best["source"].alias("source"), off.alias("disagreement_ms"), confidence.alias("confidence")))


def rotation_decision(coded: Column, reported: Column, degrees: Column) -> Column:
    """(quarter_turns, source): who turns a picture, from its coded and its reported size (width, height).

    Where the reported size is the turned one, the decoder did it already; a square says nothing.
    """
    base = F.coalesce(coded, reported)
    turns = (degrees / 90).cast("int") % 4
    odd = turns % 2 == 1
    turned = F.struct(F.when(odd, base["height"]).otherwise(base["width"]).alias("width"), F.when(odd, base["width"]).otherwise(base["height"]).alias("height"))
    same = lambda a, b: (a["width"] == b["width"]) & (a["height"] == b["height"])
    source = (
        F.when(degrees == 0, "not_needed")
        .when(reported.isNull(), "we_applied")
        .when(same(reported, base) & same(reported, turned), "undecidable")
        .when(same(reported, turned), "element_applied")
        .otherwise("we_applied")
    )
    return F.struct(F.when(source == "we_applied", turns).otherwise(0).alias("quarter_turns"), source.alias("source"))


def capture_date_rule(at: Column, visit_day: Column, margin_hours: float) -> Column:
    """Inside the half-open visit window; how many hours outside otherwise."""
    window = visit_window(visit_day, margin_hours)
    inside = (at >= window["from"]) & (at < window["to"])
    seconds = F.when(at < window["from"], F.unix_seconds(window["from"]) - F.unix_seconds(at)).otherwise(F.unix_seconds(at) - F.unix_seconds(window["to"]))
    status = F.when(visit_day.isNull(), "skipped").when(at.isNull(), "unknown").when(inside, "pass").otherwise("fail")
    reason = F.when(visit_day.isNull(), "no_visit_date").when(at.isNull(), "no_capture_date").when(~inside, "outside_visit_window")
    return _result(status, reason, F.when(~inside, F.round(seconds / 3600, 3)).otherwise(F.lit(0.0)))


def near_branch_rule(lat: Column, lng: Column, branch_lat: Column, branch_lng: Column, radius_m: Column | float) -> Column:
    """Within the radius, its edge included; skipped where the branch has no place."""
    metres = haversine_m(lat, lng, branch_lat, branch_lng)
    judged = _judged(F.round(metres, 1), metres <= radius_m, "too_far", "no_gps")
    nowhere = branch_lat.isNull() | branch_lng.isNull()
    return F.when(nowhere, _result(F.lit("skipped"), F.lit("no_branch_coordinates"), F.lit(None))).otherwise(judged)


def duplicate_rule(compared: Column, match: Column) -> Column:
    """``match``: the earlier asset that is the same; ``compared``: how many it was held against."""
    status = F.when(compared.isNull(), "unknown").when(compared == 0, "skipped").when(match.isNotNull(), "fail").otherwise("pass")
    reason = F.when(compared.isNull(), "no_frames").when(compared == 0, "nothing_to_compare").when(match.isNotNull(), "duplicate")
    return _result(status, reason, match)


def codec_rule(codec: Column, support: Column) -> Column:
    """``support``: yes, no or unknown, as the decoder reports."""
    status = F.when(codec.isNull(), "unknown").when(support == "yes", "pass").when(support == "no", "fail").otherwise("unknown")
    reason = F.when(codec.isNull(), "no_codec").when(support == "no", "codec_not_playable").when(F.coalesce(support, F.lit("unknown")) == "unknown", "support_unknown")
    return _result(status, reason, codec)


def rollup(results: dict[str, Column]) -> Column:
    """(pass, fail, unknown, skipped, blocking_fail): how many results have each status."""

    def count(status: str, names: tuple[str, ...] | None = None) -> Column:
        chosen = [r for k, r in results.items() if names is None or k in names]
        return reduce(lambda a, b: a + b, [(r["status"] == status).cast("int") for r in chosen], F.lit(0))

    return F.struct(*[count(s).alias(s) for s in STATUSES], count("fail", BLOCKING).alias("blocking_fail"))


def verdict(rolled: Column) -> Column:
    """blocked before advisory before unknown (nothing passed and something isn't known) before ok."""
    return (
        F.when(rolled["blocking_fail"] > 0, "blocked")
        .when(rolled["fail"] > 0, "advisory")
        .when((rolled["pass"] == 0) & (rolled["unknown"] > 0), "unknown")
        .otherwise("ok")
    )


#: What a rule says it rests on, by the atom of a position, and sources of a time under the names that are stored.
GPS_EVIDENCE = {"udta_loci_3gpp": "udta_loci", "udta_c_xyz_iso6709": "udta_c_xyz", "apple_quicktime_iso6709": "apple_quicktime"}
STORED_SOURCES = {"udta_day": "udta", "mvhd": "mvhd", "apple_quicktime": "apple_quicktime", "creator_stated": "creator_stated"}
#: Fields of a rule that are stored.
STORED_FIELDS = ("status", "evidence", "reason", "blocking", "value")


def _named(value: Column, names: dict[str, str], otherwise: str) -> Column:
    return F.coalesce(*[F.when(value == k, v) for k, v in names.items()], F.lit(otherwise))


def resolution_evidence(is_photo: Column, coded: Column, presentation: Column) -> Column:
    """What a resolution rests on; ``coded`` and ``presentation`` are null where a clip doesn't tell them."""
    told = F.when(coded.isNotNull() & presentation.isNotNull(), "tkhd+stsd").when(coded.isNotNull(), "stsd").otherwise("tkhd")
    return F.when(is_photo, "image_dims").otherwise(told)


def capture_absence(is_photo: Column, sources: Column) -> Column:
    """(reason, also): why no time of capture is known; ``sources`` of a clip's candidates are null if its container can't be read."""
    reason = F.when(is_photo, "no_exif_parser_for_still_images").when(sources.isNull(), "container_facts_unavailable").otherwise("mvhd_creation_time_zero")
    also = F.when(~is_photo & ~F.array_contains(sources, "udta_day"), F.array(F.lit("no_udta_day_atom")))
    return F.struct(reason.alias("reason"), also.alias("also"))


def position_absence(is_photo: Column, never_decodes: Column) -> Column:
    clip = F.when(never_decodes, "no_gps_atom_camera_has_no_receiver").otherwise("no_gps_atom_metadata_stripped")
    return F.when(is_photo, "no_gps_atom_not_written_by_encoder").otherwise(clip)


def position_evidence(atom: Column) -> Column:
    return _named(atom, GPS_EVIDENCE, "none")


def stored_rules(results: Column) -> Column:
    """A map of rules to their results with STORED_FIELDS alone; evidence ``none`` is stored as null."""

    def stored(_: Column, rule: Column) -> Column:
        return F.struct(*[(F.nullif(rule[f], F.lit("none")) if f == "evidence" else rule[f]).alias(f) for f in STORED_FIELDS])

    return F.transform_values(results, stored)


def stored_source(source: Column) -> Column:
    """The stored name of a source of a capture time; names that aren't stored are ``unknown``."""
    return _named(source, STORED_SOURCES, "unknown")
