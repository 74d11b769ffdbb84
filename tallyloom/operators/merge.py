"""Policy-driven merge of field-level patches, as running aggregates over each row's patches.

A patch is a map of field to JSON text; a field that it holds with ``null`` is there, one it
doesn't hold is absent.  The first patch of a row, by ``seq``, is its base.  Every rule looks
at the patches before the present one: whether a ladder, a sticky or a write-once field has
moved on, and how late the row was changed.  One shuffle by row serves all rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """How the fields of one table merge; what isn't named goes by the later ``updated_at``."""

    write_once: tuple[str, ...] = ()
    #: Ladders, lowest rung first; values move up only.
    ordinal: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: Fields that stay once set (None), or once they have this value.
    sticky: dict[str, Any] = field(default_factory=dict)
    #: Fields that are taken or refused together; a ladder among them decides.
    coupled: tuple[tuple[str, ...], ...] = ()
    recompute: tuple[str, ...] = ()
    immutable: bool = False
    #: (field, value on top of its ladder, then fields and values).
    implies: tuple[tuple[str, str, tuple[tuple[str, Any], ...]], ...] = ()
    local_only: tuple[str, ...] = ()


#: What every table has, and fields that only the receiving side writes.
ENVELOPE_WRITE_ONCE = ("id", "org_id", "created_at", "origin_device")
ENVELOPE_STICKY = {"deleted_at": None}
SERVER_OWNED = ("server_updated_at", "rev")

#: The tables' policies.
POLICIES = {
    "asset": Policy(
        write_once=(
            "kind", "delivery_id", "collab_id", "branch_id", "filename", "bytes", "duration_s", "coded_width", "coded_height", "rotation_deg",
            "codec_video", "has_audio", "captured_at", "captured_at_source", "gps", "phash_primary", "frame_hashes", "bytes_key", "poster_key", "sheet_key",
        ),
        ordinal={"review_status": ("pending", "approved", "rejected"), "derivative_state": ("none", "partial", "ready")},
        coupled=(
            ("review_status", "is_published", "is_published_i", "reject_reason_text", "creator_facing_note", "confirmed_brief_item_id"),
            ("is_exemplar", "is_exemplar_i", "exemplar_note"),
        ),
        recompute=(
            "preflight", "preflight_version", "client_decodable", "needs_transcode", "probe_result", "used_count", "download_count", "ai_description", "ai_shot_type",
            "ai_room", "ai_subjects", "ai_quality_score", "ai_framing_score", "ai_confidence", "ai_brand_safety", "ai_matched_brief_item_id", "ai_provenance",
        ),
        implies=(("review_status", "rejected", (("is_published", False), ("is_published_i", 0))),),
    ),
    "collab": Policy(
        ordinal={
            "stage": ("source", "vet", "book", "brief", "visit", "delivered", "library", "closed"),
            "outcome": ("open", "completed", "ghosted", "cancelled"),
        },
        write_once=("creator_id", "branch_id", "usage_terms_text", "consent_text_version", "consent_accepted_at"),
    ),
    "creator": Policy(
        sticky={"lifecycle": "blocked"},
        coupled=(("fit_score_override", "override_reason"),),
        recompute=("scorecard", "reliability_tier", "fit_score", "fit_reasons", "risk_flags", "suggested_tier"),
    ),
    "brief": Policy(write_once=("collab_id", "gap_scan_id"), ordinal={"status": ("draft", "locked", "superseded")}, sticky={"locked_at": None}),
    "brief_item": Policy(write_once=("brief_id", "origin_gap_id")),
    "delivery": Policy(ordinal={"state": ("open", "submitted", "reviewed")}, sticky={"submitted_at": None, "nudge_sent_at": None}, write_once=("collab_id",)),
    "tag": Policy(write_once=("asset_id", "term", "source", "ai_run_id"), sticky={"removed_at": None, "rejected_by_human": True}),
    "ai_run": Policy(immutable=True),
    "review_action": Policy(immutable=True),
    "consent_record": Policy(immutable=True),
    "gap_scan": Policy(immutable=True),
    "gap": Policy(write_once=("cell_signature", "gap_scan_id"), ordinal={"status": ("open", "closed", "dismissed")}),
    "access_token": Policy(sticky={"revoked_at": None}),
}


def _text(value: Any) -> str:
    return json.dumps(value)


def _rank(value: Column, ladder: tuple[str, ...]) -> Column:
    """The rung of a JSON text, -1 off the ladder."""
    return F.coalesce(*[F.when(value == _text(rung), i) for i, rung in enumerate(ladder)], F.lit(-1))


def _named(names: tuple[str, ...] | list[str]) -> Column:
    return F.col("field").isin(list(names)) if names else F.lit(False)


def _other_than(name: str):
    return lambda key, _: key != name


@dataclass(frozen=True)
class Merged:
    #: (row_id, row): a map of field to JSON text.
    rows: DataFrame
    #: (row_id, seq, fields, policy, kept, refused)
    conflicts: DataFrame


def merge(patches: DataFrame, policy: Policy) -> Merged:
    """Folds patches (row_id, seq, updated_at, patch) in order of ``seq``."""
    row = Window.partitionBy("row_id").orderBy("seq")
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    dropped = [*SERVER_OWNED, *policy.local_only]
    at = F.coalesce("updated_at", F.lit(0))
    step = patches.select(
        "row_id", "seq", F.map_filter("patch", lambda k, _: ~k.isin(dropped)).alias("patch"), at.alias("at")
    ).select(
        "*",
        (F.row_number().over(row) == 1).alias("base"),
        (F.col("at") >= F.coalesce(F.max("at").over(before), F.lit(0))).alias("wins"),
    )
    conflicts: list[Column] = []
    verdicts: dict[str, Column] = {}
    for g, group in enumerate(policy.coupled):
        ladder_field = next((f for f in group if f in policy.ordinal), None)
        accept = F.col("wins")
        if ladder_field:
            ladder = policy.ordinal[ladder_field]
            value = F.try_element_at("patch", F.lit(ladder_field))
            step = step.withColumn(f"rank{g}", F.when(F.map_contains_key("patch", ladder_field), _rank(value, ladder)))
            step = step.withColumn(f"high{g}", F.coalesce(F.max(f"rank{g}").over(before), F.lit(-1)))
            # the value now held: the earliest on the highest rung, or what the base has off the ladder
            held = F.max_by(value, F.struct(F.col(f"rank{g}"), -F.col("seq"))).over(before)
            there, high = F.col(f"rank{g}"), F.col(f"high{g}")
            refused = there.isNotNull() & (there < high) & ~F.col("base")
            accept = F.when(there.isNull(), F.col("wins")).otherwise((there > high) | ((there == high) & F.col("wins")))
            present = F.filter(F.array(*[F.lit(f) for f in group]), lambda f: F.map_contains_key("patch", f))
            conflicts.append(F.when(refused, F.struct(present.alias("fields"), F.lit("ordinal").alias("policy"), held.alias("kept"), value.alias("refused"))))
        step = step.withColumn(f"accept{g}", accept | F.col("base"))
        verdicts |= dict.fromkeys(group, F.col(f"accept{g}"))
    for source, top, then in policy.implies:
        g = next(i for i, group in enumerate(policy.coupled) if source in group)
        last = len(policy.ordinal[source]) - 1
        was = F.col(f"high{g}") == last
        now = was | (F.coalesce(F.col(f"rank{g}"), F.lit(-1)) == last)
        for name, value in then:
            given = F.when(F.map_contains_key("patch", name) & F.col(f"accept{g}"), F.try_element_at("patch", F.lit(name)))
            earlier = F.last(given, ignorenulls=True).over(before)
            standing = F.coalesce(given, F.when(was & earlier.isNotNull(), F.lit(_text(value))).otherwise(earlier))
            broken = now & standing.isNotNull() & (standing != _text(value))
            conflicts.append(F.when(broken, F.struct(F.array(F.lit(name)).alias("fields"), F.lit("implies").alias("policy"), F.lit(_text(value)).alias("kept"), standing.alias("refused"))))
    empty = F.array().cast("array<struct<fields:array<string>,policy:string,kept:string,refused:string>>")
    step = step.withColumn("refusals", F.array_compact(F.array(*conflicts)) if conflicts else empty)

    accepts = [f"accept{g}" for g in range(len(policy.coupled))]
    cells = step.select("row_id", "seq", "base", "wins", *accepts, F.explode("patch").alias("field", "value"))
    own = Window.partitionBy("row_id", "field").orderBy("seq")
    prior = own.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.col("value") != "null"
    grouped = set(verdicts)
    sticky = {k: v for k, v in {**ENVELOPE_STICKY, **policy.sticky}.items() if k not in grouped}
    ladders = {k: v for k, v in policy.ordinal.items() if k not in grouped}
    once = tuple(f for f in dict.fromkeys((*ENVELOPE_WRITE_ONCE, *policy.write_once)) if f not in grouped and f not in sticky)
    set_sticky = [k for k, v in sticky.items() if v is None]

    rank = F.coalesce(*[F.when(F.col("field") == k, _rank(F.col("value"), v)) for k, v in ladders.items()], F.lit(-1)) if ladders else F.lit(-1)
    cells = cells.withColumn("rank", rank)
    sticks = _named(set_sticky) & filled
    for k, v in sticky.items():
        if v is not None:
            sticks = sticks | ((F.col("field") == k) & (F.col("value") == _text(v)))
    cells = cells.withColumn("sticks", sticks)
    first_filled = F.first(F.when(filled, F.col("value")), ignorenulls=True).over(prior)
    stuck_at = F.first(F.when(F.col("sticks"), F.col("value")), ignorenulls=True).over(prior)
    high = F.coalesce(F.max("rank").over(prior), F.lit(-1))
    highest = F.max_by("value", F.struct(F.col("rank"), -F.col("seq"))).over(prior)
    cells = cells.select("*", first_filled.alias("first"), stuck_at.alias("stuck"), high.alias("high"), highest.alias("highest"))

    group_accept = F.coalesce(*[F.when(_named(group), F.col(f"accept{g}")) for g, group in enumerate(policy.coupled)], F.lit(False)) if policy.coupled else F.lit(False)
    rule = (
        F.when(_named(tuple(grouped)), "coupled")
        .when(_named(policy.recompute), "recompute")
        .when(_named(tuple(sticky)), "sticky")
        .when(_named(once), "write_once")
        .when(_named(tuple(ladders)), "ordinal")
        .otherwise("lww")
    )
    cells = cells.withColumn("rule", rule)
    r = F.col("rule")
    accepted = (
        F.when(F.col("base"), True)
        .when(F.lit(policy.immutable), False)
        .when(r == "coupled", group_accept)
        .when(r == "recompute", False)
        .when(r == "sticky", F.col("stuck").isNull())
        .when(r == "write_once", F.col("first").isNull())
        .when(r == "ordinal", F.col("rank") > F.col("high"))
        .otherwise(F.col("wins"))
    )
    kept = F.when(r == "sticky", F.col("stuck")).when(r == "write_once", F.col("first")).when((r == "ordinal") & (F.col("rank") < F.col("high")), F.col("highest"))
    refused = ~F.col("base") & ~F.lit(policy.immutable) & kept.isNotNull() & (kept != F.col("value"))
    cells = cells.withColumns({"accepted": accepted, "kept": kept, "clash": refused})

    fields = cells.groupBy("row_id", "field").agg(F.max_by("value", F.when(F.col("accepted"), F.col("seq"))).alias("value"), F.bool_or("accepted").alias("any"))
    rows = fields.filter("any").groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("row"))
    for source, top, then in policy.implies:
        for name, value in then:
            met = (F.try_element_at("row", F.lit(source)) == _text(top)) & F.map_contains_key("row", name)
            forced = F.map_concat(F.map_filter("row", _other_than(name)), F.create_map(F.lit(name), F.lit(_text(value))))
            rows = rows.withColumn("row", F.when(met, forced).otherwise(F.col("row")))
    single = cells.filter("clash").select("row_id", "seq", F.array("field").alias("fields"), F.col("rule").alias("policy"), "kept", F.col("value").alias("refused"))
    whole = step.filter(F.lit(not policy.immutable)).select("row_id", "seq", F.explode("refusals").alias("x")).select("row_id", "seq", "x.*")
    return Merged(rows, whole.unionByName(single))


def changed_fields(before: Column, after: Column) -> Column:
    """The part of ``after`` that differs from ``before``: what a patch has to say, nothing if empty."""
    return F.map_filter(after, lambda k, v: ~F.try_element_at(before, k).eqNullSafe(v))
