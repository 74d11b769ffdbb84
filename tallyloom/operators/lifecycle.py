"""States and movements of files: transitions, gates, media states, offsets, eviction, invitations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.canonical import uuid7

#: Fixed values.
TRANSFERS = {"not_queued": ("queued",), "queued": ("in_flight", "not_queued"), "in_flight": ("transferred", "failed"), "failed": ("queued",), "transferred": ()}
BATCH_LIMIT = 60
TIERS = ("ample", "standard", "constrained")
MB = 1024 * 1024
#: What a tier allows.
PROFILES = {
    "ample": {"frame_floor": 5, "frame_ceiling": 7, "decode_concurrency": 4, "frame_long_edge": 480, "jpeg_quality": 0.72, "upload_concurrency": 4, "chunk_bytes": 8 * MB, "max_local_original_bytes": 2048 * MB},
    "standard": {"frame_floor": 4, "frame_ceiling": 6, "decode_concurrency": 2, "frame_long_edge": 480, "jpeg_quality": 0.7, "upload_concurrency": 2, "chunk_bytes": 4 * MB, "max_local_original_bytes": 1024 * MB},
    "constrained": {"frame_floor": 3, "frame_ceiling": 3, "decode_concurrency": 1, "frame_long_edge": 360, "jpeg_quality": 0.66, "upload_concurrency": 2, "chunk_bytes": 2 * MB, "max_local_original_bytes": 512 * MB},
}
CODECS = {"avc1": "h264", "avc3": "h264", "hvc1": "hevc", "hev1": "hevc", "av01": "av1", "vp09": "vp9", "apch": "prores", "apcn": "prores", "mp4v": "mpeg4"}


def transitions(steps: DataFrame, legal: dict[str, tuple[str, ...]], first: str) -> DataFrame:
    """Steps (id, place, state) with the state before and whether the change is legal."""
    before = F.coalesce(F.lag("state").over(Window.partitionBy("id").orderBy("place")), F.lit(first))
    allowed = F.lit(False)
    for a, ends in legal.items():
        allowed = allowed | ((F.col("before") == a) & F.col("state").isin(list(ends)))
    return steps.withColumn("before", before).withColumn("legal", allowed)


def first_refusal(refusals: dict[str, Column]) -> Column:
    """The first reason that holds, in their order; ``go`` if none does."""
    return F.coalesce(*[F.when(holds, reason) for reason, holds in refusals.items()], F.lit("go"))


def split_batch(df: DataFrame, refusals: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """What may be queued, and what is refused with its ``reason``."""
    judged = df.withColumn("reason", first_refusal(refusals))
    return judged.filter("reason = 'go'").drop("reason"), judged.filter("reason <> 'go'")


def media_state(bytes_key: Column, remote: Column, quota_evicted: Column) -> Column:
    """(state, reason): where an asset's bytes are."""
    state = F.when(bytes_key.isNotNull(), "bytes_local").when(remote, "remote").otherwise("absent")
    reason = F.when(bytes_key.isNotNull() | remote, F.lit(None)).when(quota_evicted, "evicted").otherwise("never_stored")
    return F.struct(state.alias("state"), reason.cast("string").alias("reason"))


def derivative_state(poster: Column, sheet: Column) -> Column:
    return F.when(poster.isNotNull() & sheet.isNotNull(), "ready").when(poster.isNotNull() | sheet.isNotNull(), "partial").otherwise("none")


def codec_family(fourcc: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CODECS.items() for x in pair]), F.lower(fourcc)), F.lit("unknown"))


def graded_tier(cores: Column, memory_gb: Column, coarse_pointer: Column, has_worker: Column) -> Column:
    """The tier of a device by the mean of three grades from 0 to 2; what is unknown has grade 1, and without a worker none is ample."""

    def size(x: Column) -> Column:
        known = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
        return F.when(~known, 1).when(x >= 8, 2).when(x >= 4, 1).otherwise(0)

    pointer = F.when(coarse_pointer.isNull(), 1).when(coarse_pointer, 0).otherwise(2)
    mean = (size(cores) + size(memory_gb) + pointer) / 3
    tier = F.when(mean >= 1.6, TIERS[0]).when(mean >= 0.9, TIERS[1]).otherwise(TIERS[2])
    return F.when((tier == TIERS[0]) & ~F.coalesce(has_worker, F.lit(False)), TIERS[1]).otherwise(tier)


def ingest_tier(tier: Column, files: Column) -> Column:
    """A large batch makes an ample device a standard one; a tier never goes up."""
    return F.when((tier == TIERS[0]) & (F.coalesce(files, F.lit(0)) > BATCH_LIMIT), TIERS[1]).otherwise(tier)


def profile(tier: Column, name: str) -> Column:
    """A number of a tier's profile."""
    out = F.lit(None)
    for t in TIERS:
        out = F.when(tier == t, F.lit(PROFILES[t][name])).otherwise(out)
    return out


def frame_count(duration_s: Column, tier: Column) -> Column:
    """Three frames and one for each three seconds, as far as the tier allows; its least for a length that isn't known."""
    known = duration_s.isNotNull() & ~F.isnan(duration_s) & (F.abs(duration_s) != float("inf")) & (duration_s > 0)
    wished = 3 + F.floor(duration_s / 3 + 0.5)
    floor, ceiling = profile(tier, "frame_floor"), profile(tier, "frame_ceiling")
    return F.when(known, F.least(ceiling, F.greatest(floor, wished))).otherwise(floor).cast("int")


def sheet_layout(frames: Column) -> Column:
    """The sheet of so many frames: one row of three to seven."""
    return F.concat(F.lit("1x"), F.least(F.lit(7), F.greatest(F.lit(3), frames)).cast("string"))


def _rung(tier: Column) -> Column:
    """How far down the ladder a tier is, from 1; null for what is no tier."""
    place = F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)
    return F.when(place > 0, place)


def downgrades(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (session_id, ord, to, reason) with ``before``, ``after`` and ``taken``: a running worst rung over each session.

    A session (session_id, tier, files) begins at its tier, or lower for a large batch; a request is taken if it asks for a lower
    tier than any before it.  Requests to what is no tier, and those of unknown sessions, aren't taken.
    """
    begun = sessions.select("session_id", _rung(ingest_tier(F.col("tier"), F.col("files"))).alias("start"))
    earlier = Window.partitionBy("session_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    asked = requests.join(begun, "session_id", "left").withColumn("rung", _rung(F.col("to")))
    worst = F.greatest("start", F.max("rung").over(earlier))
    told = asked.withColumn("worst", worst).withColumn("taken", F.coalesce(F.col("rung") > F.col("worst"), F.lit(False)))
    name = lambda place: F.get(F.array(*[F.lit(t) for t in TIERS]), place - 1)
    return told.select("session_id", "ord", "to", "reason", name(F.col("worst")).alias("before"), name(F.when(F.col("taken"), F.col("rung")).otherwise(F.col("worst"))).alias("after"), "taken")


def ingest_policy(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Each session's policy after its requests: the tier, its numbers, and why it went down, in order.

    ``sessions``: session_id, tier, files, has_worker.  A session goes down twice at most, so its notes are few.
    """
    down = downgrades(sessions, requests).filter("taken")
    note = F.concat("before", F.lit(" -> "), "after", F.lit(": "), F.coalesce("reason", F.lit("")))
    noted = down.groupBy("session_id").agg(F.max_by("after", "ord").alias("lowest"), F.transform(F.array_sort(F.collect_list(F.struct("ord", note.alias("note")))), lambda x: x["note"]).alias("notes"))
    joined = sessions.join(noted, "session_id", "left")
    large = (F.col("tier") == TIERS[0]) & (F.coalesce("files", F.lit(0)) > BATCH_LIMIT)
    first = F.array_compact(F.array(
        F.when(~F.coalesce("has_worker", F.lit(False)), F.lit("no_worker: extraction runs on the main thread, so concurrency is capped")),
        F.when(large, F.concat(F.lit("large_batch: "), F.col("files").cast("string"), F.lit(" files, so concurrency is reduced"))),
    ))
    tier = F.coalesce("lowest", ingest_tier(F.col("tier"), F.col("files")))
    out = joined.select("session_id", tier.alias("tier"), F.concat(first, F.coalesce("notes", F.array().cast("array<string>"))).alias("downgrades"))
    return out.select("session_id", "tier", *[profile(F.col("tier"), n).alias(n) for n in PROFILES[TIERS[0]]], "downgrades")


def sample_offsets(runs: DataFrame, key: str) -> DataFrame:
    """Where each sample begins, from a count and a size for each ``key``."""
    samples = runs.select(key, "size", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))).alias("sample"))
    before = Window.partitionBy(key).orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    return samples.select(key, "sample", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"))


def evicted(blobs: DataFrame, owner: str, key: str, keep_bytes: int) -> DataFrame:
    """The oldest blobs that must go until an owner's take no more than ``keep_bytes``; ``freed``: bytes so far."""
    own = Window.partitionBy(owner)
    upto = F.sum("bytes").over(own.orderBy("created_at", key).rowsBetween(Window.unboundedPreceding, 0))
    summed = blobs.withColumn("freed", upto).withColumn("total", F.sum("bytes").over(own))
    return summed.filter(F.col("freed") - F.col("bytes") < F.col("total") - keep_bytes)


def opened(asked: DataFrame, tokens: DataFrame, collabs: DataFrame, creators: DataFrame) -> DataFrame:
    """What an invitation leads to: ok with its creator, refused if revoked or dangling, unknown without a token."""
    known = tokens.join(collabs, "collab_id", "left").join(creators.withColumn("there", F.lit(True)), "creator_id", "left")
    joined = asked.join(known.select("token_hash", "collab_id", "creator_id", "revoked_at", "there"), "token_hash", "left")
    fine = F.col("revoked_at").isNull() & F.col("there")
    outcome = F.when(F.col("collab_id").isNull(), "unknown").when(F.coalesce(fine, F.lit(False)), "ok").otherwise("refused")
    return joined.select(*asked.columns, outcome.alias("outcome"), F.when(outcome == "ok", F.col("creator_id")).alias("creator_id"))


#: Fixed value: how long an invitation holds.
INVITE_MS = 14 * 86_400_000


def invited(briefs: DataFrame, now_ms: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """Tokens for briefs (id, collab_id): what is shown once (brief_id, raw), and what is stored, which holds their hashes alone.

    The same briefs, time and seed give the same tokens, so a job that is run again shows what it stored.
    """
    counter = F.pmod(F.xxhash64("id"), F.lit(4096))
    raw = F.concat(F.lit("invite-"), uuid7(F.lit(now_ms), counter, F.lit(seed), F.col("id")))
    minted = briefs.select(F.col("id").alias("brief_id"), "collab_id", raw.alias("raw"))
    stored = minted.select(
        "collab_id", F.sha2("raw", 256).alias("token_hash"), F.lit("upload").alias("purpose"), F.lit(now_ms + INVITE_MS).cast("long").alias("expires_at"), F.lit(None).cast("long").alias("revoked_at")
    )
    return minted.select("brief_id", "raw"), stored


def consent_gate(collabs: DataFrame, consents: DataFrame, briefs: DataFrame, items: DataFrame) -> DataFrame:
    """(collab_id, goes, consent_id, brief_id, items): where an invitation leads, by the records of consent and not by what a collab says of them.

    A creator who has agreed goes to the upload, by the last record (created_at, id); others are shown the collab's locked
    brief, its first one if none is, with the items' ids in their order.
    """
    last = consents.groupBy("collab_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("consent_id"))
    shown = briefs.groupBy("collab_id").agg(F.min(F.struct((F.col("status") != "locked").alias("open"), "id")).alias("b")).select("collab_id", F.col("b.id").alias("brief_id"))
    listed = items.groupBy("brief_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("items"))  # those of one brief
    joined = collabs.select(F.col("id").alias("collab_id")).join(last, "collab_id", "left").join(shown, "collab_id", "left").join(listed, "brief_id", "left")
    agreed = F.col("consent_id").isNotNull()
    return joined.select("collab_id", F.when(agreed, "upload").otherwise("agree").alias("goes"), "consent_id", F.when(~agreed, F.col("brief_id")).alias("brief_id"), F.when(~agreed, F.coalesce("items", F.array().cast("array<string>"))).alias("items"))
