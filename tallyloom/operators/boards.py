"""Scorecards, rosters, triage and what was promised against what was delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import effective_score, percent, rate
from tallyloom.sources.tables import local

DRIFT_TOLERANCE = 0.0015
TRIAGE_ORDER = ("blocked", "review", "waiting", "done", "empty")


def scorecards(creators: DataFrame, collabs: DataFrame, assets: DataFrame, items: DataFrame) -> DataFrame:
    """One row per creator (creator_id): counts and null-safe rates.

    ``collabs`` (collab_id, creator_id, outcome), ``assets`` (collab_id, review_status,
    confirmed_item_id), ``items`` (item_id, collab_id) of locked briefs.  Children are
    aggregated before they meet their parents.
    """
    ruled = F.col("review_status").isin("approved", "rejected")
    footage = assets.filter(F.col("collab_id").isNotNull()).groupBy("collab_id").agg(
        F.count("*").alias("footage"), F.count_if(ruled).alias("ruled"), F.count_if(F.col("review_status") == "approved").alias("approved")
    )
    met = assets.filter(F.col("review_status") == "approved").select("collab_id", F.col("confirmed_item_id").alias("item_id")).filter("item_id IS NOT NULL").distinct()
    kept = items.join(met.withColumn("met", F.lit(1)), ["collab_id", "item_id"], "left").groupBy("collab_id").agg(F.count("*").alias("promised"), F.count("met").alias("delivered"))
    joined = collabs.join(footage, "collab_id", "left").join(kept, "collab_id", "left")
    any_footage = F.coalesce("footage", F.lit(0)) > 0
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    per = joined.groupBy("creator_id").agg(
        zero("ruled"), zero("approved"), zero("promised"), zero("delivered"),
        F.count_if((F.col("outcome") == "completed") & any_footage).alias("completed"),
        F.count_if((F.col("outcome") == "ghosted") | ((F.col("outcome") == "completed") & ~any_footage)).alias("ghosted"),
    )
    counts = ("ruled", "approved", "promised", "delivered", "completed", "ghosted")
    full = creators.join(per, "creator_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return full.withColumns({"approval_rate": rate("approved", "ruled"), "promise_kept_rate": rate("delivered", "promised")})


def differs(stored: Column, computed: Column) -> Column:
    """Null and a number differ; two numbers within a rounding step don't."""
    return F.when(stored.isNull() | computed.isNull(), ~stored.eqNullSafe(computed)).otherwise(F.abs(stored - computed) > DRIFT_TOLERANCE)


def drift(stored: Column, computed: Column, what: str) -> Column:
    """A sentence on a stored rate that no longer holds, else null."""
    return F.when(differs(stored, computed), F.concat(F.lit(f"{what}: stored "), percent(stored), F.lit(", computed "), percent(computed)))


def roster(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """In order: blocked last, unscored after scored, best score first, id."""
    order = [F.col("blocked").asc(), F.col("score").isNull().asc(), F.desc("score"), F.col("creator_id").asc()]
    sorted_ = scored.orderBy(*order)
    return sorted_ if limit is None else sorted_.limit(limit)


def with_effective_score(df: DataFrame) -> DataFrame:
    return df.withColumn("effective", effective_score("fit_score_override", "fit_score")).select("*", "effective.score", "effective.source").drop("effective")


def triaged(items: DataFrame, key: str) -> DataFrame:
    """The bucket of each delivery: the first that holds of blocked, to review, waiting, done."""
    found = items.groupBy(key).agg(
        F.bool_or("blocked").alias("blocked"), F.bool_or("reviewable").alias("reviewable"), F.bool_or("pending").alias("pending"), F.count("*").alias("n_items")
    )
    bucket = F.when(F.col("blocked"), "blocked").when(F.col("reviewable"), "review").when(F.col("pending"), "waiting").otherwise("done")
    return found.select(key, bucket.alias("bucket"), "n_items")


def in_triage_order(df: DataFrame, submitted: str, key: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(b) for b in TRIAGE_ORDER]), F.col("bucket"))
    return df.orderBy(place, F.desc(submitted), key)


def delivery_diff(items: DataFrame, assets: DataFrame) -> DataFrame:
    """What was promised against what is there.

    ``items`` (collab_id, item_id), ``assets`` (collab_id, asset_id, confirmed_item_id,
    matched_item_id, review_status, derivative_state).  An item is met by an approved asset
    that people confirmed for it, or by a model's match that stands: not rejected, and not
    confirmed for another item.  Else it is indeterminate while an asset of the collab has
    no derivatives yet, and missing otherwise.
    """
    confirmed = assets.filter((F.col("review_status") == "approved") & F.col("confirmed_item_id").isNotNull()).select("collab_id", F.col("confirmed_item_id").alias("item_id"), "asset_id")
    stands = (F.col("review_status") != "rejected") & F.col("confirmed_item_id").isNull() & F.col("matched_item_id").isNotNull()
    matched = assets.filter(stands).select("collab_id", F.col("matched_item_id").alias("item_id"), "asset_id")
    hits = confirmed.unionByName(matched).groupBy("collab_id", "item_id").agg(F.count_distinct("asset_id").alias("hits"))
    waiting = assets.groupBy("collab_id").agg(F.count_if((F.col("derivative_state") == "none") & (F.col("review_status") != "rejected")).alias("awaiting"))
    joined = items.join(hits, ["collab_id", "item_id"], "left").join(waiting, "collab_id", "left")
    state = F.when(F.col("hits").isNotNull(), F.when(F.col("hits") > 1, "over_claimed").otherwise("met")).when(F.coalesce("awaiting", F.lit(0)) > 0, "indeterminate").otherwise("missing")
    return joined.select("collab_id", "item_id", state.alias("state"), F.coalesce("hits", F.lit(0)).alias("hits"))


def coverage(diff: DataFrame) -> DataFrame:
    """Counts by state and the percentage met of each collab; 0 where nothing was promised."""
    met = F.count_if(F.col("state").isin("met", "over_claimed"))
    n = F.count("item_id")
    return diff.groupBy("collab_id").agg(
        n.alias("promised"), met.alias("met"), F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "indeterminate").alias("indeterminate"),
        F.when(n == 0, 0).otherwise(F.floor(met * 100.0 / n + 0.5)).cast("int").alias("percent"),
    )


def one_of_many(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_place = 1").drop("_place")


def zero_filled(names: list[str], df: DataFrame, column: str) -> DataFrame:
    """Counts by value, with those of ``names`` that don't occur."""
    wanted = local(df.sparkSession, {column: names})
    counts = df.filter(F.col(column).isin(names)).groupBy(column).agg(F.count("*").alias("n"))
    return wanted.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def stage_board(collabs: DataFrame, stages: tuple[str, ...], key: str = "collab_id") -> DataFrame:
    """Collabs (stage, entered_at) with their column and place on the board: the latest first."""
    column = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    order = Window.partitionBy("stage").orderBy(F.desc("entered_at"), key)
    return collabs.withColumn("column", column.cast("int")).withColumn("place", F.row_number().over(order))


def clip_sheet(assets: DataFrame, tags: DataFrame, usage: DataFrame) -> DataFrame:
    """For each asset (id) its live tags by people and by models, and how often it was used."""
    split = tags.groupBy(F.col("asset_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("source") == "human", F.col("term")))).alias("human_tags"),
        F.array_sort(F.collect_set(F.when(F.col("source") != "human", F.col("term")))).alias("ai_tags"),
    )
    used = usage.groupBy(F.col("asset_id").alias("id")).agg(F.count("*").alias("used"))
    empty = F.array().cast("array<string>")
    joined = assets.join(split, "id", "left").join(used, "id", "left")
    return joined.select(*assets.columns, F.coalesce("human_tags", empty).alias("human_tags"), F.coalesce("ai_tags", empty).alias("ai_tags"), F.coalesce("used", F.lit(0)).alias("used"))


def decided(seen: DataFrame, current: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (id, decision) on rows (id, rev) as they were seen; on rows that changed since they are ``stale``."""
    now = current.select("id", F.col("rev").alias("_now"))
    joined = decisions.join(seen.select("id", "rev"), "id").join(now, "id", "left")
    return joined.select(*decisions.columns, F.when(F.col("rev").eqNullSafe(F.col("_now")), "taken").otherwise("stale").alias("outcome"))
