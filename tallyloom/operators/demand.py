"""Demand from logs: weighted signals, finest cells, click rates, aliases, token index, agreement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import ascii_words, rate

#: What a signal weighs; browsing counts by its logarithm.
WEIGHTS = {"zero_result": 3.0, "refined": 2.5, "reached_past": 1.0, "requested": 4.0, "dead_end": 1.5}
BROWSE_WEIGHT = 0.5
#: Signals that need two sessions to count; a request needs one alone.
EVIDENCE = ("zero_result", "refined")


def scored(log: DataFrame, cell: list[str]) -> DataFrame:
    """``demand`` of each cell with enough evidence, from signals (cell columns, signal, session)."""
    n = {s: F.count_if(F.col("signal") == s) for s in (*WEIGHTS, "browsed")}
    backed = F.col("signal").isin(list(EVIDENCE))
    total = reduce(lambda a, b: a + b, [n[s] * w for s, w in WEIGHTS.items()]) + BROWSE_WEIGHT * F.log1p(n["browsed"].cast("double"))
    sums = log.groupBy(*cell).agg(
        total.alias("demand"), n["requested"].alias("requests"), F.count_if(backed).alias("signals"), F.count_distinct(F.when(backed, F.col("session"))).alias("sessions")
    )
    return sums.filter((F.col("requests") >= 1) | ((F.col("signals") >= 2) & (F.col("sessions") >= 2))).select(*cell, "demand")


#: Days after which supply is stale, and the least that it counts by then; clips that cover a cell in full.
FRESH_DAYS, STALEST, FULL = 180, 0.3, 3


def supply(assets: DataFrame, cell: list[str], today: Column, hero_bonus: float = 0.5) -> DataFrame:
    """What each cell has to offer, from assets (cell columns, review_status, is_published, deleted_at, quality, is_hero, used_count, approved_on).

    ``usable`` counts what is approved, published and not deleted, ``quality_supply`` weighs it;
    a high ``rejection_rate`` speaks for another brief, a high ``concentration`` for one clip that is always taken.
    """
    usable = (F.col("review_status") == "approved") & F.coalesce("is_published", F.lit(False)) & F.col("deleted_at").isNull()
    used = F.when(usable, F.coalesce("used_count", F.lit(0)))
    weight = F.least(F.lit(1.0), F.coalesce("quality", F.lit(0.0))) + F.when(F.col("is_hero"), hero_bonus).otherwise(0.0)
    sums = assets.groupBy(*cell).agg(
        F.count_if(usable).alias("usable"),
        F.coalesce(F.sum(F.when(usable, weight)), F.lit(0.0)).alias("quality_supply"),
        F.datediff(today, F.max(F.when(usable, F.col("approved_on")))).alias("days_since_newest"),
        rate(F.count_if(F.col("review_status") == "rejected"), F.count("*")).alias("rejection_rate"),
        rate(F.max(used), F.sum(used)).alias("concentration"),
        (F.count_if(used > 0) + 0.5 * F.count_if(used == 0)).alias("effective_count"),
    )
    fresh = F.greatest(F.lit(STALEST), F.least(F.lit(1.0), 1 - F.col("days_since_newest") / FRESH_DAYS))
    covered = F.least(F.lit(1.0), F.col("effective_count") / FULL)
    return sums.withColumn("supply_effective", F.coalesce(F.col("quality_supply") * fresh * covered, F.lit(0.0)))


def deficits(demands: DataFrame, supplies: DataFrame, cell: list[str]) -> DataFrame:
    """``deficit`` and ``severity`` of each cell with ``demand``; a cell without supply has all of it to make up for."""
    joined = demands.join(supplies, cell, "left").withColumn("deficit", F.col("demand") / (1 + F.coalesce("supply_effective", F.lit(0.0))))
    d = F.col("deficit")
    severity = F.when((d >= 8) & (F.col("demand") >= 5), "critical").when(d >= 4, "high").when(d >= 2, "medium").otherwise("low")
    return joined.withColumn("severity", severity)


def top_per_branch(cells: DataFrame, branch: str, tie: str, k: int) -> DataFrame:
    """The ``k`` cells of each branch with the most demand, and how many were left out."""
    every = Window.partitionBy(branch)
    placed = cells.withColumn("place", F.row_number().over(every.orderBy(F.desc("demand"), tie))).withColumn("suppressed", F.greatest(F.count("*").over(every) - k, F.lit(0)))
    return placed.filter(F.col("place") <= k)


def finest_cells(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Cells of each granularity with ``least`` rows; a cell goes if a finer one of it stays."""
    sets = [keys[:i] for i in range(len(keys), 0, -1)]
    grouped = rows.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.count("*").alias("n"), F.grouping_id().alias("level")).filter(F.col("n") >= least)
    # the grouping id has a bit for each key left out
    levels = {len(s): (1 << (len(keys) - len(s))) - 1 for s in sets}
    kept = grouped.filter(F.col("level") == 0)
    for size in range(len(keys) - 1, 0, -1):
        parents = grouped.filter(F.col("level") == levels[size])
        children = grouped.filter(F.col("level") == levels[size + 1]).select(*keys[:size]).distinct()
        kept = kept.unionByName(parents.join(children, keys[:size], "left_anti").select(*grouped.columns))
    return kept.select(*keys, "n")


def click_rates(log: DataFrame, half_life_days: float) -> DataFrame:
    """(token, asset_id, rate, shown): clicks over showings, older ones counting less."""
    weight = F.exp(-F.col("age_days") / half_life_days)
    return log.groupBy("token", "asset_id").agg((F.sum(F.when(F.col("clicked"), weight)) / F.sum(weight)).alias("rate"), F.count("*").alias("shown"))


def counters(log: DataFrame, keys: list[str], half_life_ms: float) -> DataFrame:
    """(keys, clicks, shown, at) of a batch of events (keys, clicked, at: ms): sums that fade, as they stand at ``at``.

    They halve in a half-life, and merge with those of other batches without a look at the events.
    """
    at = log.agg(F.max("at")).first()[0]
    weight = F.pow(F.lit(0.5), (F.lit(at) - F.col("at")) / half_life_ms)
    sums = log.groupBy(*keys).agg(F.sum(F.when(F.col("clicked"), weight).otherwise(0.0)).alias("clicks"), F.sum(weight).alias("shown"))
    return sums.withColumn("at", F.lit(at).cast("long"))


def merged_counters(batches: list[DataFrame], keys: list[str], half_life_ms: float) -> DataFrame:
    """Counters of several batches, in any order and of any times, as one."""
    every = reduce(DataFrame.unionByName, batches)
    at = every.agg(F.max("at")).first()[0]
    faded = F.pow(F.lit(0.5), (F.lit(at) - F.col("at")) / half_life_ms)
    return every.groupBy(*keys).agg(F.sum(F.col("clicks") * faded).alias("clicks"), F.sum(F.col("shown") * faded).alias("shown")).withColumn("at", F.lit(at).cast("long"))


@dataclass(frozen=True)
class Signals:
    """How much each signal adds to a score: uses (by their logarithm), clicks for the query's token, the editor's own leanings.

    Shown ``least_shown`` times for a token (as far as that hasn't faded) without ``least_clicks``, an asset's score is multiplied by ``demoted``.
    """

    uses: float = 1.0
    clicks: float = 2.0
    taste: float = 1.0
    least_shown: float = 5.0
    least_clicks: float = 0.5
    demoted: float = 0.5


def reranked(results: DataFrame, by_token: DataFrame, by_asset: DataFrame, by_taste: DataFrame, how: Signals = Signals()) -> DataFrame:
    """``results`` (query_id, user_id, token, asset_id, facet, score) with ``prior``, ``affinity``, ``taste``, ``demoted`` and ``ranked``, best first by ``place``.

    Counters are those of ``counters`` by (token, asset_id), by asset_id, and by (user_id, facet); what has none counts as nothing.
    """
    token = by_token.select("token", "asset_id", F.col("clicks").alias("t_clicks"), F.col("shown").alias("t_shown"))
    asset = by_asset.select("asset_id", F.col("clicks").alias("a_clicks"))
    own = by_taste.groupBy("user_id").agg(F.sum("clicks").alias("u_all"))
    taste = by_taste.join(own, "user_id").select("user_id", "facet", (F.col("clicks") / F.nullif(F.col("u_all"), F.lit(0.0))).alias("u_share"))
    joined = results.join(token, ["token", "asset_id"], "left").join(asset, "asset_id", "left").join(taste, ["user_id", "facet"], "left")
    some = lambda c: F.coalesce(c, F.lit(0.0))
    signals = {
        "prior": how.uses * F.log1p(some("a_clicks")),
        "affinity": how.clicks * some(F.col("t_clicks") / (F.col("t_shown") + 1)),
        "taste": how.taste * some("u_share"),
        "demoted": F.coalesce((F.col("t_shown") >= how.least_shown) & (F.col("t_clicks") < how.least_clicks), F.lit(False)),
    }
    scored = joined.withColumns(signals)
    ranked = (F.col("score") + F.col("prior") + F.col("affinity") + F.col("taste")) * F.when(F.col("demoted"), how.demoted).otherwise(1.0)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("ranked", 9)), "asset_id")
    return scored.withColumn("ranked", ranked).withColumn("place", F.row_number().over(order)).select(*results.columns, *signals, "ranked", "place")


def low_precision_tags(tags: DataFrame, by_asset: DataFrame, least: int, share: float) -> DataFrame:
    """(run, tag, n, bad) of tags (asset_id, tag, source, rejected, run) that a model gave and whose assets are rejected or never clicked in ``share`` of ``least`` cases and more."""
    told = tags.filter(F.col("source") == "ai").join(by_asset.select("asset_id", "clicks", "shown"), "asset_id", "left")
    bad = F.coalesce("rejected", F.lit(False)) | (F.coalesce("shown", F.lit(0.0)) > 0) & (F.coalesce("clicks", F.lit(0.0)) == 0)
    counted = told.groupBy("run", "tag").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return counted.filter((F.col("n") >= least) & (F.col("bad") >= share * F.col("n")))


def alias_pairs(terms: DataFrame, least: int, similar: float) -> DataFrame:
    """Terms (id, term) that occur on much the same ids: (term_a, term_b, n_both, jaccard).

    Of the pairs only those whose sizes can reach the similarity are joined.
    """
    once = terms.distinct()
    sizes = once.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    sized = once.join(sizes, "term")
    other = sized.select("id", F.col("term").alias("term_b"), F.col("n").alias("n_b"))
    fits = (F.col("term") < F.col("term_b")) & (F.least("n", "n_b") >= similar * F.greatest("n", "n_b"))
    both = sized.join(other, "id").filter(fits).groupBy(F.col("term").alias("term_a"), "term_b", "n", "n_b").agg(F.count("*").alias("n_both"))
    jaccard = F.col("n_both") / (F.col("n") + F.col("n_b") - F.col("n_both"))
    return both.withColumn("jaccard", jaccard).filter((F.col("n_both") >= least) & (F.col("jaccard") >= similar)).select("term_a", "term_b", "n_both", "jaccard")


def token_index(df: DataFrame, weights: dict[str, int]) -> DataFrame:
    """An inverted index (token, id, weight) over text columns, each with its weight."""
    weighed = lambda w: lambda x: F.struct(x.alias("token"), F.lit(w).alias("w"))
    each = [F.transform(ascii_words(c), weighed(w)) for c, w in weights.items()]
    words = F.explode(F.flatten(F.array_compact(F.array(*each))))
    return df.select("id", words.alias("x")).select("id", "x.token", "x.w").groupBy("token", "id").agg(F.sum("w").alias("weight"))


def asset_facets(df: DataFrame, names: list[str]) -> DataFrame:
    """(id, facet, value) of the facets that each row has."""
    held = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]), lambda _, v: v.isNotNull())
    return df.select("id", F.explode(held).alias("facet", "value"))


def reindex_queue(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """(id, reason) of rows that an index has to look at again: added, removed, or changed in ``fields``."""
    mark = F.xxhash64(*[F.struct(F.col(f).isNull(), F.col(f)) for f in fields])
    told = before.select("id", F.lit(True).alias("was"), mark.alias("old")).join(after.select("id", F.lit(True).alias("here"), mark.alias("new")), "id", "full")
    reason = F.when(F.col("was").isNull(), "added").when(F.col("here").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return told.select("id", reason.alias("reason")).filter("reason IS NOT NULL")


def alias_queue(index: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, reason) of rows that hold a word whose alias (alias, term) has changed: without them a merge would not show."""
    words = aliases.select(F.explode(F.array("alias", "term")).alias("token")).distinct()
    return index.join(words, "token", "left_semi").select("id", F.lit("alias").alias("reason")).distinct()


def _counted(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(*rows.columns).agg(F.count("*").cast("int").alias(name))


def _beside(a: DataFrame, b: DataFrame, columns: list[str], n: Column) -> DataFrame:
    """Rows of two counted frames with ``n`` made of their counts.

    A join, no union: adaptive plans take a union of sides that are partitioned alike for
    partitioned, and fail once they change the join below one of them.
    """
    on = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])
    return a.alias("a").join(b.alias("b"), on, "full").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in columns], n.alias("n"))


def index_changes(index: DataFrame, after: DataFrame, queue: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What changes in an index that ``build`` makes of rows: its rows with ``change``, -1 for those that go and 1 for those that come.

    Only rows of the queue are built again; what comes out as it was is no change.
    """
    touched = queue.select("id").distinct()
    old, new = index.join(touched, "id", "left_semi"), build(after.join(touched, "id", "left_semi"))
    change = F.coalesce("came", F.lit(0)) - F.coalesce("went", F.lit(0))
    return _beside(_counted(old, "went"), _counted(new, "came"), index.columns, change).filter("n <> 0").withColumnRenamed("n", "change")


def index_applied(index: DataFrame, changes: DataFrame) -> DataFrame:
    """``index`` after ``changes``, each row as often as it is there; its other rows aren't built again."""
    n = F.coalesce("held", F.lit(0)) + F.coalesce("change", F.lit(0))
    kept = _beside(_counted(index, "held"), changes, index.columns, n).filter("n > 0")
    return kept.select(*index.columns, F.explode(F.array_repeat(F.lit(True), F.col("n")))).select(*index.columns)


def agreement(df: DataFrame, by: str) -> DataFrame:
    """Precision and recall of ``told`` against ``truth``; null where nothing was told or true."""
    truth, told = F.col("truth"), F.col("told")
    counts = df.groupBy(by).agg(F.count_if(truth & told).alias("tp"), F.count_if(told & ~truth).alias("fp"), F.count_if(truth & ~told).alias("fn"))
    share = lambda a, b: F.round(F.col("tp") / F.nullif(F.col(a) + F.col(b), F.lit(0)), 3)
    return counts.select(by, "tp", "fp", "fn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def log_searches(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Rows of the search log: tokens, number of results and outcome of queries (query_id, text)."""
    counts = results.groupBy("query_id").agg(F.count("*").alias("result_count"))
    tokens = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    logged = queries.join(counts, "query_id", "left").withColumn("result_count", F.coalesce("result_count", F.lit(0)))
    return logged.select("query_id", "text", tokens.alias("tokens"), "result_count", F.when(F.col("result_count") == 0, "zero").otherwise("results").alias("outcome"))
