"""From failed searches to footage: gap scan, briefs by tiered top-k, and the detection of closed gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import cell_signature, instruction

#: Fixed values.
ZERO_RESULT_THRESHOLD = 2
QUERY_WEIGHT, DEFICIT_WEIGHT = 0.12, 0.4
SEVERITIES = ((0.8, "critical"), (0.55, "high"), (0.3, "medium"))
DAY_MS = 86_400_000


def severity(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= cut, name) for cut, name in SEVERITIES], F.lit("low"))


def gap_score(queries: Column, have: Column, target: Column) -> Column:
    deficit = F.when(target.isNotNull() & (target != 0), DEFICIT_WEIGHT * (target - have) / target).otherwise(0.0)
    return F.least(F.lit(1.0), F.coalesce(queries, F.lit(0)) * QUERY_WEIGHT + deficit)


def recent(df: DataFrame, now_ms: int, days: int) -> DataFrame:
    return df.filter(F.col("created_at") >= now_ms - days * DAY_MS)


def frequent(df: DataFrame, keys: list[str], least: int = ZERO_RESULT_THRESHOLD) -> DataFrame:
    """Groups of at least ``least`` rows, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def zero_result_cells(failed: DataFrame) -> DataFrame:
    """(signature, facets, queries) of failed queries (query_id, facets) that recur."""
    named = failed.filter(F.size("facets") > 0).select(cell_signature("facets").alias("signature"), F.col("facets").cast("map<string,string>").alias("facets"))
    return named.groupBy("signature").agg(F.any_value("facets").alias("facets"), F.count("*").alias("queries")).filter(F.col("queries") >= ZERO_RESULT_THRESHOLD)


def coverage_deficits(targets: DataFrame, assets: DataFrame) -> DataFrame:
    """(branch_id, room, have, target) where fewer approved and published assets than wanted are there."""
    live = assets.filter(F.col("is_published") & (F.col("review_status") == "approved") & F.col("room").isNotNull())
    have = live.groupBy("branch_id", "room").agg(F.count("*").alias("have"))
    return targets.join(have, ["branch_id", "room"], "left").withColumn("have", F.coalesce("have", F.lit(0))).filter(F.col("have") < F.col("target")).select("branch_id", "room", "have", "target")


def gap_scan(failed: DataFrame, targets: DataFrame, assets: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Cells of demand without supply: (signature, facets, branch_id, queries, have, target, score, severity)."""
    asked = zero_result_cells(failed)
    facets = F.create_map(F.lit("room"), F.col("room"), F.lit("branch"), F.col("branch_id").cast("string"))
    short = coverage_deficits(targets, assets).select(cell_signature(facets).alias("signature"), facets.alias("short_facets"), "have", "target")
    both = asked.join(short, "signature", "full").withColumn("facets", F.coalesce("facets", "short_facets")).drop("short_facets")
    scored = both.withColumn("score", gap_score(F.col("queries"), F.col("have"), F.col("target"))).withColumn("severity", severity(F.col("score")))
    return scored.join(dismissed.select("signature").distinct(), "signature", "left_anti").withColumn("branch_id", F.try_element_at("facets", F.lit("branch")))


def upserted(scan: DataFrame, gaps: DataFrame, scan_id: str) -> DataFrame:
    """Open gaps after a scan: those found again are refreshed, new ones are added (``action`` says which)."""
    open_ = gaps.filter(F.col("status") == "open").select("signature", "gap_id")
    joined = scan.join(open_, "signature", "left")
    return joined.select("signature", "gap_id", "score", "severity", F.lit(scan_id).alias("last_scan"), F.when(F.col("gap_id").isNull(), "insert").otherwise("refresh").alias("action"))


def tiered_top(gaps: DataFrame, k: int, partition: list[str] | None = None) -> DataFrame:
    """All requested gaps, then the best of the others: k together, or more if more were requested."""
    by = partition or []
    if not by:
        # only the best k of the others can be among them; the rest never meets in one task
        asked_for = F.coalesce("requested", F.lit(False))
        gaps = gaps.filter(asked_for).unionByName(gaps.filter(~asked_for).orderBy(F.desc("score"), "id").limit(k))
    everyone = Window.partitionBy(*by)
    order = everyone.orderBy(F.desc("requested"), F.desc("score"), "id")
    asked = F.sum(F.col("requested").cast("int")).over(everyone)
    placed = gaps.withColumn("seq", F.row_number().over(order)).withColumn("cut", F.greatest(F.lit(k), asked))
    return placed.filter(F.col("seq") <= F.col("cut")).drop("cut")


def brief_items(gaps: DataFrame, k: int) -> DataFrame:
    """A brief's items from gaps (id, facets, score, requested)."""
    return tiered_top(gaps, k).select("seq", F.col("id").alias("origin_gap_id"), instruction("facets").alias("instruction"))


def covered_cells(cells: DataFrame, assets: DataFrame) -> DataFrame:
    """(gap_id, id): assets (id, facet, value) that have every facet of a gap (gap_id, facets).

    A cover is counted, not compared pair by pair: facets and profiles meet in an equi-join.
    A gap without known facets is covered by nothing here.
    """
    named = cells.select("gap_id", _cell().alias("cell"), "facets")
    wanted = _wanted(named)
    profiles = _profiles(wanted, assets)
    met = named.select("gap_id", "cell").join(_covers(wanted, profiles.select("held").distinct()), "cell")
    return met.join(profiles, "held").select("gap_id", "id")


def _cell() -> Column:
    """One text for equal facets."""
    return F.to_json(F.array_sort(F.map_entries("facets")))


def _wanted(named: DataFrame) -> DataFrame:
    """(cell, facet, value, need) of gaps (cell, facets): a cell is looked for once, however many gaps have its facets."""
    return named.dropDuplicates(["cell"]).select("cell", F.explode("facets").alias("facet", "value"), F.size("facets").alias("need"))


def _profiles(wanted: DataFrame, assets: DataFrame) -> DataFrame:
    """(id, held) of assets: the facets that some cell wants; assets that are alike in these have one profile."""
    asked = assets.join(wanted.select("facet", "value").distinct(), ["facet", "value"], "left_semi")
    return asked.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("facet", "value"))).alias("held"))


def _covers(wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """``profiles`` (held, distinct) with each ``cell`` that they cover: cells meet profiles, however many assets have one."""
    met = profiles.select("*", F.explode("held").alias("x")).select(*profiles.columns, "x.facet", "x.value").join(wanted, ["facet", "value"])
    return met.groupBy("cell", *profiles.columns, "need").agg(F.count("*").alias("met")).filter(F.col("met") == F.col("need")).drop("need", "met")


def closures(gaps: DataFrame, items: DataFrame, confirmed: DataFrame, assets: DataFrame) -> DataFrame:
    """Gaps (gap_id, facets, target) that are closed, by people's confirmation first, else by enough covering assets.

    ``items`` (item_id, origin_gap_id), ``confirmed`` (id, item_id: approved and published),
    ``assets`` (id, facet, value of approved and published ones).  Gives (gap_id, path, n).
    """
    by_item = items.join(confirmed, "item_id").groupBy(F.col("origin_gap_id").alias("gap_id")).agg(F.count_distinct("id").alias("n"))
    human = gaps.join(by_item, "gap_id").select("gap_id", F.lit("confirmed").alias("path"), "n")
    rest = gaps.join(human.select("gap_id"), "gap_id", "left_anti")
    named = rest.withColumn("cell", _cell())
    wanted = _wanted(named)
    profiles = _profiles(wanted, assets).groupBy("held").agg(F.count("*").alias("assets"))
    counts = _covers(wanted, profiles).groupBy("cell").agg(F.sum("assets").alias("n"))
    matched = named.join(counts, "cell").filter(F.col("n") >= F.coalesce("target", F.lit(1))).select("gap_id", F.lit("matched").alias("path"), "n")
    return human.unionByName(matched)
