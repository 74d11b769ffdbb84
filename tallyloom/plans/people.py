"""Rosters, scopes, gaps, briefs and triage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import cell_signature, rate
from tallyloom.operators import boards, loop
from tallyloom.operators.scope import editor, manager, scoped_view

from . import analogues as a
from .registry import Registry, Tables

plans = Registry()


@plans.add(
    "q01_scorecard_roster",
    """
WITH foot AS (SELECT l_orderkey, count(*) AS footage, count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) AS ruled, count(*) FILTER (WHERE l_returnflag = 'A') AS approved
              FROM lineitem GROUP BY 1),
kept AS (SELECT i.l_orderkey, count(*) AS promised, count(m.l_linenumber) AS delivered
         FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F') i
         LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A') m ON m.l_orderkey = i.l_orderkey AND m.l_linenumber = i.l_linenumber GROUP BY 1),
per AS (SELECT o_custkey, coalesce(sum(ruled), 0) AS ruled, coalesce(sum(approved), 0) AS approved, coalesce(sum(promised), 0) AS promised, coalesce(sum(delivered), 0) AS delivered,
        count(*) FILTER (WHERE o_orderstatus = 'F' AND coalesce(footage, 0) > 0) AS completed,
        count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderstatus = 'F' AND coalesce(footage, 0) = 0) AS ghosted
        FROM orders LEFT JOIN foot ON foot.l_orderkey = o_orderkey LEFT JOIN kept ON kept.l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey AS creator_id, c_acctbal < 0 AS blocked, CAST(coalesce(ruled, 0) AS BIGINT) AS ruled, CAST(coalesce(approved, 0) AS BIGINT) AS approved,
  CAST(coalesce(promised, 0) AS BIGINT) AS promised, CAST(coalesce(delivered, 0) AS BIGINT) AS delivered, coalesce(completed, 0) AS completed, coalesce(ghosted, 0) AS ghosted,
  round(approved / nullif(ruled, 0), 3) AS approval_rate, round(delivered / nullif(promised, 0), 3) AS promise_kept_rate,
  CAST(row_number() OVER (ORDER BY c_acctbal < 0, round(approved / nullif(ruled, 0), 3) IS NULL, round(approved / nullif(ruled, 0), 3) DESC, c_custkey) AS INTEGER) AS place
FROM customer LEFT JOIN per ON o_custkey = c_custkey
QUALIFY place <= 100
""",
)
def scorecard_roster(t: Tables) -> DataFrame:
    items = t.lineitem.filter("l_linestatus = 'F'").select(F.col("l_linenumber").alias("item_id"), F.col("l_orderkey").alias("collab_id")).distinct()
    cards = boards.scorecards(a.creators(t), a.collabs(t), a.assets(t), items)
    top = boards.roster(cards.withColumn("score", F.col("approval_rate")), 100)  # the report's first page
    order = [F.col("blocked").asc(), F.col("score").isNull().asc(), F.desc("score"), F.col("creator_id").asc()]
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("score")


@plans.add(
    "q02_drift_flags",
    """
WITH s AS (SELECT l_orderkey, round(count(*) FILTER (WHERE l_returnflag = 'A') / nullif(count(*) FILTER (WHERE l_returnflag <> 'N'), 0), 3) AS computed FROM lineitem GROUP BY 1)
SELECT o_orderkey AS collab_id, CASE WHEN o_orderstatus <> 'O' THEN 0.5 END AS stored, computed,
  CASE WHEN o_orderstatus = 'O' OR computed IS NULL THEN (o_orderstatus = 'O') <> (computed IS NULL) ELSE abs(0.5 - computed) > 0.0015 END AS drifted
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey
""",
)
def drift_flags(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("yes"), F.count_if(F.col("l_returnflag") != "N").alias("ruled"))
    stored = F.when(F.col("o_orderstatus") != "O", 0.5)
    joined = t.orders.join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("collab_id"), stored.alias("stored"), rate("yes", "ruled").alias("computed"))
    return joined.withColumn("drifted", boards.differs(F.col("stored"), F.col("computed")))


@plans.add("q03_scoped_view_manager", f"SELECT id, branch_id, review_status FROM ({a.ASSET_SQL}) WHERE deleted_at IS NULL AND branch_id IN ('0', '1', '2') AND review_status = 'pending'")
def scoped_manager(t: Tables) -> DataFrame:
    view = scoped_view(manager("o1", "u1", ["0", "1", "2"]), "asset", a.assets(t), F.col("review_status") == "pending")
    return view.select("id", "branch_id", "review_status")


@plans.add("q04_scoped_view_editor", f"SELECT id, branch_id, review_status, is_published FROM ({a.ASSET_SQL}) WHERE deleted_at IS NULL AND is_published AND review_status = 'approved'")
def scoped_editor(t: Tables) -> DataFrame:
    return scoped_view(editor("o1", "u1"), "asset", a.assets(t).drop("org_id"))


@plans.add(
    "q05_branch_scope",
    """
SELECT 'all' AS scope, CAST(n_nationkey AS VARCHAR) AS branch_id, n_name AS name FROM nation
UNION ALL SELECT 'some', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE n_nationkey IN (1, 7, 24)
""",
)
def branch_scope(t: Tables) -> DataFrame:
    branches = t.nation.select(F.col("n_nationkey").cast("string").alias("branch_id"), F.col("n_name").alias("name"))
    seen = lambda name, scope: scoped_view(manager("o1", "u1", scope), "branch", branches).select(F.lit(name).alias("scope"), "branch_id", "name")
    return seen("all", None).unionByName(seen("some", ["1", "7", "24"]))


@plans.add("q06_tombstone_filter", "SELECT event_type, count(*) AS n FROM events WHERE NOT coalesce(value < 10, false) GROUP BY 1")
def tombstones(t: Tables) -> DataFrame:
    rows = t.events.withColumn("deleted_at", F.when(F.col("value") < 10, F.col("ts")))
    return scoped_view(manager("o1", "u1"), "usage_event", rows).groupBy("event_type").agg(F.count("*").alias("n"))


@plans.add("q07_coverage_deficit", f"WITH {a.DEFICIT_SQL} SELECT branch_id, room, have, target, round(0.4 * (target - have) / target, 4) AS score FROM deficit")
def coverage_deficit(t: Tables) -> DataFrame:
    found = loop.coverage_deficits(a.coverage_targets(t), a.room_assets(t))
    return found.withColumn("score", F.round(loop.gap_score(F.lit(0), F.col("have"), F.col("target")), 4))


@plans.add("q08_zero_result_clusters", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2")
def zero_result_clusters(t: Tables) -> DataFrame:
    return loop.frequent(t.events.filter("event_type = 'error'").select("user_id", F.to_date("ts").alias("day")), ["user_id", "day"])


@plans.add("q10_gap_scan", f"WITH {a.SCAN_SQL} SELECT signature, queries, have, target, round(score, 4) AS score, severity FROM scan")
def gap_scan(t: Tables) -> DataFrame:
    scan = loop.gap_scan(a.failed_queries(t), a.coverage_targets(t), a.room_assets(t), a.dismissed(t))
    return scan.select("signature", "queries", "have", "target", F.round("score", 4).alias("score"), "severity")


@plans.add(
    "q11_gap_upsert",
    f"""
WITH {a.SCAN_SQL},
open AS (SELECT 'branch=' || branch_id || '|room=' || room AS signature, 'gap-' || branch_id || '-' || room AS gap_id FROM targets WHERE CAST(branch_id AS INTEGER) % 2 = 0)
SELECT s.signature, o.gap_id, s.severity, CASE WHEN o.gap_id IS NULL THEN 'insert' ELSE 'refresh' END AS action FROM scan s LEFT JOIN open o USING (signature)
""",
)
def gap_upsert(t: Tables) -> DataFrame:
    scan = loop.gap_scan(a.failed_queries(t), a.coverage_targets(t), a.room_assets(t), a.dismissed(t))
    facets = F.create_map(F.lit("room"), F.col("room"), F.lit("branch"), F.col("branch_id"))
    status = F.when(F.col("branch_id").cast("int") % 2 == 0, "open").otherwise("closed")
    gaps = a.coverage_targets(t).select(cell_signature(facets).alias("signature"), F.concat_ws("-", F.lit("gap"), "branch_id", "room").alias("gap_id"), status.alias("status"))
    return loop.upserted(scan, gaps, "scan-1").select("signature", "gap_id", "severity", "action")


@plans.add(
    "q12_tiered_topk",
    """
WITH r AS (SELECT o_custkey, o_orderkey AS id, o_orderpriority = '1-URGENT' AS requested, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, o_totalprice DESC, o_orderkey) AS seq,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') OVER (PARTITION BY o_custkey) AS asked FROM orders)
SELECT o_custkey, id, requested, CAST(seq AS INTEGER) AS seq FROM r WHERE seq <= greatest(3, asked)
""",
)
def tiered_topk(t: Tables) -> DataFrame:
    gaps = t.orders.select("o_custkey", F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") == "1-URGENT").alias("requested"), F.col("o_totalprice").alias("score"))
    return loop.tiered_top(gaps, 3, ["o_custkey"]).select("o_custkey", "id", "requested", "seq")


@plans.add(
    "q13_close_detection",
    """
WITH gaps AS (SELECT p_partkey AS gap_id, p_brand, CAST(p_size AS VARCHAR) AS size, 1 + p_partkey % 3 AS target FROM part),
human AS (SELECT s_suppkey * 19 AS gap_id, count(DISTINCT l_orderkey * 10 + l_linenumber) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey
          WHERE l_returnflag = 'A' GROUP BY 1),
closed AS (SELECT g.gap_id, 'confirmed' AS path, h.n FROM gaps g JOIN human h USING (gap_id)),
model AS (SELECT g.gap_id, g.target, count(*) AS n FROM gaps g JOIN part p ON p.p_brand = g.p_brand AND CAST(p.p_size AS VARCHAR) = g.size
          WHERE g.gap_id NOT IN (SELECT gap_id FROM closed) GROUP BY 1, 2)
SELECT * FROM closed UNION ALL SELECT gap_id, 'matched', n FROM model WHERE n >= target
""",
)
def close_detection(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    gaps = t.part.select(F.col("p_partkey").alias("gap_id"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), size).alias("facets"), (1 + F.col("p_partkey") % 3).alias("target"))
    items = t.supplier.select(F.col("s_suppkey").alias("item_id"), (F.col("s_suppkey") * 19).alias("origin_gap_id"))
    confirmed = t.lineitem.filter("l_returnflag = 'A'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("item_id"))
    long = F.explode(F.array(F.struct(F.lit("brand").alias("facet"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("facet"), size.alias("value"))))
    facets = t.part.select(F.col("p_partkey").alias("id"), long.alias("x")).select("id", "x.facet", "x.value")
    return loop.closures(gaps, items, confirmed, facets)


@plans.add(
    "q14_cell_signature",
    "SELECT 'brand=' || p_brand || '|shot_type=' || p_size || '|type=' || p_type AS signature, count(*) AS n FROM part GROUP BY 1",
)
def signatures(t: Tables) -> DataFrame:
    facets = F.create_map(F.lit("type"), F.col("p_type"), F.lit("shot"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return t.part.groupBy(cell_signature(facets).alias("signature")).agg(F.count("*").alias("n"))


@plans.add(
    "q15_facet_counts",
    """
SELECT 'flag' AS facet, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'status', l_linestatus, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'line', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2
""",
)
def facet_counts(t: Tables) -> DataFrame:
    # one pass: partial counts are taken per facet before anything moves
    long = t.lineitem.select(F.expr("stack(3, 'flag', l_returnflag, 'status', l_linestatus, 'line', CAST(l_linenumber AS STRING)) AS (facet, value)"))
    return long.groupBy("facet", "value").agg(F.count("*").alias("n"))


@plans.add(
    "q21_triage_bucket",
    """
SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R' AND l_quantity > 45) THEN 'blocked' WHEN bool_or(l_returnflag = 'N' AND l_linestatus = 'F') THEN 'review'
  WHEN bool_or(l_linestatus = 'O') THEN 'waiting' ELSE 'done' END AS bucket, count(*) AS n_items FROM lineitem GROUP BY 1
""",
)
def triage(t: Tables) -> DataFrame:
    states = t.lineitem.select(
        "l_orderkey",
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("blocked"),
        ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")).alias("reviewable"),
        (F.col("l_linestatus") == "O").alias("pending"),
    )
    return boards.triaged(states, "l_orderkey")


@plans.add(
    "q22_promise_diff",
    """
WITH items AS (SELECT o_orderkey AS collab_id, CAST(i AS INTEGER) AS item_id FROM orders CROSS JOIN range(1, 5) g(i)),
hits AS (SELECT l_orderkey AS collab_id, l_linenumber AS item_id, l_linenumber AS asset_id FROM lineitem WHERE l_returnflag = 'A'
         UNION ALL SELECT l_orderkey, l_linenumber + 1, l_linenumber FROM lineitem WHERE l_returnflag = 'N'),
n AS (SELECT collab_id, item_id, count(DISTINCT asset_id) AS hits FROM hits GROUP BY 1, 2),
w AS (SELECT l_orderkey AS collab_id, count(*) FILTER (WHERE l_tax > 0.06 AND l_returnflag <> 'R') AS awaiting FROM lineitem GROUP BY 1),
d AS (SELECT i.collab_id, i.item_id, CASE WHEN hits > 1 THEN 'over_claimed' WHEN hits = 1 THEN 'met' WHEN coalesce(awaiting, 0) > 0 THEN 'indeterminate' ELSE 'missing' END AS state
      FROM items i LEFT JOIN n USING (collab_id, item_id) LEFT JOIN w USING (collab_id))
SELECT collab_id, count(*) AS promised, count(*) FILTER (WHERE state IN ('met', 'over_claimed')) AS met, count(*) FILTER (WHERE state = 'missing') AS missing,
  count(*) FILTER (WHERE state = 'indeterminate') AS indeterminate, CAST(floor(count(*) FILTER (WHERE state IN ('met', 'over_claimed')) * 100.0 / count(*) + 0.5) AS INTEGER) AS percent
FROM d GROUP BY 1
""",
)
def promise_diff(t: Tables) -> DataFrame:
    items = t.orders.select(F.col("o_orderkey").alias("collab_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("item_id"))
    flag = F.col("l_returnflag")
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("collab_id"),
        F.col("l_linenumber").alias("asset_id"),
        F.when(flag == "A", F.col("l_linenumber")).alias("confirmed_item_id"),
        F.when(flag == "N", F.col("l_linenumber") + 1).alias("matched_item_id"),
        a.review().alias("review_status"),
        F.when(F.col("l_tax") > 0.06, "none").otherwise("ready").alias("derivative_state"),
    )
    return boards.coverage(boards.delivery_diff(items, rows))


@plans.add(
    "q23_locked_else_first",
    "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderkey) = 1",
)
def locked_else_first(t: Tables) -> DataFrame:
    return boards.one_of_many(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", F.desc(F.col("o_orderstatus") == "F"), F.col("o_orderkey"))


@plans.add(
    "q38_provider_counts_zero_fill",
    "SELECT k AS event_type, count(event_id) AS n FROM (VALUES ('click'), ('live'), ('replay'), ('view')) v(k) LEFT JOIN events ON event_type = k GROUP BY 1",
)
def zero_fill(t: Tables) -> DataFrame:
    return boards.zero_filled(["click", "live", "replay", "view"], t.events, "event_type")
