"""The tables at hand in the shapes of the operators: who is who is told once, here and in SQL.

customer: creator; orders: collab; lineitem: asset; nation: branch; events: search log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Tables

REVIEW = {"A": "approved", "R": "rejected", "N": "pending"}
OUTCOME = {"F": "completed", "O": "open", "P": "ghosted"}

REVIEW_SQL = "CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'pending' END"
OUTCOME_SQL = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'open' ELSE 'ghosted' END"


def mapped(column: str, names: dict[str, str], otherwise: str) -> Column:
    return F.coalesce(*[F.when(F.col(column) == k, v) for k, v in names.items()], F.lit(otherwise))


def review() -> Column:
    return mapped("l_returnflag", REVIEW, "pending")


def creators(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("creator_id"), (F.col("c_acctbal") < 0).alias("blocked"))


def collabs(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("collab_id"), F.col("o_custkey").alias("creator_id"), mapped("o_orderstatus", OUTCOME, "ghosted").alias("outcome"))


def assets(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.lit("o1").alias("org_id"),
        F.col("l_orderkey").alias("collab_id"),
        F.col("l_linenumber").alias("confirmed_item_id"),
        (F.col("l_suppkey") % 25).cast("string").alias("branch_id"),
        review().alias("review_status"),
        (F.col("l_linestatus") == "F").alias("is_published"),
        F.when(F.col("l_tax") >= 0.08, 1).alias("deleted_at"),
        F.col("l_quantity").alias("internal_note"),
    )


ASSET_SQL = f"""SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_suppkey % 25 AS VARCHAR) AS branch_id, {REVIEW_SQL} AS review_status,
  l_linestatus = 'F' AS is_published, CASE WHEN l_tax >= 0.08 THEN 1 END AS deleted_at FROM lineitem"""


def failed_queries(t: Tables) -> DataFrame:
    """Searches without results, as facets."""
    room = F.concat(F.lit("room"), (F.col("user_id") % 10).cast("string"))
    shot = F.concat(F.lit("shot"), (F.col("event_id") % 3).cast("string"))
    return t.events.filter("event_type = 'error'").select(F.col("event_id").alias("query_id"), F.create_map(F.lit("room"), room, F.lit("shot"), shot).alias("facets"))


def coverage_targets(t: Tables) -> DataFrame:
    rooms = t.nation.select(F.col("n_nationkey"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("r"))
    return rooms.select(F.col("n_nationkey").cast("string").alias("branch_id"), F.concat(F.lit("room"), F.col("r").cast("string")).alias("room"), (4 + (F.col("n_nationkey") + F.col("r")) % 5).cast("long").alias("target"))


def room_assets(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_nationkey").cast("string").alias("branch_id"),
        F.concat(F.lit("room"), (F.col("c_custkey") % 10).cast("string")).alias("room"),
        (F.col("c_acctbal") > 0).alias("is_published"),
        F.when(F.col("c_mktsegment") == "BUILDING", "pending").otherwise("approved").alias("review_status"),
    )


DEFICIT_SQL = """
targets AS (SELECT CAST(n_nationkey AS VARCHAR) AS branch_id, 'room' || r AS room, CAST(4 + (n_nationkey + r) % 5 AS BIGINT) AS target
            FROM nation CROSS JOIN range(10) g(r)),
have AS (SELECT CAST(c_nationkey AS VARCHAR) AS branch_id, 'room' || (c_custkey % 10) AS room, count(*) AS have FROM customer
         WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING' GROUP BY 1, 2),
deficit AS (SELECT t.branch_id, t.room, coalesce(h.have, 0) AS have, t.target FROM targets t LEFT JOIN have h USING (branch_id, room) WHERE coalesce(h.have, 0) < t.target)"""

SCAN_SQL = f"""{DEFICIT_SQL},
asked AS (SELECT 'room=room' || (user_id % 10) || '|shot_type=shot' || (event_id % 3) AS signature, count(*) AS queries FROM events
          WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 2),
short AS (SELECT 'branch=' || branch_id || '|room=' || room AS signature, have, target FROM deficit),
cells AS (SELECT coalesce(a.signature, s.signature) AS signature, a.queries, s.have, s.target,
          least(1.0, coalesce(a.queries, 0) * 0.12 + CASE WHEN s.target IS NULL THEN 0 ELSE 0.4 * (s.target - s.have) / s.target END) AS score
          FROM asked a FULL JOIN short s USING (signature)),
scan AS (SELECT *, CASE WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.55 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS severity
         FROM cells WHERE signature NOT LIKE 'branch=3|%')"""


def dismissed(t: Tables) -> DataFrame:
    rooms = F.explode(F.sequence(F.lit(0), F.lit(9)))
    return t.nation.filter("n_nationkey = 3").select(rooms.alias("r")).select(F.concat(F.lit("branch=3|room=room"), F.col("r").cast("string")).alias("signature"))


def patches(t: Tables, **fields: Column) -> DataFrame:
    """Events as patches of their user's row; a field whose value is null isn't in the patch."""
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in fields.items()]))
    late = F.unix_millis(F.col("ts").cast("timestamp")) + (F.col("event_id") * 7919) % 172_800_000
    return t.events.select(F.col("user_id").alias("row_id"), F.col("event_id").alias("seq"), late.alias("updated_at"), F.map_from_entries(entries).alias("patch"))


PATCH_SQL = "SELECT user_id AS row_id, event_id AS seq, epoch_ms(ts) + (event_id * 7919) % 172800000 AS moment, event_type AS kind, value FROM events"
WINS_SQL = f"""p AS ({PATCH_SQL}),
w AS (SELECT *, row_number() OVER o = 1 AS base, moment >= coalesce(max(moment) OVER (PARTITION BY row_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wins
      FROM p WINDOW o AS (PARTITION BY row_id ORDER BY seq))"""
