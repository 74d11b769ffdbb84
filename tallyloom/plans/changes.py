"""Change logs: latest rows, chains, merges, cursors and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.merge import Policy, merge
from tallyloom.sources.tables import after_cursor
from tallyloom.streaming.sync import superseded

from . import analogues as a
from .registry import Registry, Tables

plans = Registry()


@plans.add("q24_latest_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("m"))
    return last.select("user_id", "m.event_id", "m.event_type")


@plans.add(
    "q25_supersede_chain",
    """
SELECT event_id AS id, lead(event_id) OVER w AS superseded_by, lead(event_id) OVER w IS NULL AS is_current FROM events
WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)
""",
)
def supersede(t: Tables) -> DataFrame:
    runs = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("subject_id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at"))
    return superseded(runs).select("id", "superseded_by", "is_current")


@plans.add(
    "q26_refinement_chain",
    """
WITH c AS (SELECT user_id, event_id, event_type, lag(event_id) OVER w AS refined_from, lead(event_type) OVER w AS next_type FROM events WHERE event_type IN ('error', 'click', 'view')
           WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, refined_from, event_type = 'error' AND coalesce(next_type <> 'error', true) AS terminal FROM c
""",
)
def refinement_chain(t: Tables) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.filter(F.col("event_type").isin("error", "click", "view"))
    follows = F.lead("event_type").over(order)
    terminal = (F.col("event_type") == "error") & F.coalesce(follows != "error", F.lit(True))
    return rows.select("event_id", F.lag("event_id").over(order).alias("refined_from"), terminal.alias("terminal"))


@plans.add(
    "q28_frozen_queue",
    """
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 = 0, CASE WHEN event_id % 3 = 0 THEN event_id ELSE value END, event_id) AS INTEGER) AS place FROM events
""",
)
def frozen_queue(t: Tables) -> DataFrame:
    """A queue in the order that it had; late arrivals are appended in order of arrival."""
    late = F.col("event_id") % 3 == 0
    order = Window.partitionBy("user_id").orderBy(late, F.when(late, F.col("event_id").cast("double")).otherwise(F.col("value")), "event_id")
    return t.events.select("user_id", "event_id", F.row_number().over(order).alias("place"))


def quoted(column: str):
    return F.concat(F.lit('"'), F.col(column), F.lit('"'))


@plans.add("q29_lww_merge", f"WITH {a.WINS_SQL} SELECT row_id, arg_max('\"' || kind || '\"', seq) FILTER (WHERE wins OR base) AS note FROM w GROUP BY 1")
def lww(t: Tables) -> DataFrame:
    merged = merge(a.patches(t, note=quoted("event_type")), Policy())
    return merged.rows.select("row_id", F.element_at("row", "note").alias("note"))


def status():
    return F.when(F.col("event_type") == "view", F.lit('"open"')).when(F.col("event_type") == "click", F.lit('"closed"')).when((F.col("event_type") == "purchase") & (F.col("user_id") % 2 == 0), F.lit('"dismissed"'))


_STATUS_SQL = "CASE WHEN kind = 'view' THEN 0 WHEN kind = 'click' THEN 1 WHEN kind = 'purchase' AND row_id % 2 = 0 THEN 2 END"


@plans.add(
    "q30_ordinal_merge",
    f"""
WITH p AS ({a.PATCH_SQL}), r AS (SELECT row_id, max({_STATUS_SQL}) AS rank FROM p GROUP BY 1)
SELECT row_id, CASE rank WHEN 0 THEN '"open"' WHEN 1 THEN '"closed"' ELSE '"dismissed"' END AS status FROM r WHERE rank IS NOT NULL
""",
)
def ordinal(t: Tables) -> DataFrame:
    merged = merge(a.patches(t, status=status()), Policy(ordinal={"status": ("open", "closed", "dismissed")}))
    return merged.rows.select("row_id", F.element_at("row", "status").alias("status"))


def origin():
    return F.when(F.col("event_type") == "error", F.lit("null")).when(F.col("event_type") != "signup", quoted("event_type"))


_ORIGIN_SQL = "CASE WHEN kind = 'error' THEN 'null' WHEN kind <> 'signup' THEN '\"' || kind || '\"' END"


@plans.add(
    "q31_write_once",
    f"WITH p AS ({a.PATCH_SQL}), v AS (SELECT *, {_ORIGIN_SQL} AS v FROM p) SELECT row_id, coalesce(arg_min(v, seq) FILTER (WHERE v <> 'null'), 'null') AS origin FROM v WHERE v IS NOT NULL GROUP BY 1",
)
def write_once(t: Tables) -> DataFrame:
    merged = merge(a.patches(t, origin=origin()), Policy(write_once=("origin",)))
    return merged.rows.select("row_id", F.element_at("row", "origin").alias("origin"))


def deletion():
    return F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).when(F.col("event_type") == "signup", F.lit("null"))


_DELETION_SQL = "CASE WHEN kind = 'purchase' THEN CAST(seq AS VARCHAR) WHEN kind = 'signup' THEN 'null' END"


@plans.add(
    "q32_sticky",
    f"WITH p AS ({a.PATCH_SQL}), v AS (SELECT *, {_DELETION_SQL} AS v FROM p) SELECT row_id, coalesce(arg_min(v, seq) FILTER (WHERE v <> 'null'), 'null') AS deleted_at FROM v WHERE v IS NOT NULL GROUP BY 1",
)
def sticky(t: Tables) -> DataFrame:
    merged = merge(a.patches(t, deleted_at=deletion()), Policy())
    return merged.rows.select("row_id", F.element_at("row", "deleted_at").alias("deleted_at"))


_COUPLED = Policy(ordinal={"status": ("open", "closed", "dismissed")}, coupled=(("status", "why"),))
_COUPLED_SQL = f"""{a.WINS_SQL},
r AS (SELECT *, {_STATUS_SQL} AS rank FROM w),
h AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY row_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS high FROM r),
v AS (SELECT *, base OR CASE WHEN rank IS NULL THEN wins ELSE rank > high OR rank = high AND wins END AS accept FROM h)"""


@plans.add("q33_coupled", f"WITH {_COUPLED_SQL} SELECT row_id, arg_max(CAST(seq AS VARCHAR), seq) FILTER (WHERE accept) AS why FROM v GROUP BY 1")
def coupled(t: Tables) -> DataFrame:
    merged = merge(a.patches(t, status=status(), why=F.col("event_id").cast("string")), _COUPLED)
    return merged.rows.select("row_id", F.element_at("row", "why").alias("why"))


@plans.add(
    "q34_merge_conflicts",
    f"""
WITH {_COUPLED_SQL},
o AS (SELECT *, {_ORIGIN_SQL} AS o FROM v),
k AS (SELECT row_id, seq, base, o, CASE WHEN o <> 'null' THEN o END AS f FROM o),
f AS (SELECT row_id, seq, base, o, first_value(f IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM k)
SELECT row_id, 'ordinal' AS policy, count(*) AS n FROM v WHERE rank < high AND NOT base GROUP BY 1
UNION ALL SELECT row_id, 'write_once', count(*) FROM f WHERE NOT base AND o IS NOT NULL AND kept IS NOT NULL AND o <> kept GROUP BY 1
""",
)
def conflicts(t: Tables) -> DataFrame:
    policy = Policy(write_once=("origin",), ordinal=_COUPLED.ordinal, coupled=_COUPLED.coupled)
    merged = merge(a.patches(t, status=status(), why=F.col("event_id").cast("string"), origin=origin()), policy)
    return merged.conflicts.groupBy("row_id", "policy").agg(F.count("*").alias("n"))


@plans.add("q35_keyset_page", "SELECT event_id, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 100) ORDER BY ts, event_id LIMIT 500")
def keyset(t: Tables) -> DataFrame:
    return after_cursor(t.events.select("event_id", "ts"), F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit(100), "ts", "event_id")


@plans.add(
    "q36_outbox_pivot",
    """
SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'view') AS pending, count(*) FILTER (WHERE event_type = 'click') AS sent, count(*) FILTER (WHERE event_type = 'error') AS failed
FROM events GROUP BY 1
""",
)
def outbox_pivot(t: Tables) -> DataFrame:
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "sent").when(F.col("event_type") == "error", "failed")
    rows = t.events.select(F.to_date("ts").alias("table"), state.alias("state"))
    from tallyloom.streaming.sync import outbox_counts

    return outbox_counts(rows).withColumnRenamed("table", "day")
