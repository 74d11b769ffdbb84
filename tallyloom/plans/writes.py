"""What sessions write: the state of a table and of the outbox after several batches."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import runs, writers
from tallyloom.operators.scope import manager
from tallyloom.sources.batches import Batches
from tallyloom.sources.stages import shared_folder

from .registry import Registry, Tables

plans = Registry()

ASSET = writers.record("filename string, branch_id string, bytes long, is_published boolean, is_published_i int, upload_state string")


def written(t: Tables) -> Batches:
    """Orders as assets: all created, every third changed, every fifth moved on its own device, every seventh deleted."""
    book = Batches(t.spark, f"{shared_folder(t.spark)}/tallyloom-book-{uuid.uuid4().hex}", {"asset": ASSET, "outbox": writers.OUTBOX_TABLE})
    ticks = count(1000, 1000)
    writer = writers.Writer(book, manager("o1", "u1"), "device-1", lambda: next(ticks))
    key = F.col("o_orderkey")
    orders = t.orders.withColumn("id", F.concat(F.lit("a"), key.cast("string")))
    writer.create("made", "asset", orders.select("id", F.concat(F.lit("clip-"), "id", F.lit(".mp4")).alias("filename"), F.col("o_orderpriority").alias("branch_id"), (F.col("o_orderstatus") == "F").alias("is_published")))
    urgent = F.when(F.col("o_orderpriority") < "3", "true").otherwise("false")
    writer.patch("changed", "asset", orders.filter(key % 3 == 0).select("id", F.create_map(F.lit("is_published"), urgent, F.lit("bytes"), key.cast("string")).alias("changes")))
    writer.patch("moved", "asset", orders.filter(key % 5 == 0).select("id", F.create_map(F.lit("upload_state"), F.lit('"sent"')).alias("changes")))
    writer.soft_delete("gone", "asset", orders.filter(key % 7 == 0).select("id"))
    return book


_PUBLISHED = "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority < '3' ELSE o_orderstatus = 'F' END"


@plans.add(
    "q88_written_rows",
    f"""
SELECT 'a' || o_orderkey AS id, 'o1' AS org_id, CAST(1 + (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0)::INT + (o_orderkey % 7 = 0)::INT AS BIGINT) AS rev, CAST(1000 AS BIGINT) AS created_at,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN 4000 WHEN o_orderkey % 5 = 0 THEN 3000 WHEN o_orderkey % 3 = 0 THEN 2000 ELSE 1000 END AS BIGINT) AS updated_at,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN 4000 END AS BIGINT) AS deleted_at, 'clip-a' || o_orderkey || '.mp4' AS filename, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS BIGINT) AS bytes,
  {_PUBLISHED} AS is_published, CAST({_PUBLISHED} AS INTEGER) AS is_published_i, CASE WHEN o_orderkey % 5 = 0 THEN 'sent' END AS upload_state
FROM orders
""",
)
def written_rows(t: Tables) -> DataFrame:
    return written(t).current("asset").select("id", "org_id", "rev", "created_at", "updated_at", "deleted_at", "filename", "bytes", "is_published", "is_published_i", "upload_state")


@plans.add(
    "q89_written_outbox",
    """
WITH e AS (
  SELECT o_orderkey, 'put' AS op, 0 AS base_rev, 1000 AS queued_at, 'branch_id,created_at,deleted_at,filename,id,is_published,is_published_i,org_id,origin_device,rev,server_updated_at,updated_at' AS fields,
    CAST(o_orderstatus = 'F' AS VARCHAR) AS published, CAST(CAST(o_orderstatus = 'F' AS INTEGER) AS VARCHAR) AS mirror FROM orders
  UNION ALL SELECT o_orderkey, 'patch', 1, 2000, 'bytes,is_published,is_published_i,updated_at', CAST(o_orderpriority < '3' AS VARCHAR), CAST(CAST(o_orderpriority < '3' AS INTEGER) AS VARCHAR) FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'soft_delete', 1 + (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0)::INT, 4000, 'deleted_at,updated_at', NULL, NULL FROM orders WHERE o_orderkey % 7 = 0)
SELECT 'a' || o_orderkey AS row_id, op, CAST(base_rev AS BIGINT) AS base_rev, CAST(queued_at AS BIGINT) AS queued_at, 'pending' AS state, fields, published, mirror FROM e
""",
)
def written_outbox(t: Tables) -> DataFrame:
    """Entries of the outbox; what changed on its own device only isn't queued."""
    fields = F.array_join(F.array_sort(F.map_keys("patch")), ",").alias("fields")
    published, mirror = (F.try_element_at("patch", F.lit(f)).alias(n) for f, n in (("is_published", "published"), ("is_published_i", "mirror")))
    return written(t).current("outbox").select("row_id", "op", "base_rev", "queued_at", "state", fields, published, mirror)


ASKED = "Answer in one line.\n{{question}}"


def answered(t: Tables) -> Batches:
    """Users' turns are requests, the turns that follow are recorded answers; the second half comes when the first is known."""
    turns = t.conversations.filter("text IS NOT NULL AND turn IS NOT NULL AND conv_id IS NOT NULL")
    after = F.lead(F.struct("role", "text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = turns.withColumn("next", after).filter("role = 'user'")
    said = F.when(F.col("next.role") == "assistant", F.col("next.text"))
    rows = asked.select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("request_id"), F.to_json(F.struct("text")).alias("input"), F.create_map(F.lit("question"), "text").alias("values"), said.alias("said"), "turn")
    recorded = rows.filter("said IS NOT NULL").groupBy("input").agg(F.min_by("said", F.struct("conv_id", "turn")).alias("said"))

    def produce(prompts: DataFrame) -> DataFrame:
        return prompts.join(recorded, "input").select("cache_key", F.to_json(F.struct("said")).alias("output"), F.lit(320).cast("long").alias("latency_ms"), F.lit(None).cast("string").alias("error_code"))

    book = Batches(t.spark, f"{shared_folder(t.spark)}/tallyloom-book-{uuid.uuid4().hex}", runs.TABLES)
    call = runs.Call("search_parse", "replay", "recorded", ASKED, "1", "answer", "1", lambda x: F.length(F.get_json_object(x, "$.said")) > 20, ("question",))
    for name, some in (("first", F.col("conv_id") % 2 == 0), ("second", F.lit(True)), ("second", F.lit(True))):
        runs.run(book, name, call, rows.filter(some).withColumn("request_id", F.concat_ws(":", F.lit(name), "request_id")), produce)
    return book


@plans.add(
    "q95_recorded_runs",
    """
WITH n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WHERE text IS NOT NULL AND turn IS NOT NULL AND conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, turn, text, CASE WHEN next_role = 'assistant' THEN next_text END AS said FROM n WHERE role = 'user'),
r AS (SELECT text, arg_min(said, (conv_id, turn)) AS said FROM q WHERE said IS NOT NULL GROUP BY 1),
b AS (SELECT 'first' AS batch, * FROM q WHERE conv_id % 2 = 0 UNION ALL SELECT 'second', * FROM q)
SELECT batch || ':' || conv_id || ':' || turn AS request_id, CASE WHEN r.said IS NULL OR length(r.said) <= 20 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN r.said IS NULL THEN 'no_answer' WHEN length(r.said) <= 20 THEN 'invalid_output' END AS error_code, r.said IS NULL OR length(r.said) > 20 AS schema_valid, r.said AS said, 'query' AS subject_type, 'replay:recorded' AS model_key, 'recorded' AS model_id, 'simulated' AS latency_source
FROM b LEFT JOIN r USING (text)
""",
)
def recorded_runs(t: Tables) -> DataFrame:
    """What each request came to, taken from the memo or produced."""
    said = F.get_json_object("output", "$.said").alias("said")
    return answered(t).current("ai_run").select("request_id", "status", "error_code", "schema_valid", said, "subject_type", "model_key", "model_id", "latency_source")


@plans.add(
    "q96_run_memo",
    """
WITH n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WHERE text IS NOT NULL AND turn IS NOT NULL AND conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, turn, text, CASE WHEN next_role = 'assistant' THEN next_text END AS said FROM n WHERE role = 'user')
SELECT arg_min(said, (conv_id, turn)) AS said, 1 AS n FROM (SELECT text, said, conv_id, turn FROM q WHERE said IS NOT NULL) GROUP BY text HAVING length(arg_min(said, (conv_id, turn))) > 20
""",
)
def run_memo(t: Tables) -> DataFrame:
    """One row for each distinct input that has a valid answer, however often it was asked."""
    memo = answered(t).read("memo").groupBy("cache_key").agg(F.first("output").alias("output"), F.count("*").cast("int").alias("n"))
    return memo.select(F.get_json_object("output", "$.said").alias("said"), "n")
