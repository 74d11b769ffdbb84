"""Draining a change log and pulling by cursor, in batch and as Structured Streaming over the same functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.merge import Merged, Policy, merge
from tallyloom.sources.batches import Batches
from tallyloom.sources.stages import cut
from tallyloom.sources.tables import upsert


def pending(outbox: DataFrame) -> DataFrame:
    return outbox.filter(F.col("state") == "pending").orderBy("seq")


def apply_batch(rows: DataFrame, patches: DataFrame, policy: Policy) -> Merged:
    """Current rows (row_id, row) with a batch of patches (row_id, seq, updated_at, patch) merged on.

    The current row is each row's first patch; rows without patches aren't touched.
    """
    touched = rows.join(patches.select("row_id").distinct(), "row_id", "left_semi")
    base = touched.select("row_id", F.lit(-1).cast("long").alias("seq"), F.try_element_at("row", F.lit("updated_at")).cast("long").alias("updated_at"), F.col("row").alias("patch"))
    return merge(base.unionByName(patches.select("row_id", F.col("seq").cast("long").alias("seq"), "updated_at", "patch")), policy)


def stamped(before: DataFrame, after: DataFrame, tick: int) -> DataFrame:
    """Rows that did change, with the receiving side's time and their next revision."""
    joined = after.join(before.select("row_id", F.col("row").alias("old"), F.col("rev").alias("old_rev")), "row_id", "left")
    same = F.coalesce(F.array_sort(F.map_entries("row")) == F.array_sort(F.map_entries("old")), F.lit(False))
    return joined.filter(~same).select("row_id", "row", (F.coalesce("old_rev", F.lit(0)) + 1).cast("long").alias("rev"), F.lit(tick).cast("long").alias("server_updated_at"))


def next_tick(previous: int, now_ms: int) -> int:
    """Later than before, whatever the clock says."""
    return max(previous + 1, now_ms)


def delivery_state(outbox: DataFrame, delivered: DataFrame) -> DataFrame:
    """The outbox after a push: sent, or failed with its error, and one attempt more."""
    joined = outbox.join(delivered.select("seq", F.col("error").alias("_error"), F.lit(True).alias("_tried")), "seq", "left")
    state = F.when(F.col("_tried") & F.col("_error").isNull(), "sent").when(F.col("_tried"), "failed").otherwise(F.col("state"))
    kept = [c for c in outbox.columns if c not in ("state", "attempts", "last_error")]
    return joined.select(*kept, state.alias("state"), (F.col("attempts") + F.coalesce("_tried", F.lit(False)).cast("int")).alias("attempts"), F.coalesce("_error", F.when(F.col("_tried").isNull(), F.col("last_error"))).alias("last_error"))


#: What a drained change log becomes: rows by id, conflicts, and the outcome of each entry.
DRAINED = {
    "rows": ("row_id string, row map<string,string>, rev long, server_updated_at long", "row_id"),
    "conflicts": ("row_id string, seq long, fields array<string>, policy string, kept string, refused string", None),
    "entries": ("seq long, error string", "seq"),
}
#: Batches after which the rows are written as one folder again.
COMPACTED = 32


def entry_error() -> Column:
    """Why an entry (row_id, patch) can't be applied; null if it can."""
    torn = F.filter(F.map_keys("patch"), lambda k: F.try_parse_json(F.coalesce(F.col("patch")[k], F.lit(""))).isNull())
    return F.when(F.col("row_id").isNull(), "no row").when(F.col("patch").isNull(), "no patch").when(F.size(torn) > 0, F.concat(F.lit("not JSON: "), F.array_join(F.array_sort(torn), ", ")))


def drain(source: DataFrame, spark: SparkSession, folder: str, policy: Policy, checkpoint: str, clock) -> StreamingQuery:
    """A streaming query that merges patches (row_id, seq, updated_at, patch) on the tables DRAINED in ``folder``.

    Each micro-batch is one commit of the rows that changed, their conflicts and what became of each entry, so
    written bytes grow with the changes; every COMPACTED batches the rows are written whole.  A batch that is
    replayed is there already.  An entry that can't be applied fails alone.  ``clock`` gives
    milliseconds; a batch has one instant, later than any before it.
    """
    book = Batches(spark, folder, DRAINED)

    def step(batch: DataFrame, epoch: int) -> None:
        name = f"epoch-{epoch}"
        if book.has(name):
            return
        n, last = book.next_number()
        tick = next_tick(last, clock())
        judged = cut(batch.withColumn("error", entry_error()))
        good = judged.filter("error IS NULL").drop("error")
        before = book.current("rows").join(good.select("row_id").distinct(), "row_id", "left_semi")
        merged = apply_batch(before.select("row_id", "row"), good, policy)
        book.stage(name, n, "rows", stamped(before, merged.rows, tick))
        book.stage(name, n, "conflicts", merged.conflicts)
        book.stage(name, n, "entries", judged.select("seq", "error"))
        book.publish(name, n, list(DRAINED), tick)
        if n % COMPACTED == COMPACTED - 1:
            book.compact("rows")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pulled(rows: DataFrame, cursor: DataFrame) -> DataFrame:
    """Rows after each table's cursor: (table, server_updated_at, row_id) strictly behind it."""
    joined = rows.join(cursor.select("table", F.col("server_updated_at").alias("_at"), F.col("row_id").alias("_id")), "table", "left")
    later = F.col("_at").isNull() | (F.col("server_updated_at") > F.col("_at")) | ((F.col("server_updated_at") == F.col("_at")) & (F.col("row_id") > F.col("_id")))
    return joined.filter(later).drop("_at", "_id")


def advanced(cursor: DataFrame, page: DataFrame) -> DataFrame:
    """The cursor after a page: of each table the last row's time and id."""
    last = page.groupBy("table").agg(F.max(F.struct("server_updated_at", "row_id")).alias("m")).select("table", "m.server_updated_at", "m.row_id")
    return upsert(cursor, last, "table")


def outbox_counts(outbox: DataFrame) -> DataFrame:
    """(table, pending, sent, failed)"""
    return outbox.groupBy("table").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "sent", "failed")])


def superseded(runs: DataFrame) -> DataFrame:
    """Runs with the run that took each one's place; the current one has none."""
    order = Window.partitionBy("subject_id", "kind").orderBy("created_at", "id")
    later = F.lead("id").over(order)
    return runs.select("*", later.alias("superseded_by"), later.isNull().alias("is_current"))


def review_sessions(versions: DataFrame) -> DataFrame:
    """Versions (session_id, cursor_index, skipped, completed_at) from several devices as one row each.

    Cursors never go back, what one device skipped is skipped, and the first completion stays.
    """
    return versions.groupBy("session_id").agg(
        F.max("cursor_index").alias("cursor_index"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("skipped")))).alias("skipped"), F.min("completed_at").alias("completed_at")
    )


def rebuilt(runs: DataFrame, fields: list[str]) -> DataFrame:
    """Derived fields of each subject from the log of runs (subject_id, kind, created_at, id): those of the current run."""
    return superseded(runs).filter("is_current").select("subject_id", "kind", *fields)
