"""Creating, patching and deleting records of a session, with what each change says to other devices.

A writer changes a table and the outbox in one batch: both are there, or neither.  It fills the
envelope (times, revision, device), keeps the numbers that mirror booleans, and queues only fields that
changed and aren't this device's own.  All of a batch's rows are written at once; a row that the session
may not write, or not see, fails the batch whole.

A batch that ran already changes nothing, so it may be run again after any failure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.operators.scope import Session, check_write, visible
from tallyloom.sources.batches import Batches
from tallyloom.sources.stages import cut
from tallyloom.sources.tables import LOCAL_ONLY

#: Booleans that have a number beside them, and fields that never leave a device.
MIRRORS = {"is_published": "is_published_i", "is_current": "is_current_i", "is_pinned": "is_pinned_i", "is_exemplar": "is_exemplar_i", "is_shared": "is_shared_i"}
LOCAL_FIELDS = {"asset": ("upload_state", "upload_offset_bytes", "media_state", "local_file_key")}

ENVELOPE = "id string, org_id string, created_at long, updated_at long, server_updated_at long, deleted_at long, rev long, origin_device string"
OUTBOX = "seq long, table string, row_id string, op string, patch map<string,string>, base_rev long, queued_at long, state string, attempts int, last_error string"


def record(fields: str) -> tuple[str, str]:
    """Schema and key of a table of records with these fields."""
    return f"{ENVELOPE}, {fields}", "id"


OUTBOX_TABLE = (OUTBOX, "seq")


def _json(name: str) -> Column:
    """A field as JSON text."""
    whole = F.to_json(F.struct(F.col(name).alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _value(text: Column, kind: str) -> Column:
    return F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v {kind}")["v"]


def _mirrored(rows: DataFrame, given: Callable[[str], Column]) -> DataFrame:
    """``rows`` with the mirror of each boolean that is set or was given."""
    pairs = {m: f for f, m in MIRRORS.items() if f in rows.columns and m in rows.columns}
    held = {m: F.when(F.col(f).isNotNull() | given(f), F.coalesce(F.col(f).cast("int"), F.lit(0))).otherwise(F.col(m)) for m, f in pairs.items()}
    return rows.withColumns(held) if held else rows


@dataclass(frozen=True)
class Writer:
    book: Batches
    session: Session
    device: str
    #: Milliseconds; one instant holds for a batch.
    clock: Callable[[], int]

    def create(self, batch: str, table: str, rows: DataFrame) -> None:
        """New rows, whole: what isn't given of the envelope is filled.  Of rows with one id one is written; an id that is there is replaced."""
        given = set(rows.columns)

        def make(now: int) -> tuple[DataFrame, DataFrame]:
            fields = self._fields(table)
            named = F.col("id") if "id" in given else F.lit(None).cast("string")
            filled = {
                "id": F.when(F.length(named) > 0, named).otherwise(F.uuid()),
                "org_id": F.coalesce(F.col("org_id") if "org_id" in given else F.lit(None), F.lit(self.session.org_id)),
                "created_at": F.coalesce(F.col("created_at") if "created_at" in given else F.lit(None), F.lit(now)).cast("long"),
                "updated_at": F.lit(now).cast("long"), "server_updated_at": F.lit(None).cast("long"), "deleted_at": F.lit(None).cast("long"),
                "rev": F.lit(1).cast("long"), "origin_device": F.lit(self.device),
            }
            whole = rows.withColumns(filled)
            whole = whole.select(*[(F.col(f.name) if f.name in whole.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
            whole = cut(check_write(self.session, table, _mirrored(whole, lambda f: F.lit(f in given))).dropDuplicates(["id"]))
            said = [f.name for f in fields if f.name in given | set(filled) | {m for f, m in MIRRORS.items() if f in given}]
            patch = F.map_from_arrays(F.array(*map(F.lit, said)), F.array(*map(_json, said)))
            return whole, whole.select(F.col("id").alias("row_id"), F.lit("put").alias("op"), patch.alias("patch"), F.lit(0).cast("long").alias("base_rev"))

        self._write(batch, table, make)

    def patch(self, batch: str, table: str, changes: DataFrame) -> None:
        """``changes`` (id, changes: map of field to JSON text) on rows that are there and seen; others fail the batch."""

        def make(now: int) -> tuple[DataFrame, DataFrame]:
            asked = changes.groupBy("id").agg(F.first("changes").alias("_changes"))
            found = asked.join(self._present(table), "id", "left")
            seen = F.when(~F.coalesce("_there", F.lit(False)), F.raise_error(F.concat(F.lit(f"patch: {table}/"), "id", F.lit(" does not exist"))).cast("boolean"))
            seen = seen.when(~visible(self.session, table, found), F.raise_error(F.concat(F.lit(f"patch: {table}/"), "id", F.lit(" is not visible to this session"))).cast("boolean"))
            found = found.filter(seen.otherwise(True)).withColumn("_base", F.coalesce("rev", F.lit(0)).cast("long"))
            fixed = {"id", "updated_at", "rev", "origin_device"}
            taken = {f.name: F.when(F.map_contains_key("_changes", f.name), _value(F.col("_changes")[f.name], f.dataType.simpleString())).otherwise(F.col(f.name)) for f in self._fields(table) if f.name not in fixed}
            merged = found.withColumns(taken | self._touched(now))
            merged = cut(check_write(self.session, table, _mirrored(merged, lambda f: F.map_contains_key("_changes", f))))
            own = LOCAL_FIELDS.get(table, ())
            told = F.map_filter("_changes", lambda k, _: ~k.isin([*own, "id", "updated_at"]))
            implied = [F.when(F.map_contains_key("_changes", f), F.create_map(F.lit(m), F.col(m).cast("string"))).otherwise(F.create_map().cast("map<string,string>")) for f, m in MIRRORS.items() if f in merged.columns and m in merged.columns]
            whole = F.map_concat(F.map_filter(told, lambda k, _: ~k.isin(list(MIRRORS.values()))), *implied)
            entries = merged.withColumn("_told", whole).filter(F.size("_told") > 0)
            patch = F.map_concat("_told", F.create_map(F.lit("updated_at"), F.lit(str(now))))
            return merged, entries.select(F.col("id").alias("row_id"), F.lit("patch").alias("op"), patch.alias("patch"), F.col("_base").alias("base_rev"))

        self._write(batch, table, make)

    def soft_delete(self, batch: str, table: str, ids: DataFrame) -> None:
        """Tombstones for rows of ``ids`` (id) that are there; a row that isn't seen fails the batch."""

        def make(now: int) -> tuple[DataFrame, DataFrame]:
            found = ids.select("id").distinct().join(self._present(table), "id")
            seen = F.when(~visible(self.session, table, found), F.raise_error(F.concat(F.lit(f"softDelete: {table}/"), "id", F.lit(" is not visible to this session"))).cast("boolean"))
            found = found.filter(seen.otherwise(True)).withColumn("_base", F.coalesce("rev", F.lit(0)).cast("long"))
            merged = cut(found.withColumns(self._touched(now) | {"deleted_at": F.lit(now).cast("long")}))
            patch = F.create_map(F.lit("deleted_at"), F.lit(str(now)), F.lit("updated_at"), F.lit(str(now)))
            return merged, merged.select(F.col("id").alias("row_id"), F.lit("soft_delete").alias("op"), patch.alias("patch"), F.col("_base").alias("base_rev"))

        self._write(batch, table, make)

    def _fields(self, table: str) -> StructType:
        return self.book.spark.createDataFrame([], self.book.tables[table][0]).schema

    def _present(self, table: str) -> DataFrame:
        return self.book.current(table).withColumn("_there", F.lit(True))

    def _touched(self, now: int) -> dict[str, Column]:
        return {"updated_at": F.lit(now).cast("long"), "rev": (F.coalesce("rev", F.lit(0)) + 1).cast("long"), "origin_device": F.lit(self.device)}

    def _write(self, batch: str, table: str, make: Callable[[int], tuple[DataFrame, DataFrame]]) -> None:
        if table not in self.book.tables:
            raise KeyError(table)
        check_write(self.session, table, self.book.spark.createDataFrame([], self.book.tables[table][0]))
        if self.book.has(batch):
            return
        now = self.clock()
        rows, said = make(now)
        n, last = self.book.next_number()
        self.book.stage(batch, n, table, rows)
        if table in LOCAL_ONLY:
            self.book.publish(batch, n, [table], last)
            return
        own = LOCAL_FIELDS.get(table, ())
        entries = said.withColumns({
            "table": F.lit(table), "patch": F.map_filter("patch", lambda k, _: ~k.isin(list(own))), "queued_at": F.lit(now).cast("long"),
            "state": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(None).cast("string"),
        })
        numbered, count = _numbered(entries, last)
        self.book.stage(batch, n, "outbox", numbered)
        self.book.publish(batch, n, [table, "outbox"], last + count)


def _numbered(entries: DataFrame, last: int) -> tuple[DataFrame, int]:
    """``entries`` with ``seq`` from ``last`` + 1 on, without gaps, and how many there are."""
    placed = cut(entries.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())  # a row for each partition
    starts, total = [], 0
    for p, held in counts:
        starts.append((p, total))
        total += held
    offsets = entries.sparkSession.createDataFrame(starts, "part long, start long")
    seq = F.lit(last + 1) + F.col("start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("seq", seq), total  # a row for each partition
