"""Several tables changed together: staged Parquet folders, and one manifest that makes a batch count.

A batch stages the rows it changes in each table, in folders named after it, and then puts one
small manifest in place under the next number.  Readers see the folders that manifests name, so what a
killed job has staged is nowhere, in no table; the same batch run again stages it anew.  A batch
that is committed already isn't run again.  Of two writers that take one number the second fails.

Written bytes grow with what a batch changes.  ``compact`` writes a table's present rows once, and
readers begin there.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "batch string, n long, tables array<string>, bases array<string>, last_seq long"


class Batches:
    """``tables``: each one's schema, and its key; without a key every row counts (a log)."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, str | None]]) -> None:
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def committed(self) -> list[Row]:
        """The manifests in order, one for each batch."""
        where = self._path("_batches")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return []
        return sorted(self.spark.read.schema(_MANIFEST).json(f"{self.folder}/_batches/[0-9]*.json").collect(), key=lambda r: r["n"])

    def has(self, batch: str) -> bool:
        return any(r["batch"] == batch for r in self.committed())

    def stage(self, batch: str, n: int, table: str, rows: DataFrame) -> DataFrame:
        """``rows`` written for a batch that will have the number ``n``, and read again."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a name for a batch: {batch}")
        schema = self.tables[table][0]
        path = f"{self.folder}/{table}/{batch}"
        names = self.spark.createDataFrame([], schema).columns
        rows.select(*names, F.lit(n).cast("long").alias("_batch")).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(f"{schema}, _batch long").parquet(path)

    def publish(self, batch: str, n: int, tables: list[str], last_seq: int, bases: list[str] | None = None) -> None:
        """Makes what was staged count, all of it at once."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        text = json.dumps({"batch": batch, "n": n, "tables": tables, "bases": bases or [], "last_seq": last_seq})
        draft, final = self._path("_batches", f".{uuid.uuid4().hex}"), self._path("_batches", f"{n:012d}.json")
        files = draft.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = files.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(draft, final, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))  # fails where the number is taken

    def read(self, table: str) -> DataFrame:
        """All rows that committed batches hold of a table since its last compaction, with ``_batch``."""
        made = [r for r in self.committed() if table in r["tables"]]
        start = max((i for i, r in enumerate(made) if table in r["bases"]), default=0)
        schema = f"{self.tables[table][0]}, _batch long"
        paths = [f"{self.folder}/{table}/{r['batch']}" for r in made[start:]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self, table: str) -> DataFrame:
        """The last row of each key."""
        rows, key = self.read(table), self.tables[table][1]
        if key is None:
            return rows.drop("_batch")
        fields = F.struct(*[c for c in rows.columns if c != "_batch"])
        return rows.groupBy(key).agg(F.max_by(fields, "_batch").alias("_row")).select("_row.*")

    def next_number(self) -> tuple[int, int]:
        """The next batch's number and the last number of an entry."""
        last = self.committed()[-1:]
        return (last[0]["n"] + 1, last[0]["last_seq"]) if last else (0, 0)

    def commit(self, batch: str, changes: dict[str, DataFrame]) -> bool:
        """Whether ``changes`` were written now; not so if the batch was there already."""
        if self.has(batch):
            return False
        n, last_seq = self.next_number()
        for table, rows in changes.items():
            self.stage(batch, n, table, rows)
        self.publish(batch, n, list(changes), last_seq)
        return True

    def compact(self, table: str) -> None:
        """Writes a table's present rows as one folder that readers begin with; older folders may go once no reader holds them."""
        n, last_seq = self.next_number()
        batch = f"base-{n}"
        self.stage(batch, n, table, self.current(table))
        self.publish(batch, n, [table], last_seq, [table])
