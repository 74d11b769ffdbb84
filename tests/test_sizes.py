"""Sizes of pages as their SQL prints them."""

import duckdb
from pyspark.sql import functions as F

from tallyloom.functions.scalars import bytes_text
from tallyloom.plans import catalogue


def test_sizes_of_pages(spark, tmp_path):
    sizes = [None, 0, 1023, 1024, 1280, 1792, 2304, 3328, 1_048_575, 1_048_576, 3_000_000]
    rows = [(i, None if i == 1 else f"https://a.example/en/x?page={i}", None if n is None else "x" * n) for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.execute(catalogue.oracle_sql()["q49_parse_regex"]).fetchall()
    assert sorted(map(tuple, catalogue.queries()["q49_parse_regex"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_no_size_is_null(spark):
    assert spark.range(1).select(bytes_text(F.lit(None).cast("int")).alias("s")).first()["s"] is None
