"""Quality rules: measures against a loop, SQL, and what the table keeps."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import quality
from tallyloom.llm.common import table
from tallyloom.llm.quality import Rule, judged

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = [" ".join(rng.choice("a b c dd é".split()) for _ in range(rng.randrange(40))) for _ in range(150)]
    made += ["\n".join(rng.choice(["x y", "x y ", "", " \t", "z z z z"]) for _ in range(rng.randrange(9))) for _ in range(60)]
    return [None, "", " \n\t ", "a", "a b", "a b c", "a a a a", "a b c a b c", "one\n\n\none\none ", "a b   c\x0bd", "#*$%&|<> @", "🙂 🙂🙂", "w " * 50_000, *made]


def test_measures_equal_a_loop(spark, texts):
    got = {r["doc_id"]: r for r in judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(text), repr(text)[:80]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_equals_sql(spark):
    got = quality.op12_quality_rules(spark, DATA).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(quality.ORACLE_SQL).df()
    order = ["doc_id", "n_words"]
    assert got.sort_values(order).values.tolist() == want[got.columns].sort_values(order).values.tolist()


def test_clean_documents_stay_and_junk_goes(spark):
    told = judged(table(spark, DATA, "documents")).filter(~F.col("base_failed")).join(table(spark, DATA, "labels"), "doc_id")
    shares = {r["quality"]: r["share"] for r in told.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert shares[1] == 1.0
    assert shares[0] == 0.0


def test_any_table_of_rules(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, ""), (4, "A! B!")], "doc_id long, text string")
    rules = (Rule("long", "n_words", most=2), Rule("half", "n_letter_words", of="n_words", least=50))
    got = {r["doc_id"]: (r["broken"], r["kept"], r["base_failed"]) for r in judged(df, rules, base=()).collect()}
    assert got == {1: ("long", False, False), 2: ("", True, False), 3: ("", True, False), 4: ("", True, False)}


def test_odd_inputs(spark):
    df = spark.createDataFrame([(None, None), (1, "x"), (1, "x")], "doc_id long, text string")
    clash = df.select("*", *(F.lit("mine").alias(c) for c in ("n_words", "kept", "broken", "_qr", "base_failed")))
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in judged(clash).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert judged(df.limit(0)).collect() == []


def test_no_python_and_no_shuffle(spark):
    plan = quality.op12_quality_rules(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow", plan)
