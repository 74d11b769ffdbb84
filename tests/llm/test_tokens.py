import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallyloom.llm.common import materialised
from tallyloom.llm.tokens import op2_pre_token_counts, token_counts

SCHEMA = "doc_id long, text string"
ODD = [
    None, "", " ", "  ", "\n", "\n\n ", " a", "a ", "a  b", "a\n b\n", "▁", "▁▁a ▁", "<s>", "</s> <unk>", "<0x0A>", "\t", "a\tb", "　x", "日本語 テスト", "😀😀 é", "\x00a", "a\r\nb",
    "http://a.b/c?d=e", "3.14159 1,000", " \n \n", "x" * 5000, "ab " * 3000, "   ",
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def check(spark, model, texts):
    docs = materialised(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts(docs).collect()}
    assert got == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(texts)}


def test_odd_texts(spark, model):
    check(spark, model, ODD)


def test_random_texts(spark, model):
    rng = random.Random(1)
    parts = ["the", " ", "  ", "\n", "ing", "é", "▁", ".", "100", "Über", "<s>", "\t", "def f(x):\n    return", "語", "-", "'s"]
    check(spark, model, ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)])


def test_all_documents(spark, model):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op2_pre_token_counts(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(model.encode(texts[r["doc_id"]] or ""))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 4096)


def test_repeats_other_columns_and_no_documents(spark):
    rows = [(1, "a b", 5), (1, "a b", 6)]
    docs = materialised(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"))
    assert [r["n_tokens"] for r in token_counts(docs).collect()] == [2, 2]
    assert token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_input_that_changes_between_its_readings_is_refused(spark):
    shaky = spark.range(300).select("id", F.concat(F.lit("word "), F.floor(F.rand() * 1e9).cast("string")).alias("text")).withColumnRenamed("id", "doc_id")
    shaky = shaky.mapInArrow(_shaken, SCHEMA)
    with pytest.raises(Exception, match="came out differently"):
        token_counts(shaky).collect()


def _shaken(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{t} {random.random()}" for t in batch.column(1).to_pylist()])], ["doc_id", "text"])
