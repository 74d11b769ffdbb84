import shutil

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tallyloom.llm import decontamination, html, jaccard, language
from tallyloom.llm.common import materialised
from tallyloom.llm.jaccard import Likeness
from tests.llm.test_jaccard import brute

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialised(stage(spark, docs, FOLDER))
        assert docs.columns == columns, name
        after = docs.count()
        assert 0 < after and (after <= before or name == "mixing")
        before = after
    last = pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.columns == [*columns, "size", "shard", "slot"]
    assert last.count() == before


def test_planted_rows(spark, tmp_path):
    known = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    clean = " ".join(f"clean{i} the of and" for i in range(60))
    near = clean.replace("clean7 the", "changed the")
    planted = [(90001, clean, "en", "src0", 1), (90002, clean, "en", "src0", 1), (90003, near, "en", "src1", 1), (90004, f"the of and {item} the of and", "en", "src0", 1), (90005, "123 456", "en", "src0", 1), (90006, None, None, None, None)]
    docs = materialised(known.unionByName(spark.createDataFrame(planted, known.schema)))
    stages = dict(pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.collect() if r["doc_id"] > 90000}
    told = materialised(stages["language"](spark, docs, FOLDER))
    assert ids(told) == {90001, 90002, 90003, 90004}
    single = materialised(stages["near_copies"](spark, told, FOLDER))
    assert ids(single) == {90001, 90004}
    assert ids(stages["decontamination"](spark, single, FOLDER)) == {90001}


def test_empty_documents(spark, tmp_path):
    folder = tmp_path / "none"
    folder.mkdir()
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(str(folder / "documents.parquet"))
    shutil.copy(f"{FOLDER}/benchmark.parquet", folder / "benchmark.parquet")
    assert pipeline.run(spark, str(folder)).count() == 0


def test_language_fills_missing_labels_and_keeps_others(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = {r["doc_id"]: r["lang"] for r in docs.filter("lang IS NOT NULL AND length(text) > 400").limit(40).collect()}
    bare = docs.withColumn("lang", F.when(F.col("doc_id").isin(list(known)), None).otherwise(F.col("lang"))).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(1))
    told = pipeline.identify_language(spark, bare, FOLDER)
    assert told.columns == bare.columns
    got = {r["doc_id"]: r["lang"] for r in told.collect()}
    assert sum(got.get(i) == lang for i, lang in known.items()) >= 0.9 * len(known)
    assert all(got[r["doc_id"]] == r["lang"] for r in docs.filter("lang IS NOT NULL").collect() if r["doc_id"] in got and r["doc_id"] not in known)


def test_near_copies_and_leaks_are_those_of_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = {i: g for i, _, g in brute(rows, Likeness(5, 80))}
    wanted = {i for i, t in rows if groups[i] == i or not (t or "").split()}
    kept = {r["doc_id"] for r in pipeline.drop_near_copies(spark, materialised(docs), FOLDER).collect()}
    assert kept == wanted


CLASHING = "lang_pred score copies source_sizes targets _dc_key _jg_text _jg_id _lid_told _copy _mix_id _hs_text _apart_0 text_key cls LANG_PRED".split()


def test_columns_of_any_name_keep_their_values_in_every_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(150)
    names = CLASHING[:-1]  # names that differ by case alone can't stand in one frame
    mine = materialised(docs.select("*", *(F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in names)))
    for name, stage in pipeline.STAGES:
        mine = materialised(stage(spark, mine, FOLDER))
        assert mine.columns[: len(docs.columns) + len(names)] == [*docs.columns, *names], name
        rows = mine.select("doc_id", *names).collect()
        assert rows and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in names), name


def test_columns_that_an_operator_adds_are_replaced_and_others_kept(spark):
    df = spark.createDataFrame([(1, "a b", "en", 1)], "doc_id long, text string, lang string, Score int")
    told = language.predicted(df.withColumn("_lid_told", F.lit("mine")), language.fit(language.labelled_rows(df)))
    assert told.columns == ["doc_id", "text", "lang", "_lid_told", "lang_pred", "score"] and told.first()["_lid_told"] == "mine"
    sharded = pipeline.shard(spark, df.withColumn("Size", F.lit("mine")), FOLDER)
    assert sharded.columns == ["doc_id", "text", "lang", "Score", "size", "shard", "slot"] and sharded.first()["size"] == 4
    pages = spark.createDataFrame([(1, "<p>a b</p>", "x", "y")], "page_id long, html string, _lbd_html string, n_chars string")
    assert [tuple(r) for r in html.extracted(pages).collect()] == [(1, "x", "a b", 3)]
    clash = spark.createDataFrame([(1, "a b c", "k"), (2, "d e f", "l")], "doc_id long, text string, _dc_key string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [tuple(r) for r in decontamination.decontaminated(clash, items).collect()] == [(2, "d e f", "l")]
    named = clash.withColumnRenamed("_dc_key", "_jg_text")
    assert sorted(tuple(r) for r in jaccard.one_of_each(named).collect()) == [(1, "a b c", "k"), (2, "d e f", "l")]
