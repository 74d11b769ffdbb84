import numpy as np

from tallyloom.llm import language
from tallyloom.llm.language import UNDETERMINED, fit, labelled_rows, op5_language_filters, predicted

SCHEMA = "doc_id long, text string, lang string"
TEXTS = {
    "en": ["the cat sat on the mat with this thing", "when the other things were there they then thought", "the weather with the brother there", "this is the thing that they think"],
    "de": ["der hund und die katze schlafen nicht", "ich und die nachbarn sind nicht schuldig", "schon auch nicht durch die schule", "die schwester und der nicht"],
}


def model(spark):
    rows = [(i * 10 + k, t, lang) for i, (lang, ts) in enumerate(TEXTS.items()) for k, t in enumerate(ts)]
    return fit(spark.createDataFrame(rows, SCHEMA).select("text", "lang"))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op5_language_filters(spark, folder).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_the_filter_names_all_languages_of_a_gram(spark):
    found = model(spark)
    assert found.languages == ["de", "en"]
    hits = found.hits(language.grams(language.letters_of("the")))
    assert hits[1] > hits[0]
    assert (found.false_positives() < 0.01).all()


def test_undetermined_empty_and_long_texts(spark):
    found = model(spark)
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 34 !", "x"), (4, "the " * 200_000, "x"), (5, "und die " * 10, "x"), (5, "und die " * 10, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = [(r["doc_id"], r["lang_pred"]) for r in predicted(df, found).orderBy("doc_id").collect()]
    assert got == [(1, UNDETERMINED), (2, UNDETERMINED), (3, UNDETERMINED), (4, "en"), (5, "de"), (5, "de")]


def test_without_labels_or_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = fit(labelled_rows(empty))
    assert predicted(empty, found).count() == 0
    assert predicted(spark.createDataFrame([(1, "the", None)], SCHEMA), found).first()["lang_pred"] == UNDETERMINED


def test_pieces_hold_every_gram():
    codes = language.letters_of("abc déf " * 40)
    whole = np.unique(language.grams(codes))
    before = language._PIECE
    try:
        language._PIECE = 16
        parts = np.unique(np.concatenate([language.grams(p) for p in language.pieces(codes)]))
    finally:
        language._PIECE = before
    assert np.array_equal(whole, parts)
