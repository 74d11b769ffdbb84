from pyspark.sql import functions as F

from tallyloom.functions.scalars import cell_signature, instruction
from tallyloom.operators import library

VOCABULARY = [("warm_light", "light"), ("hands", "subject"), ("closeup", "shot"), ("sauna", "room"), ("treatment_room", "room")]


def mapped(spark, text):
    queries = spark.createDataFrame([(1, text)], "query_id long, text string")
    vocabulary = spark.createDataFrame(VOCABULARY, "term string, kind string")
    return [(r["raw"], r["term"], r["kind"]) for r in library.parsed(queries, vocabulary).orderBy("position").collect()]


def test_two_words_before_one(spark):
    assert mapped(spark, "warm light hands") == [("warm light", "warm_light", "light"), ("hands", "hands", "subject")]


def test_unknown_words_stay_unmapped(spark):
    assert mapped(spark, "golden hour hands") == [("golden", None, None), ("hour", None, None), ("hands", "hands", "subject")]


def test_rooms_and_shots(spark):
    assert mapped(spark, "Sauna closeup") == [("sauna", "sauna", "room"), ("closeup", "closeup", "shot")]


def test_hyphens_split(spark):
    assert [m[0] for m in mapped(spark, "doric-column")] == ["doric", "column"]


ASSETS = "id string, ai_room string, ai_shot_type string, ai_quality_score double"
TAGS = "asset_id string, term string, source string, removed_at long, rejected_by_human boolean"


def library_of(spark):
    assets = spark.createDataFrame([("a1", "sauna", "wide", 3.0), ("a2", "treatment_room", "closeup", 9.0), ("a3", "sauna", "closeup", 1.0)], ASSETS)
    tags = spark.createDataFrame(
        [("a1", "hands", "ai", None, False), ("a2", "hands", "human", None, False), ("a3", "hands", "ai", 5, False), ("a3", "warm_light", "ai", None, True)], TAGS
    )
    return assets, library.asset_terms(assets, tags)


def asked(spark, *terms):
    wanted = spark.createDataFrame([(1, i, t) for i, t in enumerate(terms)], "query_id long, position int, term string")
    return spark.createDataFrame([(1,)], "query_id long"), wanted


def test_rank_counts_human_tags_and_quality(spark):
    assets, terms = library_of(spark)
    found = library.search(*asked(spark, "hands"), assets, terms).orderBy("rank").collect()
    assert [(r["id"], r["score"], r["rank"]) for r in found] == [("a2", 24.0, 1), ("a1", 13.0, 2)]


def test_removed_and_rejected_tags_do_not_match(spark):
    assets, terms = library_of(spark)
    assert library.search(*asked(spark, "warm_light"), assets, terms).count() == 0


def test_a_query_without_terms_finds_all(spark):
    assets, terms = library_of(spark)
    queries, _ = asked(spark)
    nothing = spark.createDataFrame([(1, 0, None)], "query_id long, position int, term string")
    assert library.search(queries, nothing, assets, terms).count() == 3


def test_facets(spark):
    assets, terms = library_of(spark)
    queries, _ = asked(spark)
    nothing = spark.createDataFrame([(1, 0, None)], "query_id long, position int, term string")
    vocabulary = spark.createDataFrame(VOCABULARY, "term string, kind string")
    found = library.facets(library.search(queries, nothing, assets, terms), terms, vocabulary).filter("facet = 'room'")
    assert [(r["value"], r["n"]) for r in found.orderBy("place").collect()] == [("sauna", 2), ("treatment_room", 1)]


def test_relaxation_drops_the_later_term(spark):
    assets, terms = library_of(spark)
    _, wanted = asked(spark, "treatment_room", "warm_light")
    assert [(r["dropped"], r["id"]) for r in library.relaxed(wanted, terms).collect()] == [("warm_light", "a2")]
    _, met = asked(spark, "treatment_room", "hands")
    assert library.relaxed(met, terms).count() == 0


def test_first_term_of_a_kind(spark):
    rows = [(1, 0, "sauna", "room"), (1, 1, "warm_light", "light"), (1, 2, "hands", "subject"), (1, 3, "oil", "subject")]
    mapped = spark.createDataFrame(rows, "query_id long, position int, term string, kind string")
    assert library.first_per_kind(mapped).first()["facets"] == {"room": "sauna", "light": "warm_light", "subject": "hands"}


def test_instruction_and_signature(spark):
    df = spark.createDataFrame([({"room": "exterior", "shot_type": "wide"}, {"shot": "wide", "room": "sauna"})], "a map<string,string>, b map<string,string>")
    row = df.select(instruction("a").alias("text"), cell_signature("b").alias("one"), cell_signature(F.create_map(F.lit("room"), F.lit("sauna"), F.lit("shot_type"), F.lit("wide"))).alias("two")).first()
    assert row["text"] == "wide of the exterior, vertical, natural light"
    assert row["one"] == row["two"] == "room=sauna|shot_type=wide"
