import random
from itertools import combinations

import duckdb
import pytest
import regex

from tallyloom.llm import decontamination as d



def words(text):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())


def brute(docs, items):
    """All pairs with a window that agrees, without masks."""
    first = {}
    for i, t in items:
        w = tuple(words(t))
        if w:
            first[w] = min(first.get(w, i), i)
    out = {}
    for doc, text in docs:
        x = words(text)
        for y, item in first.items():
            window, best = min(len(y), d.WINDOW), 0
            for p in range(len(x) - window + 1):
                for q in range(len(y) - window + 1):
                    best = max(best, sum(x[p + k] == y[q + k] for k in range(window)))
            if best * 100 >= window * d.SHARE and best:
                out[doc, item] = max(best, out.get((doc, item), 0))
    return out


@pytest.mark.parametrize("length", range(1, d.WINDOW + 1))
def test_masks_miss_nothing_that_the_share_allows(length):
    allowed = length - -(-d.SHARE * length // 100)
    for wrong in combinations(range(length), allowed):
        assert any(all(at + o not in wrong for o, c in enumerate(m) if c == "1") for m in d.masks_for(length) for at in range(length - len(m) + 1)), wrong


def corpus():
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 8, 10, 12, 13, 20])))) for i in range(22)]
    docs = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(30)]
        if i % 2:
            leak = words(rng.choice(items)[1])
            for _ in range(rng.randrange(4) * len(leak) // 10):
                leak[rng.randrange(len(leak))] = "ZZ"
            text[10:10] = leak
        docs.append((i, " ".join(text)))
    return docs + [(100, None), (101, ""), (102, " ")], items + [(50, None), (51, " "), (52, items[0][1].upper())]


def test_pairs_are_those_of_brute_force(spark):
    docs, items = corpus()
    found = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["id"], r["item_id"]): r["matched"] for r in found.collect()} == brute(docs, items)


def test_many_blocks_find_the_same(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(d, "BLOCK_ROWS", 64)
    found = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["id"], r["item_id"]): r["matched"] for r in found.collect()} == brute(docs, items)


@pytest.mark.parametrize("side", ["docs", "items"])
def test_nothing_on_a_side(spark, side):
    docs = spark.createDataFrame([] if side == "docs" else [(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([] if side == "items" else [(1, "a b c")], "item_id long, text string")
    assert d.overlaps(docs, items).count() == 0
    assert d.decontaminated(docs, items).count() == docs.count()


def test_clean_documents_stay_with_their_columns(spark):
    docs = spark.createDataFrame([(1, "x one two three y", 1), (2, "one two four", 2), (3, None, 3), (3, None, 3)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(9, "One two three")], "item_id long, text string")
    kept = d.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["item_id"] for r in kept.collect()) == [2, 3, 3]


def test_case_and_punctuation_hide_nothing(spark):
    docs = spark.createDataFrame([(1, "x. ÜBER!! das, (weite) FELD; läuft... ein-HUND y")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "über das weite feld läuft ein hund")], "item_id long, text string")
    assert [(r["id"], r["matched"]) for r in d.overlaps(docs, items).collect()] == [(1, 7)]


def test_a_very_long_document(spark):
    text = " ".join(f"w{i % 9973}" for i in range(200_000)) + " a b c d e f g h i j k l m"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c d X f g h i j k l m")], "item_id long, text string")
    assert [(r["id"], r["matched"]) for r in d.overlaps(docs, items).collect()] == [(1, 12)]


def test_sql_gives_the_same(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    wanted = sorted(duck.execute(f"SELECT doc_id, item_id, matched, window_words FROM ({d.ORACLE_SQL})").fetchall())
    assert sorted(tuple(r) for r in d.op10_spaced_seeds(spark, folder).select("doc_id", "item_id", "matched", "window_words").collect()) == wanted


def test_an_item_without_an_id_counts(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "x four five six y"), (3, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (None, "four five six"), (9, "seven eight")], "item_id long, text string")
    assert sorted((r["id"], r["item_id"], r["matched"]) for r in d.overlaps(docs, items).collect()) == [(1, None, 3), (2, None, 3)]
    assert [r["doc_id"] for r in d.decontaminated(docs, items).collect()] == [3]


def test_repeated_rows_and_items_are_single_pairs(spark):
    docs = spark.createDataFrame([(1, "x one two three y")] * 3, "doc_id long, text string")
    items = spark.createDataFrame([(9, "one two three"), (4, "One, two three"), (9, "one two three")], "item_id long, text string")
    assert [(r["id"], r["item_id"], r["matched"]) for r in d.overlaps(docs, items).collect()] == [(1, 4, 3)]


def test_documents_meet_one_block_at_a_time_and_hits_carry_few_words(spark, monkeypatch):
    docs, items = corpus()
    plans, width = [], []

    def materialised(df, write=d.materialised):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        width.append(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))
        return write(df)

    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    monkeypatch.setattr(d, "BLOCK_ROWS", 64)
    monkeypatch.setattr(d, "materialised", materialised)
    found = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["id"], r["item_id"]): r["matched"] for r in found.collect()} == brute(docs, items)
    blocks = [(p, w) for p, w in zip(plans, width, strict=True) if "BroadcastHashJoin" in p]
    assert len(blocks) > 2
    for plan, rows in blocks:
        assert plan.count("BroadcastExchange") == 2 and "Aggregate" not in plan and int(rows) < 1024
        below = plan.split("BroadcastHashJoin [item_key")[1].split("\n")[1]
        assert "near_seed" in below and ", hashes#" not in below.split("slice(")[0]
        # the words of each text are split once
        assert plan.count("split(lower(") == 1
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == before


def test_a_passage_beside_the_ends_of_a_long_document(spark):
    item = "a b c d e f g h i j k l m"
    filler = " ".join(f"w{i % 9973}" for i in range(3000))
    docs = [(1, f"{item} {filler}"), (2, f"{filler} {item}"), (3, f"{filler} {item} {filler} {item.replace('c', 'X')}"), (4, f"{item} {filler}".replace("a b c", "X Y c")), (5, filler + " " + item[:-2])]
    items = [(9, item), (10, " ".join(f"z{i}" for i in range(30)))]
    found = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["id"], r["item_id"]): r["matched"] for r in found.collect()} == {(1, 9): 13, (2, 9): 13, (3, 9): 13, (4, 9): 11}
