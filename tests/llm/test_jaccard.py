import random
import re
from collections import Counter, defaultdict

import pytest

from tallyloom.llm import jaccard
from tallyloom.llm.common import materialised
from tallyloom.llm.jaccard import Likeness, one_of_each, similar_groups

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, like):
    sets = [shingles(t, like.width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        common = Counter(o for g in s for o in holders[g])
        for g in s:
            holders[g].append(k)
        for o, n in common.items():
            if 100 * n >= like.percent * (len(s) + len(sets[o]) - n):
                parent[root(k)] = root(o)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 8, 11, 14, 18, 25, 33, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 3, 20, 90])):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text + passage if rng.random() < 0.3 else text)))
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t "), (n + 3, "One"), (n + 4, "oNE")] + rows[:5]


@pytest.mark.parametrize("like", [Likeness(3, 90), Likeness(5, 80)])
@pytest.mark.parametrize(("block", "listed"), [(128, 32), (4, 3), (16, 1)])
def test_groups_are_those_of_brute_force(spark, monkeypatch, like, block, listed):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LISTED", listed)
    monkeypatch.setattr(jaccard, "STANDING", max(1, block // 8))
    rows = corpus(block)
    docs = materialised(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in similar_groups(docs, like).collect())
    assert got == brute(rows, like)


def test_no_documents(spark):
    assert similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d", "x", 1), (3, "a b c d", "y", 2), (3, "a b c d", "y", 2), (4, None, "z", 3)]
    docs = materialised(spark.createDataFrame(rows, "doc_id long, text string, component_id string, cls int"))
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in similar_groups(docs).collect())
    assert got == [(0, 3), (3, 3), (3, 3), (4, 4)]
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["cls"]) for r in kept.collect()) == [(3, 2), (4, 3)]


def test_the_boundary_follows_the_sizes():
    like = Likeness(3, 90)
    assert like.boundary({9: 1000}) == 20
    assert like.boundary({15: 10}) == 10
    assert (like.least, Likeness(5, 80).least) == (9, 4)


def test_ids_that_are_missing_or_repeat_cost_no_text(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(40))
    near = words("a").replace("a0 ", "changed ")
    rows = [(None, words("a")), (None, words("b")), (None, words("c")), (None, words("c")), (7, words("d")), (7, words("e")), (8, words("d")), (3, near)]
    kept = one_of_each(spark.createDataFrame(rows, SCHEMA), Likeness(width=5, percent=80)).collect()
    assert sorted(r["text"] for r in kept) == sorted([near, words("b"), words("c"), words("d"), words("e")])
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "7", "7", "None", "None"]


def test_unlike_texts_of_common_words_are_no_candidates(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=150))) for i in range(3000)]
    near = rows[7][1].split()
    rows.append((len(rows), " ".join([*near[:70], "changed", *near[71:]])))
    docs = materialised(spark.createDataFrame(rows, SCHEMA).repartition(3))
    like = Likeness()
    described = materialised(docs.selectExpr("*", "xxhash64(text) AS text_key").mapInArrow(jaccard._described(like), "doc_id long, text_key long, cls long, n_shingles long, chunk long, place long, small binary"))
    pairs = jaccard._candidates(docs, described, like).count()
    assert 1 <= pairs < 30
    groups = Counter(r["component_id"] for r in similar_groups(docs, like).collect())
    assert [k for k, n in groups.items() if n > 1] == [7]


@pytest.mark.parametrize("percent", [80, 90])
def test_the_bound_of_shared_rarest_shingles_loses_nothing(percent):
    rng = random.Random(percent)
    like = Likeness(3, percent)
    for _ in range(3000):
        n = rng.randint(5, 60)
        x = set(range(n))
        y = set(x)
        for _ in range(rng.randint(0, n // 5)):
            y.discard(rng.randrange(n))
            if rng.random() < 0.6:
                y.add(rng.randrange(n, 2 * n))
        if 100 * len(x & y) < percent * len(x | y):
            continue
        order = rng.sample(range(2 * n), 2 * n)
        rarest = [sorted(s, key=order.index)[: len(s) - -(-percent * len(s) // 100) + 1] for s in (x, y)]
        assert len(set(rarest[0]) & set(rarest[1])) >= int(like.common(len(x), len(y)))


def test_a_chunk_is_bounded_by_its_shingles(monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", 10)
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    monkeypatch.setattr(jaccard.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 2})())
    addresses = jaccard.Addresses()
    assert [(c - (2 << 32), p) for c, p in map(addresses.next, [4, 6, 1, 99, 0, 1, 1, 1, 1])] == [(0, 0), (0, 1), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2), (4, 0), (4, 1)]
