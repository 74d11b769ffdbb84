"""Cross-tokenizer alignment against a loop that uses both libraries alone."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import alignment
from tallyloom.llm.alignment import Pair, Vocabularies, aligned, best_pairs
from tallyloom.llm.common import table

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def paths():
    return Vocabularies.public()


@pytest.fixture(scope="module")
def tables(paths):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths.a)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=paths.b)
    signs = {chr(n): n for n in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for n in range(256):
        if n not in signs.values():
            signs[chr(256 + len([k for k in signs if ord(k) > 255]))] = n
    names = {i: t for t, i in a.get_vocab().items()}

    def of_a(i):
        return bytes(signs[c] for c in names[i])

    def of_b(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if name.startswith("<0x") and len(name) == 6 else name.replace("▁", " ").encode()

    return a, b, of_a, of_b


def groups_of(text, tables):
    a, b, of_a, of_b = tables
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    want = (" " + text).encode()
    if b"".join(map(of_a, ids_a)) != want or b"".join(map(of_b, ids_b)) != want:
        return []
    out, i, j, at, bt, group = [], 0, 0, 0, 0, ([], [])
    while i < len(ids_a) or j < len(ids_b):
        if at <= bt and i < len(ids_a):
            group[0].append(ids_a[i])
            at += len(of_a(ids_a[i]))
            i += 1
        else:
            group[1].append(ids_b[j])
            bt += len(of_b(ids_b[j]))
            j += 1
        if at == bt and group[0] and group[1]:
            out.append(group)
            group = ([], [])
    return out


def brute(texts, tables):
    grouped = [groups_of(t, tables) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in grouped]
    held = Counter(p for own in links for p in own)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, (g, own) in enumerate(zip(grouped, links, strict=True)):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
            sum(n for p, n in own.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in own.items()), hashlib.sha256(said.encode()).hexdigest() if g else "",
        ))
    return out, held, best


def texts_of(n, seed):
    rng = random.Random(seed)
    words = "the of and Erinst resh. naïve élan größer El niño don't we'll 12345 3.14 ### <s> <|endoftext|> </s> 🙂 日本語 ­ x²½ ​ ▁ \t \n\n   ᄀ ﬁ \x00 ..... AAAAAAAA".split(" ")
    return [rng.choice(["", " ", "\n"]).join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(40))) for _ in range(n)]


def run(spark, texts, paths, parts=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    return sorted(tuple(r) for r in aligned(df, paths).select(*COLUMNS).collect())


def test_equals_a_loop(spark, paths, tables):
    texts = [None, "", " ", "\n", "a", "▁", *texts_of(120, 1), "the " * 300, "=" * 5000, " " * 4000, "x" * 3000]
    assert run(spark, texts, paths) == brute(texts, tables)[0]


def test_large_groups_are_counted_by_distinct_ids(spark, paths, tables, monkeypatch):
    texts = [*texts_of(40, 2), " " * 700, "é" * 400 + "=" * 900]
    monkeypatch.setattr(alignment, "FEW", 1)
    both = Pair(paths)
    held = Counter()
    for t in texts:
        pairs, times = both.aligned(t)[5:]
        held.update(dict(zip(pairs.tolist(), times.tolist(), strict=True)))
    want = Counter(x * len(both.b) + y for t in texts for a, b in groups_of(t, tables) for x in a for y in b)
    assert held == want


def test_the_fast_encoder_and_stretches_change_nothing(paths, tables, monkeypatch):
    monkeypatch.setattr(alignment, "LONG", 50)
    both, alone = Pair(paths), Pair(Vocabularies(paths.a, paths.b))
    assert both.fast is not None and alone.fast is None
    rng = random.Random(3)
    plain = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0x250), *range(0x2010, 0x2028)]]
    texts = texts_of(150, 4) + ["".join(rng.choices(plain, k=rng.randrange(1, 400))) for _ in range(150)]
    a, b = tables[:2]
    for t in filter(None, texts):
        parts = both.stretches(t)
        assert [i for p in parts for i in both.encoded_a(p).tolist()] == [i for p in parts for i in alone.encoded_a(p).tolist()] == a.encode(" " + t, add_special_tokens=False).ids
        assert [i for p in parts for i in b.encode(p[1:])] == b.encode(t)


def test_salts_and_stripes_change_nothing(spark, paths, tables, monkeypatch):
    texts = texts_of(60, 5)
    monkeypatch.setattr(alignment, "SALTED", 2)
    monkeypatch.setattr(alignment, "STRIPES", 1000)
    assert run(spark, texts, paths, parts=6) == brute(texts, tables)[0]


def test_best_pairs(spark, paths, tables):
    texts = texts_of(50, 6)
    _, held, best = brute(texts, tables)
    got = {tuple(r) for r in best_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), paths).collect()}
    assert got == {(x, y, n) for (x, y), n in held.items() if n == best[x]}


def test_odd_inputs(spark, paths):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    clash = df.select("*", *(F.lit("mine").alias(c) for c in ("block", "place", "stripe", "salt", "counts", "n_a")))
    got = sorted(tuple(r)[:7] for r in aligned(clash, paths).fillna(0, ["doc_id"]).collect())
    one = next(r for r in got if r[0] == 0)
    assert [r[0] for r in got] == [0, 1, 1, 2] and got[1][1:] == got[2][1:] == one[1:] and got[3][1:] == (0,) * 6
    assert aligned(df.limit(0), paths).collect() == []
    assert aligned(df.filter("doc_id = 2"), paths).count() == 1


def test_the_query_equals_a_loop(spark, tables):
    rows = table(spark, DATA, "documents").select("doc_id", "text").collect()
    want = {r["doc_id"]: w[1:] for r, w in zip(rows, brute([r["text"] for r in rows], tables)[0], strict=True)}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in alignment.op13_striped_alignment(spark, DATA).collect()}
    assert got == want
