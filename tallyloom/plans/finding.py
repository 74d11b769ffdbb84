"""Search, facets, relaxation and what the query log tells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import ascii_words, spaced_tokens
from tallyloom.operators import library
from tallyloom.sources.tables import local

from .registry import Registry, Tables

plans = Registry()

#: The queries that are asked of the documents, term by term.
ASKED = {1: ("the", "of", "and"), 2: ("le", "de", "une"), 3: ("der", "und", "die"), 4: ("que", "la", "los"), 5: ("the", "und"), 6: ("ver", "the", "la")}
_VALUES = ", ".join(f"({q}, {i}, '{w}')" for q, words in ASKED.items() for i, w in enumerate(words))
_WANTED = ", ".join(f"'{w}'" for w in sorted({w for words in ASKED.values() for w in words}))

TERMS_SQL = f"""
asked(query_id, position, term) AS (VALUES {_VALUES}),
words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS term FROM documents),
terms AS (SELECT doc_id AS id, term, count(*) >= 3 AS human FROM words WHERE term IN ({_WANTED}) GROUP BY 1, 2),
need AS (SELECT query_id, count(DISTINCT term) AS need FROM asked GROUP BY 1),
hits AS (SELECT a.query_id, t.id, count(*) AS matched, bool_or(t.human) AS confirmed FROM (SELECT DISTINCT query_id, term FROM asked) a JOIN terms t USING (term) GROUP BY 1, 2),
quality AS (SELECT d.doc_id AS id, coalesce(max(l.quality), 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1),
found AS (SELECT h.query_id, h.id, h.matched * 10 + CASE WHEN h.confirmed THEN 5 ELSE 0 END + q.quality AS score
          FROM hits h JOIN need n USING (query_id) JOIN quality q USING (id) WHERE h.matched = n.need)"""


def asked(t: Tables) -> DataFrame:
    rows = [(q, i, w) for q, words in ASKED.items() for i, w in enumerate(words)]
    return local(t.spark, dict(zip(("query_id", "position", "term"), map(list, zip(*rows, strict=True)), strict=True)))


def terms(t: Tables) -> DataFrame:
    wanted = sorted({w for words in ASKED.values() for w in words})
    words = t.documents.select(F.col("doc_id").alias("id"), F.explode(F.filter(ascii_words("text"), lambda w: w.isin(wanted))).alias("term"))
    return words.groupBy("id", "term").agg((F.count("*") >= 3).alias("human"))


def results(t: Tables) -> DataFrame:
    quality = t.labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("ai_quality_score"))
    assets = t.documents.select(F.col("doc_id").alias("id")).distinct().join(quality, "id", "left")
    wanted = asked(t)
    return library.search(wanted.select("query_id").distinct(), wanted, assets, terms(t))


@plans.add(
    "q09_unmapped_terms",
    """
WITH vocabulary AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS term FROM benchmark),
words AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS term FROM documents)
SELECT term, count(*) AS n FROM words WHERE term <> '' AND term NOT IN (SELECT term FROM vocabulary WHERE term IS NOT NULL) GROUP BY 1 HAVING count(*) >= 2
""",
)
def unmapped_terms(t: Tables) -> DataFrame:
    vocabulary = t.benchmark.select(F.explode(ascii_words("text")).alias("term")).distinct()
    counts = t.documents.select(F.explode(ascii_words("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.filter("n >= 2").join(vocabulary, "term", "left_anti")


@plans.add(
    "q16_search_rank",
    f"WITH {TERMS_SQL} SELECT query_id, id, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM found",
)
def search_rank(t: Tables) -> DataFrame:
    return results(t).select("query_id", "id", F.col("score").cast("long").alias("score"), "rank")


@plans.add("q17_search_and_filter", f"WITH {TERMS_SQL} SELECT query_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM found GROUP BY 1")
def and_filter(t: Tables) -> DataFrame:
    return results(t).groupBy("query_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@plans.add(
    "q18_relaxation",
    f"""
WITH {TERMS_SQL},
failed AS (SELECT query_id FROM need WHERE query_id NOT IN (SELECT query_id FROM found) AND need > 1),
lacking AS (SELECT h.query_id, h.id FROM hits h JOIN need n USING (query_id) WHERE h.matched = n.need - 1 AND query_id IN (SELECT query_id FROM failed)),
missing AS (SELECT l.query_id, l.id, a.term AS dropped, a.position FROM lacking l JOIN asked a USING (query_id)
            WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.id = l.id AND t.term = a.term))
SELECT query_id, dropped, id FROM missing QUALIFY position = max(position) OVER (PARTITION BY query_id)
""",
)
def relaxation(t: Tables) -> DataFrame:
    return library.relaxed(asked(t), terms(t))


@plans.add(
    "q19_refinements",
    f"WITH {TERMS_SQL} SELECT f.query_id, f.id, CAST(f.score AS BIGINT) AS score FROM found f JOIN terms t USING (id) WHERE t.term = 'la'",
)
def refinements(t: Tables) -> DataFrame:
    return library.refined(results(t), terms(t), {"room": "la"}).select("query_id", "id", F.col("score").cast("long").alias("score"))


@plans.add(
    "q20_query_log_tokens",
    r"""
WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS tokens FROM documents)
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n, array_to_string(tokens, ' ') AS tokens FROM l
""",
)
def log_tokens(t: Tables) -> DataFrame:
    tokens = spaced_tokens("text")
    return t.documents.select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@plans.add(
    "q27_first_per_kind",
    "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
)
def first_per_kind(t: Tables) -> DataFrame:
    first = t.events.groupBy("user_id", "event_type").agg(F.min_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("f"))
    return first.select("user_id", "event_type", "f.event_id", "f.value")


@plans.add(
    "q56_result_facets",
    f"""
WITH {TERMS_SQL}
SELECT f.query_id, 'kind' || (length(t.term) % 2) AS facet, t.term AS value, count(DISTINCT f.id) AS n FROM found f JOIN terms t USING (id) GROUP BY 1, 2, 3
""",
)
def result_facets(t: Tables) -> DataFrame:
    words = sorted({w for ws in ASKED.values() for w in ws})
    vocabulary = local(t.spark, {"term": words, "kind": [f"kind{len(w) % 2}" for w in words]})
    return library.facets(results(t), terms(t), vocabulary, ("kind0", "kind1")).drop("place")
