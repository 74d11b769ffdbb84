"""Search over a tagged library: parse, match all terms, rank, facets, relaxation, refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a match, a confirming human tag and the model's quality add to a score.
PER_MATCH, HUMAN_BONUS = 10, 5


def parsed(queries: DataFrame, vocabulary: DataFrame, max_words: int = 2) -> DataFrame:
    """Mapped and unmapped words of queries (query_id, text).

    ``vocabulary`` (term, kind) holds active terms and rooms.  Two adjacent words that make
    a term joined by ``_`` go before one word, from left to right.  Gives (query_id,
    position, raw, term, kind), with null term and kind for unmapped words.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    placed = queries.select("query_id", F.posexplode(words).alias("position", "word"))
    following = F.lead("word").over(Window.partitionBy("query_id").orderBy("position"))
    spans = placed.withColumn("pair", F.concat_ws("_", "word", following)).withColumn("pair", F.when(following.isNotNull(), F.col("pair")))
    terms = vocabulary.groupBy("term").agg(F.min("kind").alias("kind"))
    one = terms.select(F.col("term").alias("word"), F.col("kind").alias("word_kind"))
    two = terms.select(F.col("term").alias("pair"), F.col("kind").alias("pair_kind"))
    known = spans.join(two, "pair", "left").join(one, "word", "left")
    # of a run of overlapping pairs every other one is taken, from its left end
    order = Window.partitionBy("query_id").orderBy("position")
    known = known.withColumn("run", F.sum(F.when(F.col("pair_kind").isNull(), 1).otherwise(0)).over(order))
    place = F.row_number().over(Window.partitionBy("query_id", "run", F.col("pair_kind").isNull()).orderBy("position"))
    known = known.withColumn("leads", F.col("pair_kind").isNotNull() & (place % 2 == 1))
    covered = F.coalesce(F.lag("leads").over(order), F.lit(False))
    kept = known.withColumn("covered", covered).filter(~F.col("covered"))
    return kept.select(
        "query_id",
        "position",
        F.when(F.col("leads"), F.replace("pair", F.lit("_"), F.lit(" "))).otherwise(F.col("word")).alias("raw"),
        F.when(F.col("leads"), F.col("pair")).when(F.col("word_kind").isNotNull(), F.col("word")).alias("term"),
        F.when(F.col("leads"), F.col("pair_kind")).otherwise(F.col("word_kind")).alias("kind"),
    )


def live_tags(tags: DataFrame) -> DataFrame:
    return tags.filter(F.col("removed_at").isNull() & ~F.coalesce("rejected_by_human", F.lit(False)))


def asset_terms(assets: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, term, human): terms of an asset by live tag or by the model's room and shot."""
    fields = assets.select("id", F.explode(F.array_compact(F.array("ai_room", "ai_shot_type"))).alias("term"), F.lit(False).alias("human"))
    tagged = live_tags(tags).select(F.col("asset_id").alias("id"), "term", (F.col("source") == "human").alias("human"))
    return fields.unionByName(tagged).groupBy("id", "term").agg(F.bool_or("human").alias("human"))


def matches(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, matched, confirmed): how many of a query's terms (query_id, term) an asset has."""
    distinct = wanted.filter(F.col("term").isNotNull()).select("query_id", "term").distinct()
    return distinct.join(terms, "term").groupBy("query_id", "id").agg(F.count("*").alias("matched"), F.bool_or("human").alias("confirmed"))


def search(queries: DataFrame, wanted: DataFrame, assets: DataFrame, terms: DataFrame) -> DataFrame:
    """Ranked results (query_id, id, score, rank): assets with all terms; of a query without terms all assets."""
    need = queries.select("query_id").join(wanted.filter(F.col("term").isNotNull()).groupBy("query_id").agg(F.count_distinct("term").alias("need")), "query_id", "left")
    quality = assets.select("id", F.coalesce("ai_quality_score", F.lit(0)).alias("quality"))
    found = matches(wanted, terms).join(need.filter("need IS NOT NULL"), "query_id").filter("matched = need").join(quality, "id")
    # a query that asks for nothing gets everything: its answer is the library itself
    open_ = need.filter("need IS NULL").select("query_id").crossJoin(quality).select("query_id", "id", F.lit(0).cast("long").alias("matched"), F.lit(False).alias("confirmed"), "quality")
    every = found.select("query_id", "id", "matched", "confirmed", "quality").unionByName(open_)
    return ranked(every.withColumn("score", score(F.col("matched"), F.col("confirmed"), F.col("quality"))))


def score(matched: Column, confirmed: Column, quality: Column) -> Column:
    return matched * PER_MATCH + F.when(confirmed, HUMAN_BONUS).otherwise(0) + quality


def ranked(df: DataFrame, by: str = "score", tie: str = "id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(by), tie)
    return df.withColumn("rank", F.row_number().over(order)).select("query_id", tie, by, "rank")


def facets(results: DataFrame, terms: DataFrame, vocabulary: DataFrame, kinds: tuple[str, ...] = ("room", "light", "vibe")) -> DataFrame:
    """(query_id, facet, value, n): counts over results, the most frequent first in rank."""
    named = terms.join(vocabulary.filter(F.col("kind").isin(list(kinds))).select("term", "kind").distinct(), "term")
    counts = results.select("query_id", "id").join(named, "id").groupBy("query_id", F.col("kind").alias("facet"), F.col("term").alias("value")).agg(F.count_distinct("id").alias("n"))
    order = Window.partitionBy("query_id", "facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order))


def relaxed(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """For queries that no asset meets: the term dropped, the latest that helps, and the ids then found.

    An asset that lacks one term alone is found by dropping that term, whose place is what
    the places of the others leave of all of them.
    """
    asked = wanted.filter(F.col("term").isNotNull()).groupBy("query_id", "term").agg(F.max("position").alias("position"))
    need = asked.groupBy("query_id").agg(F.count("*").alias("need"), F.sum("position").alias("places"))
    met = asked.join(terms, "term").groupBy("query_id", "id").agg(F.count("*").alias("matched"), F.sum("position").alias("met"))
    lacking = met.join(need.filter("need > 1"), "query_id").filter("matched >= need - 1").select("query_id", "id", (F.col("need") - F.col("matched")).alias("lacks"), (F.col("places") - F.col("met")).alias("position"))
    # a query with a full match needs no relaxation
    best = lacking.groupBy("query_id").agg(F.min("lacks").alias("lacks"), F.max("position").alias("position")).filter("lacks = 1").select("query_id", "position")
    named = best.join(asked, ["query_id", "position"]).select("query_id", "position", F.col("term").alias("dropped"))
    return lacking.join(named, ["query_id", "position"]).select("query_id", "dropped", "id")


def refined(results: DataFrame, terms: DataFrame, chosen: dict[str, str]) -> DataFrame:
    """Results that also have every chosen value."""
    for value in chosen.values():
        results = results.join(terms.filter(F.col("term") == value).select("id").distinct(), "id", "left_semi")
    return results


def first_per_kind(mapped: DataFrame) -> DataFrame:
    """(query_id, facets): of each kind the first term."""
    order = Window.partitionBy("query_id", "kind").orderBy("position")
    first = mapped.filter(F.col("term").isNotNull()).withColumn("place", F.row_number().over(order)).filter("place = 1")
    return first.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "term")))).alias("facets"))
