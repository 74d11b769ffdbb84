"""The corpus pipeline: language ID, near copies, decontamination, mixing, sharding.

Each stage takes what its predecessor kept, whole, and its decisions take effect: rejected
documents, copies and leaked documents go, and what the mix takes twice is there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, jaccard, language, mixing, sharding
from tallyloom.llm.common import materialised, set_apart, table, word_count


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those that are undetermined go.

    A document without a ``lang`` gets the one that was told; labels that are there stay.
    Null texts and texts without a letter are undetermined; other columns travel along, whatever their names.
    """
    docs, back = set_apart(docs, ["doc_id", "text", "lang"])
    model = language.fit(language.labelled_rows(docs))
    told = language.predicted(docs, model).filter(F.col("lang_pred") != language.UNDETERMINED)
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles agree in 0.8 or more, the one with the smallest id.

    Texts without words are like nothing and stay; ids that are null or repeat name no group.
    """
    return jaccard.one_of_each(docs, jaccard.Likeness(width=5, percent=80))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold nothing of the benchmark; null and empty texts hold nothing."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or more often.

    A null source is a source like any other; texts without words have nothing to give to the
    mix and are taken as often as their hash says.  Other columns travel along, whatever their names.
    """
    docs, back = set_apart(docs, ["doc_id", "text", "source"])
    mix = mixing.mixed(docs, mixing.weighted_targets, F.array("source"), word_count(F.col("text")), mixing.document_draw())
    taken = mix.filter("copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return taken.select(*back)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``size``, ``shard`` and ``slot``, in place of columns of these names; null texts weigh one byte."""
    added = ("size", "shard", "slot")
    held, back = set_apart(docs, ["doc_id", "text"])
    kept = [b for c, b in zip(docs.columns, back, strict=True) if c.lower() not in added]
    return sharding.histogram_sort(held).select(*kept, *added)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The stages train a model and draw documents, which SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialised(docs)
    return docs
