"""Language ID by n-gram filters that answer for all languages at once.

One Bloom filter holds a bitmask in each slot, a bit for each language (bit-sliced: one
probe sets or reads all languages).  The masks at an n-gram's slots, and-ed, name every
language that contains it.  A text's n-grams are looked up, hits are counted per language,
each language's count is corrected for the false positives that its own fill makes likely,
and the language with the largest corrected count is the answer.

The filter is fitted on about SAMPLE whole texts of each language, drawn by a hash of the row
(all, where there are fewer), so a text with many copies counts by its share.  An n-gram belongs to a language if at least MIN_TEXTS
of its texts hold it, and at a rate of at least SHARE of the language that holds it most,
so stray passages in another language don't teach it.  The filter has SLOTS slots, whatever
the corpus; that is what reaches driver and executors.

Defined results: null texts, and texts without a letter, are ``und`` with score 0; a text
none of whose n-grams is known gets the first language, with score 0; ties go to the first
language by name; without labelled texts everything is ``und``; other columns travel along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import set_apart, table
from .words import mix

WIDTHS = (1, 2, 3, 4)
SAMPLE, MIN_TEXTS, SHARE = 1000, 2, 0.5
SLOTS, HASHES = 1 << 21, 2
UNDETERMINED = "und"
#: Characters that are looked at together.
_PIECE = 1 << 18

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters, with one 0 for each run of anything else, and at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letter_table()[codes], codes, 0)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams of the widths used, but those of white space alone."""
    wide = codes.astype(np.uint64) + np.uint64(1)
    out, run = [], np.zeros(len(wide), np.uint64)
    for n in range(1, max(WIDTHS) + 1):
        size = len(wide) - n + 1
        if size <= 0:
            break
        run = run[:size] * np.uint64(0x100000001B3) * np.uint64(0x2545F491) + wide[n - 1 :]
        if n in WIDTHS:
            found = mix(run + (np.uint64(n) << np.uint64(56)))
            out.append(found[codes[:size] != 0] if n == 1 else found)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that together have all its n-grams (a few of them twice)."""
    for at in range(0, max(1, len(codes) - max(WIDTHS)), _PIECE):
        yield codes[at : at + _PIECE + max(WIDTHS) - 1]


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    parts = [hashes & np.uint64(SLOTS - 1), (hashes >> np.uint64(32)) & np.uint64(SLOTS - 1)]
    return [p.astype(np.int64) for p in parts[:HASHES]]


@dataclass(frozen=True)
class LanguageFilter:
    """``masks``: a row for each byte of the mask, a column for each slot."""

    languages: list[str]
    masks: np.ndarray

    def false_positives(self) -> np.ndarray:
        bits = np.unpackbits(self.masks, axis=0, bitorder="little")[: len(self.languages)]
        return bits.mean(axis=1) ** HASHES

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains."""
        at = slots(hashes)
        out = []
        for masks in self.masks:
            found = masks[at[0]]
            for more in at[1:]:
                found = found & masks[more]
            counts = np.bincount(found, minlength=256)
            out += [int(counts[(np.arange(256) >> bit) & 1 == 1].sum()) for bit in range(8)]
        return np.array(out[: len(self.languages)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            own = [np.unique(grams(p)) for p in pieces(letters_of(text))]
            found.setdefault(lang, []).append(np.unique(np.concatenate(own)) if len(own) > 1 else own[0])
        for lang, parts in found.items():
            for at in range(0, len(parts), 64):  # so many texts at once
                hashes, texts = np.unique(np.concatenate(parts[at : at + 64]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hashes)), pa.array(hashes.view(np.int64)), pa.array(texts)], ["lang", "gram", "texts"])


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column("gram").to_numpy().view(np.uint64)
        mask = np.tile(batch.column("mask").to_numpy(), HASHES)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots(hashes))), pa.array(mask), pa.array(np.tile(batch.column("word").to_numpy(), HASHES))], ["slot", "mask", "word"])


def fit(labelled: DataFrame) -> LanguageFilter:
    """The filter for the ``lang`` values of rows (text, lang, and doc_id if there is one), none of them null."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageFilter([], np.zeros((0, SLOTS), np.uint8))
    spark = labelled.sparkSession
    rates = F.broadcast(spark.createDataFrame([(k, min(1.0, SAMPLE / counts[k]), i // 8, 1 << (i % 8)) for i, k in enumerate(languages)], "lang string, rate double, word int, bit int"))
    own = [c for c in ("doc_id", "text") if c in labelled.columns]
    drawn = labelled.join(rates.select("lang", "rate"), "lang").filter(F.pmod(F.xxhash64(*own), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    drawn = drawn.select("text", "lang")
    sampled = drawn.groupBy("lang").agg(F.count("*").alias("sampled"))
    frequency = drawn.mapInArrow(_frequencies, "lang string, gram long, texts long").groupBy("gram", "lang").agg(F.sum("texts").alias("texts"))
    rated = frequency.filter(F.col("texts") >= MIN_TEXTS).join(F.broadcast(sampled), "lang").select("gram", "lang", (F.col("texts") / F.col("sampled")).alias("rate"))
    most = F.max("rate").over(_by_gram())
    kept = rated.withColumn("most", most).filter(F.col("rate") >= SHARE * F.col("most")).join(rates.select("lang", "word", "bit"), "lang")
    masks = kept.groupBy("gram", "word").agg(F.bit_or("bit").cast("long").alias("mask"))
    filled = masks.mapInArrow(_slots_of, "slot long, mask long, word int").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # SLOTS rows a word at most
    out = np.zeros((-(-len(languages) // 8), SLOTS), np.uint8)
    out[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy()
    return LanguageFilter(languages, out)


def _by_gram():
    from pyspark.sql import Window

    return Window.partitionBy("gram")  # a row for each language


def _told(model: LanguageFilter, wrong: np.ndarray, text: str | None) -> tuple[str, float]:
    codes = letters_of(text or "")
    if not model.languages or not codes.any():
        return UNDETERMINED, 0.0
    hits, n = np.zeros(len(model.languages)), 0
    for piece in pieces(codes):
        found = grams(piece)
        hits += model.hits(found)
        n += len(found)
    true = np.maximum(hits - wrong * n, 0) / np.maximum(1 - wrong, 1e-9)
    best = int(np.argmax(true))
    return model.languages[best], float(true[best] / true.sum()) if true[best] > 0 else 0.0


def predicted(df: DataFrame, model: LanguageFilter, text_column: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, in place of columns of these names; nothing but the text is looked at."""
    held, back = set_apart(df, [text_column])
    kept = [b for c, b in zip(df.columns, back, strict=True) if c.lower() not in ("lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast(model)

    # the text alone goes to Python, and only the answer comes back
    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def told(texts: pa.Array) -> pa.Array:
        known: LanguageFilter = shared.value
        wrong = known.false_positives()
        answers = [_told(known, wrong, text.as_py()) for text in texts]
        langs, scores = ([a[i] for a in answers] for i in (0, 1))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    answered = held.select("*", told(text_column).alias("_lid_told"))
    return answered.select(*kept, "_lid_told.lang_pred", "_lid_told.score")


def labelled_rows(docs: DataFrame) -> DataFrame:
    """Texts and languages to learn from: those not held out."""
    return docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def op5_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_rows(docs))
    given = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predicted(given, model).select("doc_id", "held_out", "lang_pred", "score")
