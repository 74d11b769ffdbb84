"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask is a row of positions of which only some are looked at.  The words of a document
under each mask, at each place, are hashed, and so are those of the benchmark; equal hashes
are hits even where the ignored words were substituted.  Around a hit the document is held
against the item word by word: the pair counts if a window of WINDOW words of the item (all
of a shorter one) that holds the seed agrees in at least SHARE per cent of its words.

The seeds of the benchmark are broadcast in blocks of items with about BLOCK_ROWS seeds
together; a larger benchmark takes more passes over the documents.  Documents aren't shuffled, and a
document's words never leave the stage that reads it.

Defined results: null and empty texts and those without a letter or digit, of documents and
of items, match nothing;
items with equal words count as the one with the smallest id; an item without an id counts
as any other, and its pairs have a null item_id; items of up to ten words
have masks of their own, so nothing that SHARE allows is missed; rows that agree in text get the same decision; empty
tables give no pairs; other columns travel along in ``decontaminated``.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialised, narrow_reads, set_apart, table

#: 1 looks, 0 ignores; five words are looked at.  Whatever words of a window of 11, 12 or 13 are substituted, as many as SHARE allows, one of these fits.
MASKS = ("1101011", "11100011", "101100101")
WINDOW, SHARE = 13, 80
BLOCK_ROWS = 1 << 20

#: A word is a run of these: case and punctuation don't hide a passage.
LETTERS = r"\p{L}\p{M}\p{N}"


def _fits(mask: str, wrong: tuple[int, ...], length: int) -> bool:
    looked = [o for o, c in enumerate(mask) if c == "1"]
    return any(all(at + o not in wrong for o in looked) for at in range(length - len(mask) + 1))


@cache
def masks_for(length: int) -> tuple[str, ...]:
    """Masks for items of a length: one of them fits, whatever words are substituted, as many as SHARE allows.

    For windows of full length these are MASKS.  Shorter items take the masks, of as many words as
    go, that fit most of the patterns left, one after the other.
    """
    if length > 10:
        return MASKS
    allowed = length - -(-SHARE * length // 100)
    left = list(combinations(range(length), allowed))
    chosen: list[str] = []
    for weight in range(min(5, length - allowed), 0, -1):
        tried = [m for m in ("".join("1" if o in p else "0" for o in range(p[-1] + 1)) for p in combinations(range(length), weight) if p[0] == 0)]
        while left and len(chosen) < 4:
            counts = [sum(_fits(m, w, length) for w in left) for m in tried]
            if not max(counts):
                break
            chosen.append(tried[counts.index(max(counts))])
            left = [w for w in left if not _fits(chosen[-1], w, length)]
        if not left:
            return tuple(chosen)
        chosen, left = [], list(combinations(range(length), allowed))
    return tuple(chosen)


def words(text: Column) -> Column:
    """The words of a text in lower case, without punctuation; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), rf"[^{LETTERS}]+"), "")


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """``rows`` (with ``hashes``) once for each place and mask that fits: ``at``, ``mask`` (its number), ``span``, ``seed``.

    Only numbers are made for a place, no arrays or structs, and nothing that a filter would work out a second time.
    """
    placed = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("hashes") - 1, F.lit(0)))).alias("at"))
    each = placed.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.lit(len(m)).alias("span")) for k, m in enumerate(masks)])).alias("m"))
    fits = each.select(*rows.columns, "at", F.col("m.mask").alias("mask"), F.col("m.span").alias("span")).filter(F.col("at") + F.col("span") <= F.size("hashes"))
    hashed = [F.xxhash64(F.lit(k), *[F.get("hashes", F.col("at") + o) for o, c in enumerate(m) if c == "1"]) for k, m in enumerate(masks)]
    seed = reduce(lambda rest, k: F.when(F.col("mask") == k, hashed[k]).otherwise(rest), range(len(masks) - 1), hashed[-1])
    return fits.withColumn("seed", seed)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_key, item_id, item): ids may be null, so a hash of its words names an item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    same = items.groupBy("words").agg(F.min("item_id").alias("item_id"))
    return same.select(F.xxhash64("words").alias("item_key"), "item_id", F.transform("words", lambda w: F.xxhash64(w)).alias("item"))


def overlaps(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pairs (id, text_key, item_id) of ``df`` and ``benchmark`` (item_id, text), with the most words that agree in a window."""
    items = materialised(_items(benchmark))
    lengths = F.least(F.size("item"), F.lit(WINDOW))
    found_lengths = sorted(r[0] for r in items.select(lengths).distinct().collect())  # WINDOW at most
    masks = list(dict.fromkeys(m for n in found_lengths for m in masks_for(n)))
    # which masks look at items of a length
    looks = F.array(*[F.array(*[F.lit(masks.index(m)) for m in masks_for(n)]) if n in found_lengths else F.array().cast("array<int>") for n in range(WINDOW + 1)])
    seeds = materialised(
        _seeds(items.withColumnRenamed("item", "hashes"), masks or list(MASKS))
        .filter(F.array_contains(F.get(looks, F.least(F.size("hashes"), F.lit(WINDOW))), F.col("mask")))
        .select("item_key", F.col("at").alias("item_at"), "span", "seed")
    )
    blocks = max(1, -(-seeds.count() // BLOCK_ROWS))
    docs = df.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_key"), _hashes(F.col(text_column)).alias("hashes"))
    probes = _seeds(docs, masks or list(MASKS)).drop("mask", "span")
    # of a document, the words that windows around a seed reach: a hit takes no more memory in a long document than in a short one
    start = F.greatest(F.col("at") - WINDOW, F.lit(0))
    near_seed = F.slice("hashes", start + 1, F.col("at") + WINDOW - start)
    window = F.least(F.size("item"), F.lit(WINDOW))
    lag = F.col("at") - F.col("item_at")
    low = F.greatest(F.lit(0), F.col("item_at") + F.col("span") - window, -lag)
    high = F.least(F.size("item"), F.col("item_at") + window, F.col("words") - lag)
    agree = F.zip_with(
        F.slice("near_seed", F.col("lag") + F.col("low") - F.col("start") + 1, F.col("high") - F.col("low")),
        F.slice("item", F.col("low") + 1, F.col("high") - F.col("low")),
        lambda a, b: (a == b).cast("int"),
    )
    sums = F.transform(
        F.sequence(F.lit(0), F.size("agree") - F.col("window")),
        lambda s: F.aggregate(F.slice("agree", s + 1, F.col("window")), F.lit(0), lambda a, x: a + x),
    )

    def hits(block: int) -> DataFrame:
        # whole items, of BLOCK_ROWS seeds together, about; an item has no more words than seeds and a mask's length
        mine = F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == block
        hit = probes.join(F.broadcast(seeds.filter(mine)), "seed").withColumns({"start": start, "words": F.size("hashes"), "near_seed": near_seed}).drop("hashes", "seed")
        found = hit.join(F.broadcast(items.filter(mine)), "item_key")
        near = found.withColumns({"window": window, "low": low, "high": high, "lag": lag}).filter("high - low >= window")
        local = near.select("id", "text_key", "item_key", "item_id", "window", agree.alias("agree"))
        return local.select("id", "text_key", "item_key", "item_id", "window", F.array_max(sums).alias("matched"))

    # written block by block, so one block's seeds are broadcast at a time, and the tasks that read documents hold no table of groups
    with narrow_reads(df.sparkSession):
        checked = reduce(DataFrame.unionByName, [materialised(hits(b).filter(F.col("matched") * 100 >= F.col("window") * SHARE)) for b in range(blocks)])
    pairs = checked.groupBy("id", "text_key", "item_key").agg(F.first("item_id").alias("item_id"), F.max("matched").alias("matched"), F.first("window").alias("window"))
    return pairs.drop("item_key")


def decontaminated(df: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """``df`` without the rows whose text overlaps with an item; other columns may have any name."""
    df, back = set_apart(df, [text_column])
    found = overlaps(df.select(F.lit(0).alias("doc_id"), text_column), benchmark, "doc_id", text_column).select(F.col("text_key").alias("_dc_key")).distinct()
    keyed = df.withColumn("_dc_key", F.xxhash64(text_column))
    return keyed.join(found, "_dc_key", "left_anti").select(*back)


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    pairs = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select(
        F.col("id").alias("doc_id"),
        "item_id",
        F.col("matched").cast("int").alias("matched"),
        F.col("window").cast("int").alias("window_words"),
    )


def _looked(mask: str, alias: str) -> str:
    return " || chr(31) || ".join(f"{alias}.w[{alias}.at + {o + 1}]" for o, c in enumerate(mask) if c == "1")


def _branch(mask: str) -> str:
    n = len(mask)
    return f"""SELECT d.doc_id, d.row_no, i.item_id, d.at AS d_at, i.at AS i_at, {n} AS span
  FROM doc_at d JOIN item_at i ON {_looked(mask, 'd')} = {_looked(mask, 'i')}
  WHERE d.at + {n} <= len(d.w) AND i.at + {n} <= len(i.w)"""


#: For benchmarks whose items have at least as many words as the shortest mask.
ORACLE_SQL = f"""
WITH doc_words AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         regexp_extract_all(lower(text), '[{LETTERS}]+') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (
  SELECT min(item_id) AS item_id, w FROM (
    SELECT item_id, regexp_extract_all(lower(text), '[{LETTERS}]+') AS w FROM benchmark WHERE text IS NOT NULL)
  WHERE len(w) > 0 GROUP BY w),
doc_at AS (SELECT doc_id, row_no, w, unnest(range(len(w))) AS at FROM doc_words),
item_at AS (SELECT item_id, w, unnest(range(len(w))) AS at FROM item_words),
hits AS ({' UNION ALL '.join(_branch(m) for m in MASKS)}),
lags AS (SELECT DISTINCT doc_id, row_no, item_id, d_at - i_at AS lag, i_at, span FROM hits),
near AS (
  SELECT l.doc_id, l.row_no, l.item_id, l.lag, least(len(i.w), {WINDOW}) AS win, d.w AS dw, i.w AS iw,
         greatest(0, l.i_at + l.span - least(len(i.w), {WINDOW}), -l.lag) AS low,
         least(len(i.w), l.i_at + least(len(i.w), {WINDOW}), len(d.w) - l.lag) AS high
  FROM lags l JOIN item_words i USING (item_id) JOIN doc_words d USING (row_no)),
starts AS (SELECT *, unnest(range(low, high - win + 1)) AS s FROM near WHERE high - low >= win),
sums AS (
  SELECT doc_id, row_no, item_id, win,
         len(list_filter(range(s, s + win), lambda k: dw[lag + k + 1] = iw[k + 1])) AS matched FROM starts)
SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched, CAST(first(win) AS INTEGER) AS window_words
FROM sums WHERE matched * 100 >= win * {SHARE} GROUP BY doc_id, row_no, item_id
"""
