"""Cross-tokenizer alignment: which tokens of two vocabularies stand for each other.

A text is encoded by a byte-level BPE (A) and by a piece vocabulary (B).  Where tokens of both
end at one byte, a group ends; within a group each A token is linked with each B token.  A
pair's count is the number of documents that hold it linked, over the corpus.

Each document is encoded once.  A task turns an Arrow batch of documents, a block, into one row
a document and, for each stripe of A ids (id modulo STRIPES), the block's distinct pairs with
the documents that hold them: an inverted list, a byte or so for each place.  These are written
once, and give both the counts and the scores.  Pairs are dealt out by stripe and added up in a dense
matrix, a row for each A id of the stripe and a column for each B id; the maxima of its rows are what is best.  The
links are then dealt out by the same stripes, each stripe's counts with them, and give for each
block what its documents get from the stripe; a block's sums meet its rows at the end.

Stripes are salted by block (SALTED blocks each), so an id that is in every document is many
tasks; a task holds one matrix (about 100 MB) and one block's rows of a stripe.

Texts of more than LONG characters are encoded in stretches, parted before a single space
between two words, where neither vocabulary has a token that passes.

Defined results: texts that are null or empty, or whose tokens don't give back the bytes of a
space and the text, have no tokens: all their numbers are 0 and the digest is empty; repeated
rows are documents of their own, as are rows with a null id; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialised, partitions, table

#: Stripes of A ids; blocks of a salt.
STRIPES, SALTED = 128, 4096
#: Characters of a stretch; pairs of a group that are written out one by one.
LONG, FEW = 1 << 16, 1024

_BREAK = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Characters of classes that no version of Unicode has changed, so that any library splits them alike.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ɏ‐-‧]*")


@dataclass(frozen=True)
class Vocabularies:
    """Paths: A for ``tokenizers``, its ranks for ``tiktoken`` (None: A is used alone), and B for ``sentencepiece``."""

    a: str
    b: str
    ranks: str | None = None

    @staticmethod
    def public() -> Vocabularies:
        import public_tokenizers

        path = public_tokenizers.path
        return Vocabularies(path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"))


def _byte_signs() -> dict[str, int]:
    """Byte-level BPE writes bytes that can't be printed as the characters from U+0100 on, in order."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Pair:
    """Both encoders, and the bytes of each of their tokens."""

    def __init__(self, paths: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(paths.a)
        self.library.encode_special_tokens = True
        self.pieces = SentencePieceProcessor(model_file=paths.b)
        self.fast = self._ranked(paths.ranks) if paths.ranks else None
        signs = _byte_signs()
        size = max(self.library.get_vocab(True).values()) + 1
        self.a = [b""] * size
        for token, i in self.library.get_vocab(True).items():
            self.a[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
        self.a_size, self.b_size = (np.array([len(t) for t in side], np.int64) for side in (self.a, self.b))
        # what stands for a token within its group, and at the end of its side; shorter ones are filled up with zero bytes
        self.signs = np.array([f"{i}{end}".encode() for side, ends in ((self.a, ",|"), (self.b, ",;")) for end in ends for i in range(len(side))])

    @staticmethod
    def _ranked(path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def stretches(self, text: str) -> list[str]:
        """A space and the text, in stretches that each begin with a space."""
        out, at = [], 0
        while len(text) - at > LONG and (found := _BREAK.search(text, at + LONG)):
            out.append(" " + text[at : found.start()])
            at = found.end()
        return [*out, " " + text[at:]]

    def encoded_a(self, stretch: str) -> np.ndarray:
        if self.fast is not None and _PLAIN.fullmatch(stretch):
            return self.fast.encode_to_numpy(stretch, disallowed_special=())
        return np.array(self.library.encode(stretch, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids, or None where they don't give the text's bytes."""
        parts = self.stretches(text)
        a = np.concatenate([self.encoded_a(p) for p in parts]).astype(np.int64)
        pieces = self.pieces.encode([p[1:] for p in parts], num_threads=1)
        b = [i for ids in pieces for i in ids] if len(pieces) > 1 else pieces[0]
        want = b" " + text.encode()
        if b"".join(map(self.b.__getitem__, b)) != want:
            return None
        a_whole = int(self.a_size[a].sum()) == len(want) and (self.fast is not None and _PLAIN.fullmatch(text) or b"".join(map(self.a.__getitem__, a.tolist())) == want)
        return (a, np.array(b, np.int64)) if a_whole else None

    def aligned(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Tokens of both sides, groups, links, the digest of the groups; distinct pairs as a * |B| + b, and how often each."""
        ids = self.encode(text) if text else None
        if ids is None:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = ids
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        of_a, of_b = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        n_a, n_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
        a_done, b_done = np.cumsum(n_a), np.cumsum(n_b)
        links = n_a * n_b
        written = np.empty(len(a) + len(b), np.int64)
        a_at, b_at = np.arange(len(a)), np.arange(len(b))
        written[a_at + (b_done - n_b)[of_a]] = a + len(self.a) * (a_at + 1 == a_done[of_a])
        written[b_at + a_done[of_b]] = b + len(self.b) * (b_at + 1 == b_done[of_b]) + 2 * len(self.a)
        digest = hashlib.sha256(self.signs[written].tobytes().translate(None, b"\0")[:-1]).hexdigest()
        few = links <= FEW
        often = np.where(few[of_a], n_b[of_a], 0)
        first = np.repeat((b_done - n_b)[of_a] - (np.cumsum(often) - often), often)
        found, times = [np.repeat(a, often) * len(self.b) + b[first + np.arange(int(often.sum()))]], [np.ones(int(often.sum()), np.int64)]
        for g in np.flatnonzero(~few).tolist():  # distinct ids only, each with its frequency
            own_a, times_a = np.unique(a[a_done[g] - n_a[g] : a_done[g]], return_counts=True)
            own_b, times_b = np.unique(b[b_done[g] - n_b[g] : b_done[g]], return_counts=True)
            found.append((own_a[:, None] * len(self.b) + own_b).ravel())
            times.append((times_a[:, None] * times_b).ravel())
        pairs, at = np.unique(np.concatenate(found), return_inverse=True)
        held = np.zeros(len(pairs), np.int64)
        np.add.at(held, at, np.concatenate(times))
        return len(a), len(b), len(ends), int(links.sum()), digest, pairs, held


@lru_cache(maxsize=1)
def pair_of(paths: Vocabularies) -> Pair:
    return Pair(paths)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, below 2^32, byte plane by byte plane."""
    planes = [np.ascontiguousarray(c.astype("<u4")).view(np.uint8).reshape(-1, 4).T for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def _unpack(raw: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in planes]


def _wide(*columns: np.ndarray) -> bytes:
    """As ``_pack``, for numbers of any size."""
    return _pack(*(half for c in columns for half in (c & 0xFFFFFFFF, c >> 32)))


def _unwide(raw: bytes, columns: int) -> list[np.ndarray]:
    halves = _unpack(raw, 2 * columns)
    return [low | (high << 32) for low, high in zip(halves[::2], halves[1::2], strict=True)]


def _linked(paths: Vocabularies):
    """A row for each document (stripe null), and one for each stripe of a block's pairs."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part = pair_of(paths), TaskContext.get().partitionId()
        wide = len(both.b)
        for n, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            block = (part << 32) + n
            told = [both.aligned(t) for t in batch.column("text").to_pylist()]
            size = len(told)
            document = dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), zip(*(t[:5] for t in told), strict=True), strict=True))
            numbers = [pa.array(document[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            empty = [pa.nulls(size, t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, block)), pa.array(np.arange(size, dtype=np.int32)), batch.column("doc_id"), *numbers, pa.array(document["groups_sha256"], pa.string()), *empty], _LINKED
            )
            pairs, times = np.concatenate([t[5] for t in told]), np.concatenate([t[6] for t in told])
            if not len(pairs):
                continue
            holder = np.repeat(np.arange(size), [len(t[5]) for t in told])
            a = pairs // wide
            stripe, place = a % STRIPES, a // STRIPES * wide + pairs % wide
            # holders ascend already
            order = np.argsort(stripe * (-(-len(both.a) // STRIPES) * wide) + place, kind="stable")
            stripe, place, holder, times = stripe[order], place[order], holder[order], times[order]
            named, starts = np.unique(stripe, return_index=True)
            packed: list[tuple[bytes, bytes]] = []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(stripe)], strict=True):
                own, at, held = np.unique(place[lo:hi], return_index=True, return_counts=True)
                step = np.diff(holder[lo:hi], prepend=0)
                step[at] = holder[lo:hi][at]
                packed.append((_pack(own, held), _pack(step, times[lo:hi])))
            m = len(named)
            texts = [pa.nulls(m, t) for t in (batch.schema.field("doc_id").type, *[pa.int64()] * 4, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, block)), pa.nulls(m, pa.int32()), *texts, pa.array(named.astype(np.int32)), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], _LINKED
            )

    return link


_LINKED = ["block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "stripe", "pairs", "holders"]


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, dict]]:
    """Rows of batches sorted by stripe and salt, each with its key and whether that is a new one."""
    before = None
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["stripe"], row["salt"])
            yield key, key != before, row
            before = key


def _matrix(a_size: int, b_size: int) -> np.ndarray:
    return np.zeros((-(-a_size // STRIPES)) * b_size, np.int64)


def _counted(a_size: int, b_size: int, wide: bool):
    """The sums of a stripe's counts, as (stripe, salt, counts); ``wide``: what comes in are such sums."""

    def summed(key: tuple[int, int], matrix: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(matrix)
        return pa.RecordBatch.from_pylist([{"stripe": key[0], "salt": key[1], "counts": _wide(at, matrix[at])}], _COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, matrix = None, _matrix(a_size, b_size)
        for now, fresh, row in _stripes(batches):
            if fresh and key is not None:
                yield summed(key, matrix)
                matrix[:] = 0
            key = now
            np.add.at(matrix, *(_unwide(row["counts"], 2) if wide else _unpack(row["counts"], 2)))
        if key is not None:
            yield summed(key, matrix)

    return count


_COUNTS = pa.schema([("stripe", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])


def _scored(a_size: int, b_size: int):
    """What each block's documents get from a stripe, from batches in which a stripe's counts stand first."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = _matrix(a_size, b_size)
        best = matrix.reshape(-1, b_size).max(axis=1)
        for _, fresh, row in _stripes(batches):
            if fresh:
                matrix[:] = 0
            if row["holders"] is None:
                at, counts = _unwide(row["counts"], 2)
                matrix[at] = counts
                best = matrix.reshape(-1, b_size).max(axis=1)
                continue
            own, held = _unpack(row["counts"], 2)
            step, times = _unpack(row["holders"], 2)
            starts = np.cumsum(held) - held
            walked = np.cumsum(step)
            walked -= np.repeat(walked[starts] - step[starts], held)
            count = matrix[own]
            holder, at = np.unique(walked, return_inverse=True)
            sums, hits = np.zeros(len(holder), np.int64), np.zeros(len(holder), np.int64)
            np.add.at(sums, at, times * np.repeat(count, held))
            np.add.at(hits, at, times * np.repeat(count == best[own // b_size], held))
            yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]], pa.int64()), "gained": pa.array([_wide(holder, hits, sums)], pa.binary())})

    return score


def _settled(documents: pa.Table, gains: pa.Table) -> pa.Table:
    """A block's documents with their sums over all stripes."""
    place = documents["place"].to_numpy()
    hits, sums = np.zeros(place.max(initial=-1) + 1, np.int64), np.zeros(place.max(initial=-1) + 1, np.int64)
    for raw in gains["gained"].to_pylist():
        holder, hit, value = _unwide(raw, 3)
        hits[holder] += hit
        sums[holder] += value
    kept = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(hits[place])).append_column("count_sum", pa.array(sums[place])).append_column("groups_sha256", documents["groups_sha256"])


def linked(df: DataFrame, paths: Vocabularies) -> DataFrame:
    """Documents and their links by block and stripe, encoded once and written."""
    docs = df.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    return materialised(docs.mapInArrow(
        _linked(paths), f"block long, place int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, pairs binary, holders binary"
    ))


def _sizes(paths: Vocabularies) -> tuple[int, int]:
    both = pair_of(paths)
    return len(both.a), len(both.b)


def pair_counts(links: DataFrame, paths: Vocabularies) -> DataFrame:
    """(stripe, salt, counts): for each stripe of A ids the packed counts of its pairs."""
    n, (a_size, b_size) = partitions(links.sparkSession), _sizes(paths)
    kind = "stripe int, salt int, counts binary"
    rows = links.filter("stripe is not null").select("stripe", _salt(_salts(links)).alias("salt"), F.col("pairs").alias("counts"))
    first = rows.repartition(n, "stripe", "salt").sortWithinPartitions("stripe", "salt").mapInArrow(_counted(a_size, b_size, False), kind)
    if _salts(links) == 1:
        return first
    return first.withColumn("salt", F.lit(0)).repartition(n, "stripe").sortWithinPartitions("stripe").mapInArrow(_counted(a_size, b_size, True), kind)


def _salts(links: DataFrame) -> int:
    return -(-max(1, links.filter("place = 0").count()) // SALTED)


def _salt(salts: int):
    return F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")


def aligned(df: DataFrame, paths: Vocabularies) -> DataFrame:
    """For each row of ``df`` (doc_id, text) its tokens, groups and links, scored by the counts of the corpus."""
    n, (a_size, b_size) = partitions(df.sparkSession), _sizes(paths)
    links = linked(df, paths)
    salts = _salts(links)
    counts = materialised(pair_counts(links, paths))
    none = F.lit(None)
    known = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), none.cast("long").alias("block"), "counts", none.cast("binary").alias("holders"))
    rows = links.filter("stripe is not null").select("stripe", _salt(salts).alias("salt"), "block", F.col("pairs").alias("counts"), "holders")
    both = known.unionByName(rows).repartition(n, "stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("block").asc_nulls_first())
    gains = both.mapInArrow(_scored(a_size, b_size), "block long, gained binary")
    documents = links.filter("place is not null").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    kind = dict(df.dtypes)["doc_id"]
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.groupBy("block").cogroup(gains.groupBy("block")).applyInArrow(_settled, out)


def best_pairs(df: DataFrame, paths: Vocabularies) -> DataFrame:
    """(a, b, n_documents): for each A id the B ids that are linked with it in the most documents, all of those that tie."""
    _, b_size = _sizes(paths)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, counts = _unwide(row["counts"], 2)
                own = at // b_size
                best = np.zeros(own.max(initial=0) + 1, np.int64)
                np.maximum.at(best, own, counts)
                kept = counts == best[own]
                yield pa.RecordBatch.from_pydict({"a": own[kept] * STRIPES + row["stripe"], "b": at[kept] % b_size, "n_documents": counts[kept]})

    links = linked(df, paths)
    out = materialised(pair_counts(links, paths).mapInArrow(top, "a long, b long, n_documents long"))
    discard(links)
    return out


def op13_striped_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document, and how the corpus counts those links."""
    return aligned(table(spark, sf_dir, "documents"), Vocabularies.public())
