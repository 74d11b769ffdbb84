"""N-gram Jaccard self-join of whole texts by a size-aware heavy-light join.

Sets are shingle sets, and documents with equal sets form one class from the start.

* Light sets (fewer shingles than the boundary) enumerate subsets of fixed sizes: similar
  sets share the subset that is their intersection, and it lacks few of either.
* Heavy sets go into inverted lists of shingles.  How many sets hold a shingle is counted
  first, up to CAP.  Similar sets share one of their rarest few shingles (as many as may
  differ, and one), so a set is listed under those alone, and a set is in no list if so many
  of its shingles are held by itself alone.  Postings travel packed, by bucket of the
  shingle, and what a chunk of documents holds often is counted before it travels.

The boundary is where enumeration becomes dearer than lists, from the histogram of sizes.

Lists are scanned in sorted order.  In a list of up to LISTED sets, pairs of fitting sizes
are counted: how many of their rarest shingles two sets share bounds how many they share in
all, and pairs that can't be similar by that bound go before anything is linked.  In a
longer list, as groups of near copies have them, all members are linked to the least one.
What is linked so is a cluster of candidates.  Its sets are held against each other exactly,
in blocks of BLOCK sets, inside tasks: first each block within itself and with some members
that stand for the cluster, and then, of the pairs of blocks, those that these links don't
join yet.  So a large group of near copies costs about one comparison with its own block for
each member.  Links have components, and every document gets its component's smallest id.
Nothing is dropped: a list or cluster may be of any size.

Documents are read twice and addressed by partition and row, so the input should be a table
or a materialised frame, whose partitions come out alike each time.

Defined results: null texts and texts without words have no shingles and are linked with
nothing; repeated rows are rows of their own with the same component; a null id counts as
no id for the component; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, discard, materialised, partitions, runs, set_apart, table
from .graph import components
from .words import mix, shingle_sets

#: Sets that are held against each other at once; members that stand for a large cluster, about.
BLOCK, STANDING = 128, 16
#: Sets that hold a shingle are counted up to this.
CAP = 64
#: Sets of a list whose pairs are counted; the pairs of a longer one aren't.
LISTED = 32
#: Documents in a chunk, and its shingles (about, but of one document); shingles that are packed at once; and those of a bucket, about.
CHUNK, CHUNK_SHINGLES, PACKED, BUCKET = 4096, 1 << 20, 1 << 18, 1 << 19
#: What a packed posting costs beside a plain row.
POSTING = 0.4

_MARK = np.uint64(0xA24BAED4963EE407)
_KEY_BITS, _COUNTED = 48, 0xFFFF


@dataclass(frozen=True)
class Likeness:
    """Sets of ``width``-word shingles are similar if 100 * intersection >= ``percent`` * union."""

    width: int = 3
    percent: int = 90

    @property
    def least(self) -> int:
        """Smaller sets are similar to none but equal ones."""
        return -(-self.percent // (100 - self.percent))

    @property
    def boundaries(self) -> list[int]:
        """Sizes from which a subset may lack one, two and three shingles."""
        return [-(-100 * k // (100 - self.percent)) for k in (1, 2, 3)]

    def lacking(self, n: int) -> int:
        """How many of ``n`` shingles the intersection with a similar set may lack."""
        return n * (100 - self.percent) // 100

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many of their rarest shingles similar sets of ``a`` and ``b`` shingles share at least.

        A set's rarest are so many that it can't lack them all, p = n - ceil(percent * n) + 1.
        Where the last of x's isn't after the last of y's, those of x that y holds are among y's
        rarest too, so the intersection has at most the shared rarest and n - p others.
        """
        least = -(-self.percent * (a + b) // (100 + self.percent))
        others = np.maximum(-(-self.percent * a // 100), -(-self.percent * b // 100)) - 1
        return np.maximum(least - others, 1)

    def boundary(self, histogram: dict[int, int]) -> int:
        """Where heavy sets begin; ``histogram``: sets by size, for sizes under the last boundary."""

        def cost(edge: int) -> float:
            light = sum(k * sum(comb(n, i) for i in range(self.lacking(n) + 1)) for n, k in histogram.items() if self.least <= n < edge)
            heavy = sum(k * (POSTING * n + self.lacking(n) + 1) for n, k in histogram.items() if n >= self.least and 100 * n >= self.percent * edge)
            return light + heavy

        return min(self.boundaries, key=cost)


def set_class(shingles: np.ndarray) -> int:
    """One number for equal sets."""
    if not len(shingles):
        return 0
    with np.errstate(over="ignore"):
        total = mix(shingles * _MARK).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total]) ^ np.bitwise_xor.reduce(shingles)).view(np.int64)[0])


class Addresses:
    """(chunk, place) of the documents of a partition in turn, from the sizes of their sets."""

    def __init__(self) -> None:
        self.chunk = TaskContext.get().partitionId() << 32
        self.place, self.held = -1, 0

    def next(self, size: int) -> tuple[int, int]:
        self.place += 1
        self.held += size
        if self.place == CHUNK or self.place and self.held > CHUNK_SHINGLES:
            self.chunk, self.place, self.held = self.chunk + 1, 0, size
        return self.chunk, self.place


def _described(like: Likeness):
    """What is kept of each document: class, size, address, and the shingles of a small set."""
    small = like.boundaries[-1]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        addresses = Addresses()
        for batch in batches:
            cls, size, chunk, place, own = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), like.width):
                at = addresses.next(len(s))
                cls.append(set_class(s))
                size.append(len(s))
                chunk.append(at[0])
                place.append(at[1])
                own.append(s.tobytes() if like.least <= len(s) < small else None)
            columns = [pa.array(c, pa.int64()) for c in (cls, size, chunk, place)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns, pa.array(own, pa.binary())], ["doc_id", "text_key", "cls", "n_shingles", "chunk", "place", "small"])

    return describe


def _subset_signatures(s: np.ndarray, lacking: int) -> np.ndarray:
    n = len(s)
    terms = mix(s ^ _MARK)
    whole = terms.sum(dtype=np.uint64)
    sums = [np.array([whole])]
    for k in range(1, lacking + 1):
        chosen = np.array(list(combinations(range(n), k)))
        sums.append(whole - terms[chosen].sum(axis=1, dtype=np.uint64))
    sized = [x + np.array([n - k], np.uint64) * _MARK for k, x in enumerate(sums)]
    return mix(np.concatenate(sized))


def _signature_batch(signature: np.ndarray, cls: np.ndarray, size: np.ndarray, most: int) -> pa.RecordBatch:
    """Rows (signature, class, size, whole) of a batch: lists of more than ``most`` classes are linked here.

    All of such a list are linked to its least class; a link is two rows under a signature of
    its own, and one row, not ``whole``, says that the list is linked as such.
    """
    order = np.lexsort((cls, signature))
    signature, cls, size = signature[order], cls[order], size[order]
    fresh = np.ones(len(signature), bool)
    fresh[1:] = signature[1:] != signature[:-1]
    starts = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    long = (np.diff(np.append(starts, len(signature))) > most)[group]
    least = cls[starts[group]]
    links = np.unique(np.stack([least, cls], 1)[long & (cls != least)], axis=0)
    own = mix(mix(links[:, 0].view(np.uint64)) * _MARK + links[:, 1].view(np.uint64))
    sent = ~long | fresh
    none = np.zeros(2 * len(links), np.int64)
    columns = (
        np.concatenate([signature[sent], own, own]).view(np.int64),
        np.concatenate([cls[sent], links[:, 0], links[:, 1]]),
        np.concatenate([size[sent], none]).astype(np.int64),
        np.concatenate([~long[sent], none.astype(bool)]),
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["signature", "cls", "n", "whole"])


def _light(like: Likeness):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = dict(zip(batch.column("cls").to_pylist(), batch.column("small").to_pylist(), strict=True))
            found = {cls: _subset_signatures(s := np.frombuffer(raw, np.uint64), like.lacking(len(s))) for cls, raw in sets.items()}
            if found:
                # equal subsets are nearly proof, so all are linked
                cls = np.repeat(np.array(list(found), np.int64), [len(x) for x in found.values()])
                yield _signature_batch(np.concatenate(list(found.values())), cls, np.zeros(len(cls), np.int64), 0)

    return signatures


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)[:, :width].T.tobytes()


def _packed(keys: np.ndarray, *rest: np.ndarray) -> bytes:
    """Ascending keys as steps, and other columns, byte plane by byte plane."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(_planes(steps, 8) + b"".join(_planes(r, r.itemsize) for r in rest))


def _unpacked(raw: bytes, *kinds: str) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    widths = [8, *(np.dtype(k).itemsize for k in kinds)]
    n, at, out = len(data) // sum(widths), 0, []
    for kind, width in zip(("<u8", *kinds), widths, strict=True):
        out.append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _postings(like: Likeness, edge: int, bits: int):
    """Packed (shingle, place in the chunk) by bucket of the shingle; ``known``: counted already."""
    dropped = np.uint64(max(0, 64 - bits - _KEY_BITS))

    def packed(chunk: int, shingles: list[np.ndarray], places: list[int]) -> Iterator[tuple[int, int, bool, bytes]]:
        keys = np.concatenate(shingles) >> dropped
        place = np.repeat(np.array(places, np.uint16), [len(s) for s in shingles])
        order = np.argsort(keys, kind="stable")
        keys, place = keys[order], place[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(fresh)
        often = np.diff(np.append(starts, len(keys)))[np.cumsum(fresh) - 1] >= CAP
        if often.any():
            # a bucket of its own for what needn't be counted any more, and one posting that stands for it
            yield (chunk * 0x9E3779B1) % (1 << bits), chunk, True, _packed(keys[often], place[often])
            place = np.where(often & fresh, _COUNTED, place).astype(np.uint16)
            kept = ~often | fresh
            keys, place = keys[kept], place[kept]
        bucket = keys >> (np.uint64(64 - bits) - dropped)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
            yield int(bucket[a]), chunk, False, _packed(keys[a:b], place[a:b])

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "chunk", "known", "packed"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        addresses, held, shingles, places, seen, chunk = Addresses(), 0, [], [], set(), -1
        for batch in batches:
            for s in shingle_sets(batch.column("text"), like.width):
                now, place = addresses.next(len(s))
                if now != chunk or held > PACKED:
                    if shingles:
                        yield sent(list(packed(chunk, shingles, places)))
                    held, shingles, places, chunk = 0, [], [], now
                    seen.clear()
                if len(s) >= like.least and 100 * len(s) >= like.percent * edge and (cls := set_class(s)) not in seen:
                    seen.add(cls)
                    shingles.append(mix(s + _MARK))
                    places.append(place)
                    held += len(s)
        if shingles:
            yield sent(list(packed(chunk, shingles, places)))

    return post


def _counted(postings: pa.Table) -> pa.Table:
    """The postings of one bucket that several sets hold, with their number, packed for each chunk."""
    chunks, blobs = [], []
    keys, place, source = [], [], []
    for i, (chunk, known, raw) in enumerate(zip(*(postings[c].to_pylist() for c in ("chunk", "known", "packed")), strict=True)):
        k, p = _unpacked(raw, "<u2")
        if known:
            chunks.append(chunk)
            blobs.append(_packed(k, p, np.full(len(k), CAP, np.uint8)))
        else:
            keys.append(k)
            place.append(p)
            source.append(np.full(len(k), i, np.int32))
    if keys:
        key, at, of = (np.concatenate(c) for c in (keys, place, source))
        order = np.argsort(key, kind="stable")
        key, at, of = key[order], at[order], of[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        held = np.add.reduceat(np.where(at == _COUNTED, CAP, 1), starts)
        held = np.repeat(np.minimum(held, CAP), np.diff(np.append(starts, len(key)))).astype(np.uint8)
        kept = (held > 1) & (at != _COUNTED)
        key, at, of, held = key[kept], at[kept], of[kept], held[kept]
        order = np.argsort(of, kind="stable")
        key, at, of, held = key[order], at[order], of[order], held[order]
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        owner = postings["chunk"].to_numpy()
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=False):
            chunks.append(int(owner[of[a]]))
            blobs.append(_packed(key[a:b], at[a:b], held[a:b]))
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "packed": pa.array(blobs, pa.binary())})


def _listed(like: Likeness, most: int):
    """A chunk's sets under their rarest shingles: (signature, cls, n, whole)."""

    def listed(sets: pa.Table, shared: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        empty = pa.Table.from_batches([_signature_batch(none.view(np.uint64), none, none, most)])
        if not len(sets) or not len(shared):
            return empty
        size, cls = np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
        place = sets["place"].to_numpy()
        size[place], cls[place] = sets["n_shingles"].to_numpy(), sets["cls"].to_numpy()
        parts = [_unpacked(raw, "<u2", "u1") for raw in shared["packed"].to_pylist()]
        key, at, held = (np.concatenate(c) for c in zip(*parts, strict=True))
        # of a set's rarest shingles those that no other set holds come first
        alone = size - np.bincount(at, minlength=CHUNK)
        need = size - (like.percent * size + 99) // 100 + 1 - alone
        kept = need[at] > 0
        key, at, held = key[kept], at[kept], held[kept]
        order = np.lexsort((key, held, at))
        key, at = key[order], at[order]
        if not len(at):
            return empty
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        kept = rank < need[at]
        return pa.Table.from_batches([_signature_batch(mix(key[kept] ^ _MARK), cls[at[kept]], size[at[kept]], most)])

    return listed


def _scan(like: Likeness, most: int):
    """Of lists, from rows sorted by signature and class: links (least class, class) with ``shared`` 0, and pairs with the lists that they share and must share."""

    def linked(signature: np.ndarray, cls: np.ndarray, n: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        fresh = np.ones(len(signature), bool)
        fresh[1:] = signature[1:] != signature[:-1]
        starts = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        counted = ((np.diff(np.append(starts, len(signature))) <= most) & np.logical_and.reduceat(whole, starts))[group]
        leader = cls[starts[group]]
        links = np.unique(np.stack([leader, cls], 1)[~counted & (leader != cls)], axis=0)
        parts = []
        for step in range(1, most):
            i = np.flatnonzero(counted[:-step] & (group[:-step] == group[step:]))
            if not len(i):
                break
            low, high = np.minimum(n[i], n[i + step]), np.maximum(n[i], n[i + step])
            fits = 100 * low >= like.percent * high
            parts.append(np.stack([cls[i], cls[i + step], like.common(low, high)], 1)[fits])
        pairs, often = np.unique(np.concatenate(parts), axis=0, return_counts=True) if parts else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        none = np.zeros(len(links), np.int64)
        columns = (np.append(links[:, 0], pairs[:, 0]), np.append(links[:, 1], pairs[:, 1]), np.append(none, often), np.append(none, pairs[:, 2]))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "b", "shared", "least"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("signature", "cls", "n", "whole")]
            if not len(rows[0]):
                continue
            if tail:
                rows = [np.concatenate([t, r]) for t, r in zip(tail, rows, strict=True)]
            once = np.ones(len(rows[0]), bool)
            once[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            # a list that isn't whole stays so
            whole = np.logical_and.reduceat(rows[3], np.flatnonzero(once))
            rows = [*(r[once] for r in rows[:3]), whole]
            last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            tail = [r[last:] for r in rows]
            if last:
                yield linked(*(r[:last] for r in rows))
            if len(tail[0]) > most or not tail[3].all():
                # its least class stands for what has been linked of it
                tail[3][0] = False
                yield linked(*tail)
                tail = [t[:1] for t in tail]
        if tail:
            yield linked(*tail)

    return scan


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left]).reshape(len(left), len(right))
    every = np.concatenate([*left, *right])
    sizes = [len(s) for s in (*left, *right)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, often = np.unique(every, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    number = np.cumsum(often > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(left), len(right)), np.float32)
    width = max(256, min(8192, (1 << 22) // (len(left) + len(right))))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        dense = np.zeros((len(sizes), width), np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        total += dense[: len(left)] @ dense[len(left) :].T
    return total.astype(np.int64)


def _similar(group: pa.Table, like: Likeness) -> tuple[list[int], list[int]]:
    """Links that join what isn't joined yet, among a block or between two."""
    cls, block = group["cls"].to_pylist(), group["block"].to_numpy()
    sets = list(shingle_sets(group["text"].combine_chunks(), like.width))
    sides = np.unique(block)
    left = np.flatnonzero(block == sides[0])
    right = np.flatnonzero(block == sides[-1])
    size = np.array([len(s) for s in sets])
    common = _common([sets[i] for i in left], [sets[i] for i in right])
    union = size[left][:, None] + size[right][None, :] - common
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for i, j in np.argwhere(100 * common >= like.percent * union).tolist():
        x, y = root(left[i]), root(right[j])
        if x != y:
            parent[x] = y
            a.append(cls[left[i]])
            b.append(cls[right[j]])
    return a, b


def _verified(like: Likeness):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "task"):
            a, b = _similar(group, like)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return verify


_LISTS = "signature long, cls long, n long, whole boolean"


def _candidates(docs: DataFrame, described: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) of classes that may be similar; what is similar is in one component of them."""
    spark = docs.sparkSession
    n = partitions(spark)
    sizes = described.filter(F.col("n_shingles") < like.boundaries[-1]).groupBy("n_shingles").agg(F.count("*").alias("n")).collect()  # as many rows as sizes
    edge = like.boundary({r["n_shingles"]: r["n"] for r in sizes})
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max((4 * n - 1).bit_length(), (total // BUCKET).bit_length())
    light = described.filter((F.col("n_shingles") >= like.least) & (F.col("n_shingles") < edge)).select("cls", "small").mapInArrow(_light(like), _LISTS)
    postings = docs.mapInArrow(_postings(like, edge, bits), "bucket int, chunk long, known boolean, packed binary")
    shared = postings.groupBy("bucket").applyInArrow(_counted, "chunk long, packed binary")
    sets = described.filter(F.col("n_shingles") >= like.least).select("chunk", "place", "cls", "n_shingles")
    heavy = sets.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_listed(like, LISTED), _LISTS)
    lists = light.unionByName(heavy).repartition(n, "signature").sortWithinPartitions("signature", "cls")
    found = lists.mapInArrow(_scan(like, LISTED), "a long, b long, shared long, least long")
    # a link says that two sets may be similar, whatever they share besides
    pairs = found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least"))
    return pairs.filter("shared >= least").select("a", "b")


def _proved(tasks: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Links of classes that are similar, from tasks (cls, component, block, other)."""
    pair = F.struct(F.least("block", "other"), F.greatest("block", "other"))
    keyed = tasks.select("cls", F.xxhash64("component", pair).alias("task"), F.col("block").cast("long").alias("block"))
    rows = texts.join(keyed, "cls").select("task", "cls", "block", "text")
    return rows.repartition(partitions(texts.sparkSession), "task").sortWithinPartitions("task", "block").mapInArrow(_verified(like), "a long, b long")


def _upto(low: str, high: str):
    """The numbers from ``low`` to below ``high``."""
    return F.expr(f"IF({low} < {high}, sequence({low}, {high} - 1), CAST(array() AS array<bigint>))")


def _first_tasks(members: DataFrame) -> DataFrame:
    """Each block within itself, joined by those that stand for a cluster of several blocks."""
    own = members.select("cls", "component", "block", F.col("block").alias("other"))
    standing = members.filter((F.col("blocks") > 1) & (F.pmod(F.xxhash64("cls", F.lit(1)), F.col("size")) < STANDING))
    guests = standing.select("cls", "component", F.explode(_upto("0", "blocks")).alias("block"), F.col("block").alias("home")).filter("block <> home")
    return own.unionByName(guests.select("cls", "component", "block", F.col("block").alias("other")))


def _second_tasks(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs of blocks of large clusters, but those within what is joined already.

    A joined group that fills a block has blocks of its own; the others share blocks.
    """
    named = members.filter("blocks > 1").join(joined.select(F.col("node").alias("cls"), F.col("component").alias("group")), "cls", "left")
    named = named.select("cls", "component", F.coalesce("group", "cls").alias("group"))
    groups = named.groupBy("component", "group").agg(F.count("*").alias("n"))
    full = F.col("n") >= BLOCK
    # a row for each group that fills a block; their places come from a running sum over those
    large = groups.filter(full).select("component", "group", F.ceil(F.col("n") / BLOCK).alias("own"))
    shared = groups.groupBy("component").agg(F.ceil(F.sum(F.when(~full, F.col("n")).otherwise(0)) / BLOCK).alias("shared"), F.sum(F.when(full, F.ceil(F.col("n") / BLOCK)).otherwise(0)).alias("pure"))
    from pyspark.sql import Window

    before = Window.partitionBy("component").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    placed = large.withColumn("start", F.coalesce(F.sum("own").over(before), F.lit(0)))
    rows = named.join(shared, "component").join(placed, ["component", "group"], "left")
    rows = rows.withColumn("last", F.col("shared") + F.col("pure"))
    pure = F.col("own").isNotNull()
    block = F.when(pure, F.col("shared") + F.col("start") + F.pmod(F.xxhash64("cls"), F.col("own"))).otherwise(F.pmod(F.xxhash64("group"), F.col("shared")))
    rows = rows.select(
        "cls",
        "component",
        block.alias("block"),
        "last",
        F.when(pure, F.col("shared") + F.col("start")).otherwise(F.col("last")).alias("low"),
        F.when(pure, F.col("shared") + F.col("start") + F.col("own")).otherwise(F.col("last")).alias("high"),
    )
    return rows.select("cls", "component", "block", F.explode(F.concat(_upto("0L", "low"), _upto("high", "last"))).alias("other"))


def similar_groups(df: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """For each row of ``df`` (doc_id, text): doc_id, text_key, n_shingles, cls, component, component_id.

    ``cls`` is equal for equal sets, ``text_key`` a hash of the text; ``component`` names a group
    by its least class, whatever its ids are, and ``component_id`` by its smallest id.
    """
    docs = df.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    kind = dict(df.dtypes)["doc_id"]
    described = materialised(docs.mapInArrow(_described(like), f"doc_id {kind}, text_key long, cls long, n_shingles long, chunk long, place long, small binary"))
    clusters = materialised(components(_candidates(docs, described, like)))

    counts = clusters.groupBy("component").agg(F.count("*").alias("size"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = clusters.join(counts, "component").select(F.col("node").alias("cls"), "component", "size", "blocks")
    members = materialised(members.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks"))))
    # one row stands for each class of a cluster, and its text is fetched once
    stands = described.join(members.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
    chosen = stands.select("cls", F.col("r.doc_id").alias("r_id"), F.col("r.text_key").alias("r_key"))
    texts = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("r_id")) & F.col("text_key").eqNullSafe(F.col("r_key"))).select("cls", "text")
    texts = materialised(texts.dropDuplicates(["cls"]))
    first = materialised(_proved(_first_tasks(members), texts, like))
    links = first
    if members.filter("blocks > 1").head(1):
        links = first.unionByName(_proved(_second_tasks(members, components(first)), texts, like))
    joined = components(links).select(F.col("node").alias("cls"), "component")
    for done in (clusters, members, texts, first):
        discard(done)

    classes = described.groupBy("cls").agg(F.min("doc_id").alias("first_id")).join(joined, "cls", "left")
    classes = classes.withColumn("component", F.coalesce("component", "cls"))
    least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = classes.join(least, "component").select("cls", "component", "component_id")
    return described.join(known, "cls").select(
        "doc_id",
        "text_key",
        "n_shingles",
        "cls",
        "component",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(df: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """``df`` with one row of each group of similar texts: the row of the smallest id.

    Ids name no group: unlike texts all stay, with equal ids or none.  Rows without words are
    all kept; of rows that agree in id and text one stays.  Other columns may have any name.
    """
    df, back = set_apart(df, ["doc_id", "text"])
    groups = similar_groups(df, like).filter("n_shingles > 0")
    # nulls last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("r")
    keys = groups.groupBy("component").agg(first).select(F.col("r.doc_id").alias("_jg_id"), F.col("r.text_key").alias("_jg_key"))
    marked = df.withColumn("_jg_text", F.xxhash64("text"))
    wordless = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)) == 0
    kept = marked.filter(~wordless).join(keys, F.col("doc_id").eqNullSafe(F.col("_jg_id")) & (F.col("_jg_text") == F.col("_jg_key")), "left_semi")
    single = kept.dropDuplicates(["doc_id", "_jg_text"])
    return single.unionByName(marked.filter(wordless)).select(*back)


def op8_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under Jaccard links of three-word shingles."""
    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
k AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r, r AS o FROM d UNION SELECT reach.r, k.b FROM reach JOIN k ON k.a = reach.o)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id
FROM d JOIN reach ON reach.r = d.r JOIN d e ON e.r = reach.o LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""
