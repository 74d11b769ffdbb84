"""Hard negatives: an exact join of anchors with all rows over Voronoi cells.

Vectors are scaled to whole numbers, and a row's score for an anchor is their inner product.
One more component, sqrt(M² - |x|²) for a row and 0 for an anchor, where M is the longest
norm, makes the highest score the least distance.  Pivots part that space into cells.

A search has windows of scores for each anchor, and asks for the first rows in each of them.
Anchors of near cells make a group of about GROUP.  They meet the rows of their own cells
first, and the k-th score found there narrows each window.  A window bounds the distance of
what can still be in it, and by the triangle inequality the distance of such a row from its own
pivot, for each cell; the bounds of a group's anchors together say which ring of which cell
is copied to the group.  There a block of rows is measured against the group at once, exactly.
Positives are one such search, their scores open the windows of the second one.

Cells are dealt out in parts of about PART rows by a hash of the id, and a group's rows in
slices of about SLICE parts, so a vector with very many copies, or an anchor group that many rows
serve, is many tasks.  A task holds one group and one block of rows.

Pivots come from SAMPLE rows at most; they and the counts of MOST_CELLS cells at most pass the
driver and are broadcast.  They decide what is measured where, never what is found.

Defined results: rows whose id, label or vector is null, whose vector is empty, holds a null
or non-finite component, or has another length than the most frequent one, take no part; nor
does a row beyond the first of those equal in id, label and scaled vector.  Rows that share
an id otherwise are rows of their own.  Zero vectors score 0 with all.  Ties go to the smaller
id.  With fewer positives or negatives all are given; without any there is no row.  An empty
table gives an empty table.  Products of more than 56 bits raise OverflowError.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialised, partitions, table

#: What one unit of a vector becomes.
SCALE = 256
#: Rows of a cell, about; most cells; rows that pivots are chosen from.
CELL, MOST_CELLS, SAMPLE = 2048, 2048, 8192
#: Anchors of a group; rows of a part of a cell; parts of a slice; rows measured at once.
GROUP, PART, SLICE, BLOCK = 256, 4096, 16, 2048
SEED = 20
LEAST, MOST = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Mining:
    """So many positives, and for each so many negatives that score ``least`` to ``most`` percent of it."""

    positives: int = 5
    negatives: int = 3
    least: int = 50
    most: int = 95


def _scaled(column: pa.Array) -> np.ndarray:
    """The vectors of a column, none null and all alike in length, as whole numbers in doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).reshape(len(column), -1)


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _scaled(batch.column("embedding"))
            found = [[batch.num_rows], [float((x * x).sum(axis=1).max())], [float(np.abs(x).max())]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["n", "norm", "largest"])


@dataclass(frozen=True)
class Space:
    """What is known of all rows: the square of the longest norm, how numbers are stored, and the pivots."""

    longest: float
    kind: str
    pivots: np.ndarray

    def lifted(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return np.concatenate([x, more[:, None]], axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = (points * points).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None, :]
        return np.sqrt(np.maximum(squares - 2 * points @ self.pivots.T, 0))

    def numbers(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        raw = b"".join(column.to_pylist())
        return np.frombuffer(raw, self.kind).reshape(len(column), self.pivots.shape[1] - 1)

    @property
    def slack(self) -> float:
        """More than rounding can take from a distance."""
        return 1e-6 * max(1.0, self.longest) ** 0.5


def _pivots(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` pivots at most: means of the sample's points about them."""
    pivots = np.unique(points[:n], axis=0)
    for _ in range(4):
        near = ((pivots * pivots).sum(axis=1)[None, :] - 2 * points @ pivots.T).argmin(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, points)
        held = np.bincount(near, minlength=len(pivots))
        pivots = sums[held > 0] / held[held > 0, None]
    return pivots


def _placed(space: Space):
    """Each row with its cell, its distance from that cell's pivot, and the cell it has as an anchor."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _scaled(batch.column("embedding")) if batch.num_rows else np.zeros((0, space.pivots.shape[1] - 1))
            far = space.distances(space.lifted(x))
            cell = far.argmin(axis=1)
            home = space.distances(space.lifted(x, anchors=True)).argmin(axis=1)
            small = [v.tobytes() for v in x.astype(space.kind)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("anchor"), pa.array(small, pa.binary()),
                 pa.array(cell.astype(np.int32)), pa.array(far.min(axis=1)), pa.array(home.astype(np.int32))],
                ["vec_id", "label", "anchor", "small", "cell", "away", "home"],
            )

    return place


def _leaves(pivots: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A group number for each cell: halves by halves, until a group weighs GROUP or is one cell."""
    out, todo, named = np.zeros(len(pivots), np.int64), [np.arange(len(pivots))], 0
    while todo:
        cells = todo.pop()
        if len(cells) == 1 or weight[cells].sum() <= GROUP:
            out[cells], named = named, named + 1
            continue
        centred = pivots[cells] - pivots[cells].mean(axis=0)
        axis = np.linalg.svd(centred, full_matrices=False)[2][0]
        order = cells[np.argsort(centred @ axis, kind="stable")]
        total = np.cumsum(weight[order])
        half = int(np.clip(np.searchsorted(total, total[-1] / 2) + 1, 1, len(order) - 1))
        todo += [order[:half], order[half:]]
    return out


@dataclass(frozen=True)
class Cells:
    """Rows in their cells, and what is known of each cell."""

    space: Space
    rows: DataFrame
    facts: DataFrame
    slices: int
    near: np.ndarray
    far: np.ndarray


def celled(df: DataFrame, anchor: Column) -> Cells | None:
    """``df`` (vec_id, label, embedding) in Voronoi cells; None without a row that takes part."""
    spark = df.sparkSession
    usual = df.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if not usual:
        return None
    whole = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") == usual["size"]) & whole
    vector = F.col("embedding").cast("array<double>")
    rows = df.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("embedding"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    known = rows.select("embedding").mapInArrow(_norms, "n long, norm double, largest double").agg(F.sum("n"), F.max("norm"), F.max("largest")).first()
    if not known[0]:
        return None
    n, longest, largest = known
    if longest >= 1 << 56:
        raise OverflowError("scores of more than 56 bits")
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(min(SAMPLE, n)).select("embedding").collect()  # SAMPLE rows at most
    space = Space(longest, kind, np.zeros((0, usual["size"] + 1)))
    sample = np.floor(SCALE * np.array([r["embedding"] for r in drawn], np.float64))
    space = Space(longest, kind, _pivots(space.lifted(sample), max(1, min(MOST_CELLS, n // CELL))))
    placed = rows.mapInArrow(_placed(space), "vec_id long, label long, anchor boolean, small binary, cell int, away double, home int")
    placed = materialised(placed.withColumn("own", F.xxhash64("label", "small")))
    size = len(space.pivots)
    count, weight, near, far = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, np.inf), np.full(size, -np.inf)
    for r in placed.groupBy("cell").agg(F.count("*"), F.min("away"), F.max("away")).collect():  # MOST_CELLS rows at most
        count[r[0]], near[r[0]], far[r[0]] = r[1], r[2], r[3]
    for r in placed.filter("anchor").groupBy("home").count().collect():  # MOST_CELLS rows at most
        weight[r[0]] = r[1]
    leaf = _leaves(space.pivots, weight)
    heavy = np.bincount(leaf, weights=weight)[leaf]
    parts, blocks = np.maximum(1, -(-count // PART)), np.maximum(1, np.ceil(heavy / GROUP)).astype(np.int64)
    facts = spark.createDataFrame([(c, int(parts[c]), int(leaf[c]), int(blocks[c])) for c in range(size)], "cell int, parts int, leaf long, blocks int")
    return Cells(space, placed, facts, max(1, -(-int(parts.sum()) // SLICE)), near, far)


def _routes(cells: Cells):
    """(grp, cell, lo, hi): the ring of each cell that can hold a row for some anchor of a batch."""
    space, near, far = cells.space, cells.near, cells.far
    between = space.distances(space.pivots)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = space.numbers(batch.column("small")).astype(np.float64)
            squares = (x * x).sum(axis=1) + space.longest
            to = space.distances(space.lifted(x, anchors=True))
            home = batch.column("home").to_numpy()
            apart = np.maximum(between[home], 1e-300)
            # a row of another cell lies beyond the plane between the two pivots
            beyond = np.where(np.arange(len(space.pivots)) == home[:, None], -np.inf, (to**2 - (to[np.arange(len(home)), home] ** 2)[:, None]) / (2 * apart))
            lows, highs = (np.array(batch.column(c).to_pylist(), np.float64).reshape(len(x), -1) for c in ("lows", "highs"))
            lo, hi = np.full(to.shape, np.inf), np.full(to.shape, -np.inf)
            for w in range(lows.shape[1]):
                most = np.sqrt(np.maximum(squares - 2 * lows[:, w], 0)) + space.slack
                least = np.sqrt(np.maximum(squares - 2 * highs[:, w], 0)) - space.slack
                a, b = np.maximum(to - most[:, None], least[:, None] - to), to + most[:, None]
                open_ = (lows[:, w] <= highs[:, w])[:, None] & (beyond <= most[:, None]) & (a <= far) & (b >= near)
                lo, hi = np.where(open_, np.minimum(lo, a), lo), np.where(open_, np.maximum(hi, b), hi)
            groups, at = np.unique(batch.column("grp").to_numpy(), return_inverse=True)
            low, high = np.full((len(groups), to.shape[1]), np.inf), np.full((len(groups), to.shape[1]), -np.inf)
            np.minimum.at(low, at, lo)
            np.maximum.at(high, at, hi)
            g, c = np.nonzero(low <= high)
            yield pa.RecordBatch.from_arrays([pa.array(groups[g]), pa.array(c.astype(np.int32)), pa.array(low[g, c]), pa.array(high[g, c])], ["grp", "cell", "lo", "hi"])

    return route


class _Block:
    """The anchors of one group in one task, and the first rows found so far in each window."""

    def __init__(self, rows: pa.Table, space: Space, same: bool, k: int):
        self.id, self.own, self.label = (rows[c].to_numpy() for c in ("vec_id", "own", "label"))
        self.x = space.numbers(rows["small"])
        self.exact = space.longest < 1 << 53
        self.lows, self.highs = (np.array(rows[c].to_pylist(), np.int64).reshape(len(rows), -1) for c in ("lows", "highs"))
        self.same, self.k = same, k
        shape = (*self.lows.shape, k)
        self.score, self.found, self.found_own = np.full(shape, LEAST), np.zeros(shape, np.int64), np.zeros(shape, np.int64)

    def meet(self, ids: np.ndarray, own: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        """Rows in ascending order of their ids, all of them after those that were met before."""
        kind = np.float64 if self.exact else np.int64
        scores = (self.x.astype(kind) @ x.astype(kind).T).astype(np.int64)
        fit = (self.label[:, None] == label) == self.same
        fit &= (self.id[:, None] != ids) | (self.own[:, None] != own)
        for w in range(self.lows.shape[1]):
            # a later id must score more than the last one kept
            floor = np.maximum(self.lows[:, w], self.score[:, w, -1] + 1)
            held = np.where(fit & (scores >= floor[:, None]) & (scores <= self.highs[:, w, None]), scores, LEAST)
            rows = np.flatnonzero(held.max(axis=1) > LEAST)
            if not len(rows):
                continue
            held = held[rows]
            if held.shape[1] > self.k:
                last = np.partition(held, -self.k, axis=1)[:, -self.k]
                held[held < last[:, None]] = LEAST
            r, c = np.nonzero(held > LEAST)
            old = np.nonzero(self.score[rows, w] > LEAST)
            row = np.concatenate([old[0], r])
            score = np.concatenate([self.score[rows[old[0]], w, old[1]], held[r, c]])
            name = np.concatenate([self.found[rows[old[0]], w, old[1]], ids[c]])
            mark = np.concatenate([self.found_own[rows[old[0]], w, old[1]], own[c]])
            order = np.lexsort((mark, name, -score, row))
            row, score, name, mark = row[order], score[order], name[order], mark[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = place < self.k
            at = (rows[row[kept]], w, place[kept])
            self.score[at], self.found[at], self.found_own[at] = score[kept], name[kept], mark[kept]

    def result(self) -> pa.RecordBatch:
        a, w, p = np.nonzero(self.score > LEAST)
        columns = {"anchor_id": self.id[a], "anchor_own": self.own[a], "w": w.astype(np.int32), "vec_id": self.found[a, w, p], "own": self.found_own[a, w, p], "score": self.score[a, w, p]}
        return pa.RecordBatch.from_pydict(columns)


_FOUND = "anchor_id long, anchor_own long, w int, vec_id long, own long, score long"


def _searched(space: Space, same: bool, k: int):
    """The first k rows in each window of each anchor, from batches sorted by group, slice, anchors first, and id."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, block, last = None, [], None, None
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in ("grp", "slice", "kind")]
            n = batch.num_rows
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in names], axis=0)) + 1 if n > 1 else np.zeros(0, int)
            bounds = [0, *edges.tolist(), n] if n else []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part, now = batch.slice(a, b - a), (int(names[0][a]), int(names[1][a]))
                if now != key:
                    if block is not None:
                        yield block.result()
                    key, waiting, block, last = now, [], None, None
                if not names[2][a]:
                    waiting.append(part)
                    continue
                if block is None and waiting:
                    block = _Block(pa.Table.from_batches(waiting), space, same, k)
                if block is None:
                    continue
                ids, own = part.column("vec_id").to_numpy(), part.column("own").to_numpy()
                fresh = np.ones(len(ids), bool)
                fresh[1:] = (ids[1:] != ids[:-1]) | (own[1:] != own[:-1])
                fresh[0] = (ids[0], own[0]) != last
                last = (ids[-1], own[-1])
                part = part.filter(pa.array(fresh))
                for at in range(0, part.num_rows, BLOCK):
                    some = part.slice(at, BLOCK)
                    block.meet(some.column("vec_id").to_numpy(), some.column("own").to_numpy(), some.column("label").to_numpy(), space.numbers(some.column("small")))
        if block is not None:
            yield block.result()

    return search


def _met(cells: Cells, anchors: DataFrame, routes: DataFrame, same: bool, k: int) -> DataFrame:
    """What each group's anchors find in the rings that ``routes`` (grp, cell, lo, hi) gives."""
    n = partitions(anchors.sparkSession)
    facts = F.broadcast(cells.facts.select("cell", "parts"))  # MOST_CELLS rows at most
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    slice_ = F.pmod(F.xxhash64("cell", "part"), F.lit(cells.slices)).cast("int")
    rows = cells.rows.join(facts, "cell").select("cell", part.alias("part"), "away", "vec_id", "own", "label", "small")
    asked = routes.join(facts, "cell").select("grp", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "lo", "hi").withColumn("slice", slice_)
    none = F.lit(None).cast("array<long>")
    copied = rows.join(asked, ["cell", "part"]).filter(F.col("away").between(F.col("lo"), F.col("hi")))
    copied = copied.select("grp", "slice", F.lit(1).alias("kind"), "vec_id", "own", "label", "small", none.alias("lows"), none.alias("highs"))
    asking = anchors.join(asked.select("grp", "slice").distinct(), "grp").select("grp", "slice", F.lit(0).alias("kind"), "vec_id", "own", "label", "small", "lows", "highs")
    both = asking.unionByName(copied).repartition(n, "grp", "slice").sortWithinPartitions("grp", "slice", "kind", "vec_id", "own")
    return both.mapInArrow(_searched(cells.space, same, k), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "anchor_own", "w").orderBy(F.desc("score"), "vec_id", "own")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def searched(cells: Cells, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, anchor_own, w, vec_id, own, score, place): the first k rows in each window, with the same label or another one."""
    own = anchors.select("grp", F.col("home").alias("cell")).distinct()
    near = materialised(_met(cells, anchors, own.select("*", F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi")), same, k))
    floors = _first(near, k).filter(F.col("place") == k).groupBy("anchor_id", "anchor_own").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("floors"))
    known = anchors.join(floors, (F.col("vec_id") == F.col("anchor_id")) & (F.col("own") == F.col("anchor_own")), "left")
    low = F.transform("lows", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("floors", w), x)))
    known = materialised(known.withColumn("lows", low).select(*anchors.columns))
    rings = known.repartition(partitions(anchors.sparkSession), "grp").mapInArrow(_routes(cells), "grp long, cell int, lo double, hi double")
    rings = rings.groupBy("grp", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(own, ["grp", "cell"], "left_anti")
    return _first(near.unionByName(_met(cells, known, rings, same, k)), k)


def _floor(a: Column, b: int) -> Column:
    """a / b, rounded down, in whole numbers."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b).cast("long"))


_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(df: DataFrame, anchor: Column, how: Mining = Mining()) -> DataFrame:
    """Hard negatives of the rows of ``df`` (vec_id, label, embedding) for which ``anchor`` is true."""
    cells = celled(df.select("vec_id", "label", "embedding"), anchor)
    if cells is None:
        return df.sparkSession.createDataFrame([], _MINED)
    facts = F.broadcast(cells.facts.select(F.col("cell").alias("home"), "leaf", "blocks"))  # MOST_CELLS rows at most
    grp = F.shiftleft("leaf", 32) + F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.col("blocks"))
    anchors = cells.rows.filter("anchor").join(facts, "home").select(grp.alias("grp"), "home", "vec_id", "own", "label", "small").distinct()
    everything = anchors.select("*", F.array(F.lit(LEAST)).alias("lows"), F.array(F.lit(MOST)).alias("highs"))
    found = searched(cells, materialised(everything), True, how.positives)
    positives = materialised(found.select("anchor_id", "anchor_own", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("place") - 1).alias("w")))
    windows = positives.groupBy("anchor_id", "anchor_own").agg(F.array_sort(F.collect_list(F.struct("w", "positive_score"))).alias("z"))  # ``positives`` of them
    lows = F.transform("z", lambda z: -_floor(-how.least * z["positive_score"], 100))
    highs = F.transform("z", lambda z: _floor(how.most * z["positive_score"], 100))
    # windows of an anchor are so many for all, the missing ones shut
    shut = lambda x, v: F.concat(x, F.array_repeat(F.lit(v), F.lit(how.positives) - F.size(x)))
    asked = anchors.join(windows, (F.col("vec_id") == F.col("anchor_id")) & (F.col("own") == F.col("anchor_own")))
    asked = materialised(asked.select(*anchors.columns, shut(lows, MOST).alias("lows"), shut(highs, LEAST).alias("highs")))
    negatives = searched(cells, asked, False, how.negatives)
    negatives = negatives.select("anchor_id", "anchor_own", "w", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").cast("int").alias("rank"))
    return positives.join(negatives, ["anchor_id", "anchor_own", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every fiftieth vector; every seventh label is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return mined(vectors, F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH scaled AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_inner_product(a.q, x.q)::BIGINT AS score
  FROM scaled a JOIN scaled x ON a.vec_id <> x.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
   AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
