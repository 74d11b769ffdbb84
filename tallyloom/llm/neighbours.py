"""Approximate nearest neighbours: a graph by NN-descent, and greedy search on it.

Equal vectors are one node.  The graph begins with neighbours found in the leaves of a few
random hyperplane trees, whose planes part a sample of SAMPLE nodes in halves, level by level,
so leaves are alike in size wherever the vectors lie.  Each round of NN-descent then joins every node with its neighbours
and the nodes that have it as a neighbour; within such a neighbourhood every pair is
measured, unless both were there before, and each member is told of those nearer than the
farthest it knows; neighbourhoods without a new member rest.  So a node meets its neighbours'
neighbours, until hardly anything changes.  Rounds measure vectors of
one byte a component.

A query starts at nodes of the leaves it falls into, and keeps the EF nearest nodes seen, by
exact distance.  In each round all queries together expand the nearest of them that aren't
expanded yet, through joins with the graph and the vectors, until none is left.

Nothing is gathered by key without a bound: leaves and neighbourhoods are streamed in parts,
of a node's reverse neighbours the nearest ones count, and of a query EF nodes are kept.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, nor do those of a length other than the most frequent; equal vectors are at distance 0
of each other; ties go to the smaller id; with fewer candidates than asked for all are
given; rows with a null id aren't candidates; of rows that agree in id and vector one
counts; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialised, partitions, runs, table

#: Neighbours of a node; trees, nodes in a leaf (about) and in a part of a leaf that is measured at once.
K, TREES, LEAF, PART = 24, 6, 128, 256
#: Rounds of NN-descent at most, and the part of all edges below whose change they end.
ROUNDS, SETTLED = 5, 0.02
#: Nearer nodes that a member is told of in one neighbourhood.
TOLD = 6
#: Nodes that a query keeps, expands in a round, and takes from each leaf to begin with.
EF, EXPANDED, STARTS = 128, 32, 16
#: Nodes by which trees are fitted, and how many of them a half must have to be halved by its own.
SAMPLE, HALVED = 4096, 16
SEED = 7


def _valid(vector: Column) -> Column:
    ordinary = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ordinary & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _planes(dims: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims, TREES * bits))


@dataclass(frozen=True)
class Forest:
    """TREES trees of ``bits`` levels: where each cell is parted along the plane of each level.

    Deeper than ``levels`` the sample says no more, and all that is below a cell is parted alike.
    """

    bits: int
    levels: int
    #: For each level, by tree and cell.
    borders: tuple[np.ndarray, ...]

    def cells(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each tree, the cells in which ``levels`` put the vectors, and their places along all planes."""
        along = (vectors @ _planes(vectors.shape[1], self.bits)).reshape(len(vectors), TREES, self.bits)
        for t in range(TREES):
            cell = np.zeros(len(vectors), np.int64)
            for level in range(self.levels):
                cell = 2 * cell + (along[:, t, level] > self.borders[level][t][cell])
            yield t, cell, along[:, t]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: a column for each tree."""
        out = np.zeros((len(vectors), TREES), np.int64)
        for t, cell, along in self.cells(vectors) if self.bits else ():
            leaf = cell
            for level in range(self.levels, self.bits):
                leaf = 2 * leaf + (along[:, level] > self.borders[level][t][cell])
            out[:, t] = leaf
        return out * TREES + np.arange(TREES)


def grown(sample: np.ndarray, bits: int) -> Forest:
    """Trees whose planes part the sample's cells in halves."""
    levels = min(bits, max(0, (len(sample) // HALVED).bit_length() - 1))
    borders: list[np.ndarray] = []
    for level in range(bits):
        known = Forest(bits, min(level, levels), tuple(borders))
        at = np.zeros((TREES, 1 << known.levels))
        for t, cell, along in known.cells(sample):
            at[t] = np.median(along[:, level])
            for c in np.unique(cell):
                at[t, c] = np.median(along[cell == c, level])
        borders.append(at)
    return Forest(bits, levels, tuple(borders))


def _placed(forest: Forest, carried: str):
    """Rows (leaf, order, carried columns) for each tree."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"))
            leaf = forest.leaves(vectors)
            order = vectors @ np.random.default_rng(SEED + 1).standard_normal((vectors.shape[1], TREES))
            for t in range(TREES):
                kept = [batch.column(c) for c in carried.split()]
                yield pa.RecordBatch.from_arrays([pa.array(leaf[:, t]), pa.array(order[:, t]), *kept], ["leaf", "sort", *carried.split()])

    return place


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = _matrix(batch.column("vector")).astype(np.float64)
        scale = np.abs(vectors).max(axis=1, keepdims=True, initial=0) if len(vectors) else vectors
        small = np.rint(vectors / scale * 127).astype(np.int8) if len(vectors) else vectors
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array([v.tobytes() for v in small], pa.binary()), pa.array(scale.ravel().astype(np.float32), pa.float32())], ["node", "small", "scale"]
        )


def _restored(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    small = np.frombuffer(b"".join(rows["small"].to_pylist()), np.int8).reshape(len(rows["small"]), -1)
    return small.astype(np.float32) * (rows["scale"].to_numpy()[:, None] / np.float32(127))


def _distances(x: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)
    out = np.maximum(squares[:, None] + squares[None, :] - 2 * (x @ x.T), 0)
    np.fill_diagonal(out, np.inf)
    return out


def _best(node: np.ndarray, near: np.ndarray, far: np.ndarray, k: int) -> pa.RecordBatch:
    """Of rows (node, near, squared distance) the k nearest of each node, each once."""
    order = np.lexsort((far, near, node))
    node, near, far = node[order], near[order], far[order]
    once = np.ones(len(node), bool)
    once[1:] = (node[1:] != node[:-1]) | (near[1:] != near[:-1])
    node, near, far = node[once], near[once], far[once]
    order = np.lexsort((near, far, node))
    node, near, far = node[order], near[order], far[order]
    fresh = np.ones(len(node), bool)
    fresh[1:] = node[1:] != node[:-1]
    starts = np.flatnonzero(fresh)
    rank = np.arange(len(node)) - starts[np.cumsum(fresh) - 1] if len(node) else np.zeros(0, np.int64)
    kept = rank < k
    return pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(near[kept]), pa.array(far[kept].astype(np.float32))], ["node", "near", "far"])


def _within_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for leaf in runs(_cut(batches, "leaf", PART), "part"):
        node, x = leaf["node"].to_numpy(), _restored(leaf)
        far = _distances(x)
        k = min(K, len(node) - 1)
        if k < 1:
            continue
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        rows = np.repeat(np.arange(len(node)), k)
        yield _best(node[rows], node[near.ravel()], far[rows, near.ravel()], K)


def _cut(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches with a column ``part``: a number for each ``most`` rows of a key."""
    last, held, part = None, 0, 0
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        fresh[0] = keys[0] != last
        starts = np.flatnonzero(fresh)
        at = np.arange(len(keys))
        seen = np.cumsum(fresh)
        begun = np.concatenate([[-held], starts])[seen] if not fresh[0] else starts[seen - 1]
        place = at - begun
        new = fresh | (place % most == 0)
        numbers = part + np.cumsum(new)
        part, last, held = int(numbers[-1]), keys[-1], int(place[-1]) + 1
        yield batch.append_column("part", pa.array(numbers.astype(np.int64)))


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    told: list[list[np.ndarray]] = [[], [], []]
    held = 0
    for group in runs(_cut(batches, "centre", PART), "part"):
        node, x, known = group["node"].to_numpy(), _restored(group), group["farthest"].to_numpy()
        new = group["new"].to_numpy()
        if not new.any():
            continue
        far = _distances(x)
        far[(far >= known[:, None]) | ~(new[:, None] | new[None, :])] = np.inf
        k = min(TOLD, len(node) - 1)
        if k < 1:
            continue
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        rows = np.repeat(np.arange(len(node)), k)
        distance = far[rows, near.ravel()]
        true = np.isfinite(distance)
        for out, column in zip(told, (node[rows[true]], node[near.ravel()[true]], distance[true]), strict=True):
            out.append(column)
        held += int(true.sum())
        if held > 1 << 19:
            yield _best(*(np.concatenate(c) for c in told), K)
            told, held = [[], [], []], 0
    if held:
        yield _best(*(np.concatenate(c) for c in told), K)


def _top(edges: DataFrame) -> DataFrame:
    """The K nearest of each node among edges (node, near, far)."""
    order = Window.partitionBy("node").orderBy("far", "near")
    once = edges.groupBy("node", "near").agg(F.min("far").alias("far"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= K)


def graph(nodes: DataFrame, forest: Forest) -> DataFrame:
    """Edges (node, near, far, rank) of the neighbour graph of ``nodes`` (node, vector)."""
    n = partitions(nodes.sparkSession)
    small = materialised(nodes.mapInArrow(_bytes, "node long, small binary, scale float"))
    leaves = nodes.join(small, "node").mapInArrow(_placed(forest, "node small scale"), "leaf long, sort double, node long, small binary, scale float")
    first = leaves.repartition(n, "leaf").sortWithinPartitions("leaf", "sort").mapInArrow(_within_leaves, "node long, near long, far float")
    edges = materialised(_top(first).withColumn("new", F.lit(True)))
    total = edges.count()
    for _ in range(ROUNDS):
        back = edges.withColumn("place", F.row_number().over(Window.partitionBy("near").orderBy("far", "node"))).filter(F.col("place") <= K)
        links = edges.select(F.col("node").alias("centre"), F.col("near").alias("node"), "new").unionByName(back.select(F.col("near").alias("centre"), "node", "new"))
        links = links.groupBy("centre", "node").agg(F.max("new").alias("new"))
        links = links.join(edges.filter("new").select(F.col("node").alias("centre")).unionByName(back.filter("new").select(F.col("near").alias("centre"))).distinct(), "centre", "left_semi")
        farthest = edges.groupBy("node").agg(F.when(F.count("*") >= K, F.max("far")).otherwise(float("inf")).cast("float").alias("farthest"))
        known = small.join(farthest, "node", "left").withColumn("farthest", F.coalesce("farthest", F.lit(float("inf")).cast("float")))
        members = links.join(known, "node").select("centre", "node", "small", "scale", "farthest", "new")
        told = members.repartition(n, "centre").sortWithinPartitions("centre").mapInArrow(_neighbourhoods, "node long, near long, far float")
        before = edges.select("node", "near", F.lit(False).alias("old"))
        top = _top(edges.select("node", "near", "far").unionByName(told)).join(before, ["node", "near"], "left")
        after = materialised(top.withColumn("new", F.coalesce("old", F.lit(True))).drop("old"))
        changed = after.filter("new").count()
        discard(edges)
        edges = after
        if changed <= SETTLED * total:
            break
    return edges


def _moved(state: pa.Table, found: pa.Table) -> pa.Table:
    """A query's nodes after those just found are measured: the EF nearest, and which are to be expanded."""
    if not len(state):
        return state
    query = np.array(state["vector"][0].as_py(), np.float64)
    ids, far, done = (np.array(state[c][0].as_py(), t) for c, t in (("nodes", np.int64), ("far", np.float64), ("done", bool)))
    done = done | np.array(state["now"][0].as_py(), bool)
    new, at = np.unique(found["met"].to_numpy(), return_index=True)
    fresh = ~np.isin(new, ids)
    if fresh.any():
        vectors = _matrix(found["place"].combine_chunks().take(pa.array(at[fresh]))).astype(np.float64)
        measured = np.sqrt(((vectors - query) ** 2).sum(axis=1))
        ids, far, done = np.concatenate([ids, new[fresh]]), np.concatenate([far, measured]), np.concatenate([done, np.zeros(int(fresh.sum()), bool)])
    order = np.lexsort((ids, far))[:EF]
    ids, far, done = ids[order], far[order], done[order]
    now = ~done & (np.cumsum(~done) <= EXPANDED)
    columns = {"query": state["query"], "vector": state["vector"]}
    columns |= {k: pa.array([v.tolist()], t) for k, v, t in (("nodes", ids, pa.list_(pa.int64())), ("far", far, pa.list_(pa.float64())), ("done", done, pa.list_(pa.bool_())), ("now", now, pa.list_(pa.bool_())))}
    return pa.table(columns)


_STATE = "query long, vector array<double>, nodes array<long>, far array<double>, done array<boolean>, now array<boolean>"


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, forest: Forest) -> DataFrame:
    """(query, node, far) of the EF nearest nodes found for each of ``queries`` (query, vector)."""
    wide = queries.select("query", F.col("vector").cast("array<double>").alias("vector"))
    asked = wide.mapInArrow(_placed(forest, "query"), "leaf long, sort double, query long").select("leaf", "query").distinct()
    leaves = nodes.mapInArrow(_placed(forest, "node"), "leaf long, sort double, node long")
    starts = leaves.withColumn("place", F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("node", "leaf"), "node"))).filter(F.col("place") <= STARTS)
    seeds = asked.join(starts.select("leaf", "node"), "leaf").select("query", "node").distinct()
    near = edges.select("node", F.col("near").alias("next"))
    none = [F.array().cast(t).alias(c) for c, t in (("nodes", "array<long>"), ("far", "array<double>"), ("done", "array<boolean>"), ("now", "array<boolean>"))]
    state = wide.select("query", "vector", *none)
    found = seeds
    for turn in count():  # a query expands a node once, so this ends
        measured = found.join(nodes, "node").select(F.col("query").alias("asked"), F.col("node").alias("met"), F.col("vector").alias("place"))
        moved = materialised(state.groupBy("query").cogroup(measured.groupBy("asked")).applyInArrow(_moved, _STATE))
        if turn:
            discard(state)
        state = moved
        expand = state.select("query", F.explode(F.arrays_zip("nodes", "now")).alias("z")).filter("z.now").select("query", F.col("z.nodes").alias("node"))
        if not expand.head(1):
            break
        found = expand.join(near, "node").select("query", F.col("next").alias("node")).distinct()
    return state.select("query", F.explode(F.arrays_zip("nodes", "far")).alias("z")).select("query", F.col("z.nodes").alias("node"), F.col("z.far").alias("far"))


def nearest(df: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``df`` (vec_id, embedding) for each of ``queries`` (the same)."""
    usual = df.filter(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dims = usual["size"] if usual else 0
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") == dims) & _valid(F.col("embedding"))
    # 0.0 and -0.0 are one number
    vector = F.transform("embedding", lambda x: F.when(x == 0, 0).otherwise(x))
    rows = df.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).withColumn("hash", F.xxhash64("vector"))
    asked = queries.filter(ok).select(F.col("vec_id").cast("long").alias("query"), vector.alias("vector")).dropDuplicates(["query"])
    # equal vectors, not those of equal hashes, are one node; of them the k + 1 smallest ids can be among the k nearest
    place = F.dense_rank().over(Window.partitionBy("hash", "vector").orderBy("vec_id"))
    held = materialised(rows.withColumn("place", place).filter(F.col("place") <= k + 1).distinct())
    apart = materialised(held.filter("place = 1").select(F.monotonically_increasing_id().alias("node"), "hash", "vector"))
    members = materialised(held.join(apart, ["hash", "vector"]).select("node", "vec_id"))
    nodes = apart.select("node", "vector")
    bits = max(0, (nodes.count() // LEAF).bit_length() - 1)
    drawn = apart.orderBy(F.xxhash64("hash", F.lit(SEED)), "hash").limit(SAMPLE).select("vector").collect() if bits else []  # SAMPLE rows at most
    forest = grown(np.array([r["vector"] for r in drawn], np.float64), bits)
    edges = graph(nodes, forest)
    found = search(asked.select("query", "vector"), nodes, edges, forest)
    few = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("far", "node"))).filter(F.col("place") <= k + 1)
    named = few.join(members.select("node", "vec_id"), "node").filter(F.col("vec_id") != F.col("query"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("far", "vec_id"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", F.col("far").alias("score"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all other embeddings for every hundredth one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
