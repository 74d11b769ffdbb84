"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to.  A network
carries words from patterns to the quotas of their sources; using a pattern a second time
costs more than using it once (convex repetition costs), so the flow repeats documents only
where a quota can't be met otherwise.  A document may count for all its sources, or for one of
its own (``own``) while its pattern is that of its text, held by other documents in other sources:
then what a pattern has to give once is its different texts, and a quota is met by texts that
only its source has before those that several sources would repeat.  What a pattern has to give is then drawn from its
documents in seeded hash order: whole passes first, and for the rest a hash below which
documents are taken, with a few further documents that fill what the last one left.

Sources and patterns stay tables, however many they are.  Where a source is in no pattern
with another, its flow is known: its quota, as far as its words go.  The others are solved by
connected part of the network, each in a task; a part has patterns, not documents.  No
pattern is ever gathered into one task: only documents of the hash bucket in which the cut
lies are, some thousand of them.

Defined results: a null source is a source of its own, after all others; null and empty
texts have size 0 and are never counted; rows that agree in id and text are taken alike; a
document without sources isn't taken; a source without words has target 0; an empty table
gives an empty table; other columns travel along (those that begin with ``_mix_`` are
refused).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialised, partitions, table, word_count
from .graph import components

SEED = 20240601
#: The part of all words that the mix takes, and the weights of the sources in turn.
BUDGET, WEIGHTS = 1.5, (5.0, 2.0, 1.0)
#: How often a document may be taken, and what each further time costs.
MAX_COPIES, REPEAT_COSTS = 2, (0, 1)
#: Tables of no more rows (patterns or sources) are broadcast; beyond that, they are joined.
FEW = 20_000
#: Documents of a pattern in one hash bucket, about; and how many documents fill up at the cut.
BUCKET, FILL = 1024, 16

Key = tuple[str | None, ...]
#: What stands for a row's own source where that is null; others are marked in front.
NONE = "-"


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``number``, from 0 in order of code point, null last: counted by ranges, not by one task."""
    spark = sources.sparkSession
    ranged = sources.repartitionByRange(partitions(spark), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    held = materialised(ranged)
    counts = sorted((r["part"], r["n"]) for r in held.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    begun = F.broadcast(spark.createDataFrame(starts, "part int, begun long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return held.join(begun, "part").select("source", "size", (F.col("begun") + place - 1).alias("number"))


def weighted_targets(sources: DataFrame, budget: float = BUDGET, weights: Sequence[float] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """``sources`` (source, size) with ``target``: shares of ``budget`` times all sizes by weight, none above ``most`` times its size.

    What is cut off is shared again by weight, until none is above; each round is an aggregate.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = materialised(_numbered(sources).select("source", "size", weight.alias("weight")))
    full = F.lit(False)
    total = weighed.agg(F.sum("size")).first()[0] or 0
    count = 0
    while True:
        open_ = weighed.filter(~full).agg(F.sum("weight")).first()[0]
        given = weighed.filter(full).agg(F.sum(most * F.col("size"))).first()[0] or 0
        left = budget * float(total) - float(given)
        share = F.lit(left) * F.col("weight") / F.lit(open_ or 1.0)
        # a source that was full stays so: the share of the others only grows
        full = full | (share > most * F.col("size"))
        now = weighed.filter(full).count()
        if now == count or not open_:
            break
        count = now
        full = F.lit(left) * F.col("weight") / F.lit(open_) > most * F.col("size")
    return weighed.select("source", "size", F.when(full, most * F.col("size")).otherwise(share).cast("double").alias("target"))


def route(
    capacity: dict[Key, int],
    quota: dict[str | None, int],
    costs: Sequence[int] = REPEAT_COSTS,
    rooms: dict[tuple[Key, str | None], int] | None = None,
) -> dict[Key, dict[str | None, int]]:
    """The cheapest flow of most words from patterns to quotas; ``rooms``: the most that a source takes from a pattern.

    A pattern's words are used once for the first cost, again for the next one, and so on.

    Primal-dual: in each round the arcs on cheapest paths are saturated as a network of their
    own, level by level, so there are as many rounds as costs of paths, not as paths.
    """
    patterns, sources = list(capacity), list(quota)
    place = {("s", x): 2 + len(patterns) + i for i, x in enumerate(sources)}
    heads: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(sources))]

    def arc(a: int, b: int, most: int, price: int) -> int:
        for end, n, c, start in ((b, most, price, a), (a, 0, -price, b)):
            out[start].append(len(heads))
            heads.append(end)
            room.append(n)
            cost.append(c)
        return len(heads) - 2

    carried: dict[tuple[Key, str | None], int] = {}
    for i, p in enumerate(patterns):
        for price, words in _tiers(capacity[p], costs, None if rooms is None else sum(rooms.get((p, x), 0) for x in p)):
            arc(0, 2 + i, words, price)
        for x in set(p):
            carried[p, x] = arc(2 + i, place["s", x], capacity[p] * len(costs) if rooms is None else rooms.get((p, x), 0), 0)
    for x in sources:
        arc(place["s", x], 1, quota[x], 0)
    while True:
        far: list[int | None] = [None] * len(out)
        far[0] = 0
        waiting = deque([0])
        while waiting:
            a = waiting.popleft()
            for e in out[a]:
                b, reached = heads[e], far[a] + cost[e]
                if room[e] and (far[b] is None or reached < far[b]):
                    far[b] = reached
                    waiting.append(b)
        if far[1] is None:
            break
        while True:
            level: list[int | None] = [None] * len(out)
            level[0] = 0
            waiting = deque([0])
            while waiting:
                a = waiting.popleft()
                for e in out[a]:
                    b = heads[e]
                    if room[e] and level[b] is None and far[b] == far[a] + cost[e]:
                        level[b] = level[a] + 1
                        waiting.append(b)
            if level[1] is None:
                break
            next_ = [0] * len(out)
            path: list[int] = []
            a = 0
            while True:
                if a == 1:
                    amount = min(room[e] for e in path)
                    for e in path:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    short = next(i for i, e in enumerate(path) if not room[e])
                    a = heads[path[short] ^ 1]
                    del path[short:]
                while next_[a] < len(out[a]):
                    e = out[a][next_[a]]
                    b = heads[e]
                    if room[e] and level[b] == level[a] + 1 and far[b] == far[a] + cost[e]:
                        break
                    next_[a] += 1
                else:
                    if not path:
                        break
                    a = heads[path.pop() ^ 1]
                    next_[a] += 1
                    continue
                path.append(e)
                a = b
    found: dict[Key, dict[str | None, int]] = {p: {} for p in patterns}
    for (p, x), e in carried.items():
        found[p][x] = room[e ^ 1]
    return found


def _tiers(words: int, costs: Sequence[int], most: int | None) -> list[tuple[int, int]]:
    """(cost, words): a pattern's words once for each cost, and up to ``most`` in doubling steps that cost more and more."""
    if most is None:
        return [(price, words) for price in costs]
    out, step, left = [], max(words, 1), most
    prices = count(costs[-1] + 1)
    for price in costs:
        out.append((price, min(step, left)))
        left -= out[-1][1]
    while left > 0:
        step *= 2
        out.append((next(prices), min(step, left)))
        left -= out[-1][1]
    return out


def _routed(costs: Sequence[int], owned: bool):
    def routed(rows: pd.DataFrame) -> pd.DataFrame:
        """What each pattern of one part of the network gives; ``owned``: what each of its sources gets."""
        # in one order, so that of flows that cost the same each run finds the same
        order = sorted(range(len(rows)), key=lambda i: ([(x is None, x or "") for x in rows["_mix_pattern"].iat[i]], rows["_mix_own"].iat[i]))
        rows = rows.iloc[order]
        patterns = [tuple(None if x is None else str(x) for x in p) for p in rows["_mix_pattern"]]
        quota = {x: int(q) for p, qs in zip(patterns, rows["quotas"], strict=True) for x, q in zip(p, qs, strict=True)}
        if not owned:
            flow = route(dict(zip(patterns, (int(n) for n in rows["size"]), strict=True)), quota, costs)
            used = [sum(flow[p].values()) for p in patterns]
        else:
            # a cell is a pattern's documents in one source
            own = [None if x == NONE else x[1:] for x in rows["_mix_own"]]
            once: dict[Key, float] = {}
            for p, n in zip(patterns, rows["once"], strict=True):
                once[p] = once.get(p, 0.0) + float(n)
            rooms = {(p, x): len(costs) * int(n) for p, x, n in zip(patterns, own, rows["size"], strict=True)}
            flow = route({p: round(n) for p, n in once.items()}, quota, costs, rooms)
            used = [flow[p].get(x, 0) for p, x in zip(patterns, own, strict=True)]
        return pd.DataFrame({"_mix_id": rows["_mix_id"], "used": used})

    return routed


def _flow(patterns: DataFrame, costs: Sequence[int], owned: bool) -> DataFrame:
    """(_mix_id, used) of patterns with ``quotas``, their sources'."""
    several = patterns.filter(F.size("_mix_pattern") > 1)
    alone = F.when(F.size("_mix_pattern") == 1, F.least(F.col("quotas")[0], F.col("size") * len(costs))).otherwise(F.lit(0)).cast("long")
    if not several.head(1):
        return patterns.select("_mix_id", alone.alias("used"))
    each = patterns.select("_mix_id", "_mix_pattern", F.explode("_mix_pattern").alias("source"), F.size("_mix_pattern").alias("n")).withColumn("node", F.xxhash64(F.lit("source"), "source"))
    touched = each.filter("n > 1").select("node").distinct()
    # patterns and sources are the nodes of a network's parts
    tied = each.join(touched, "node").select(F.xxhash64(F.lit("pattern"), "_mix_pattern").alias("a"), F.col("node").alias("b"), "_mix_id")
    part = components(tied.select("a", "b")).select(F.col("node").alias("a"), F.col("component").alias("part"))
    parts = materialised(tied.select("_mix_id", "a").distinct().join(part, "a").select("_mix_id", "part"))
    solved = patterns.join(parts, "_mix_id").select("_mix_id", "_mix_pattern", "_mix_own", "size", "once", "quotas", "part").groupBy("part").applyInPandas(_routed(costs, owned), "_mix_id long, used long")
    return patterns.join(parts, "_mix_id", "left_anti").select("_mix_id", alone.alias("used")).unionByName(solved)


def _cut(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one pattern's bucket: the hash below which all is taken, and further hashes that fit."""
    rows = rows.sort_values("draw")
    sizes, draws, left = rows["size"].to_numpy(), rows["draw"].to_numpy(), int(rows["left"].iat[0])
    sums = np.cumsum(sizes)
    n = int(np.searchsorted(sums, left, "right"))
    left -= int(sums[n - 1]) if n else 0
    fill: list[int] = []
    order = np.lexsort((draws[n:], -sizes[n:])) + n
    for i in order.tolist():
        if len(fill) == FILL or left <= 0:
            break
        if 0 < sizes[i] <= left:
            fill.append(int(draws[i]))
            left -= int(sizes[i])
    below = int(draws[n]) if n < len(draws) else None
    return pd.DataFrame({"_mix_id": [rows["_mix_id"].iat[0]], "below": pd.array([below], "Int64"), "fill": [fill]})


def mixed(
    df: DataFrame,
    targets: Callable[[DataFrame], DataFrame],
    sources: Column,
    size: Column,
    draw: Column,
    costs: Sequence[int] = REPEAT_COSTS,
    own: Column | None = None,
    alike: Column | None = None,
) -> DataFrame:
    """``df`` with ``copies``, the times a row is taken, ``source_sizes`` and ``targets`` by source.

    ``sources`` is an array, ``size`` a long, ``draw`` a seeded 64-bit hash of the row.
    ``targets`` adds words wanted, ``target``, to rows (source, size); a document of several
    sources counts in the size of each of them.  With ``own`` a row counts for that one of its sources
    alone, ``alike`` rows hold the same words, and ``source_sizes`` and ``targets`` are those of its own.
    """
    if any(c.startswith("_mix_") for c in df.columns):
        raise ValueError("columns that begin with _mix_ can't be mixed")
    pattern = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    name = F.lit("") if own is None else F.coalesce(F.concat(F.lit("+"), own), F.lit(NONE))
    share = F.lit(1) if alike is None else alike
    marked = df.select("*", pattern.alias("_mix_pattern"), name.alias("_mix_own"), size.cast("long").alias("_mix_size"), draw.alias("_mix_draw"), share.alias("_mix_alike"))
    narrow = materialised(marked.select("_mix_pattern", "_mix_own", F.col("_mix_size").alias("size"), F.col("_mix_draw").alias("draw"), "_mix_alike"))
    cell = ["_mix_pattern", "_mix_own"]
    patterns = narrow.groupBy(*cell).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.sum(F.col("size") / F.col("_mix_alike")).alias("once"))
    patterns = materialised(patterns.withColumn("_mix_id", F.monotonically_increasing_id()))
    each = patterns.select("_mix_id", "_mix_own", F.posexplode("_mix_pattern").alias("place", "source"), F.col("size").alias("own"))
    counted = each if own is None else each.filter(F.col("_mix_own") == F.coalesce(F.concat(F.lit("+"), "source"), F.lit(NONE)))
    wanted = materialised(targets(counted.groupBy("source").agg(F.sum("own").alias("size"))))
    named = each.join(wanted, each["source"].eqNullSafe(wanted["source"])).select("_mix_id", "place", each["source"], wanted["size"], "target")
    listed = named.groupBy("_mix_id").agg(F.array_sort(F.collect_list(F.struct("place", "size", "target", "source"))).alias("l"))  # as many as a pattern has sources
    of_sources = listed.select("_mix_id", "l", F.transform("l.target", lambda t: F.floor(t + 0.5)).alias("quotas"))
    mine = F.col("l") if own is None else F.filter("l", lambda x: F.col("_mix_own") == F.coalesce(F.concat(F.lit("+"), x["source"]), F.lit(NONE)))
    known = patterns.join(of_sources, "_mix_id", "left").withColumn("l", mine)
    known = materialised(known.select(*patterns.columns, "quotas", F.col("l.size").alias("source_sizes"), F.col("l.target").alias("targets")))
    bits = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.floor(F.col("n") / BUCKET), F.lit(1))))).cast("int")
    given = known.join(_flow(known, costs, own is not None), "_mix_id")
    whole = F.when(F.col("size") > 0, F.floor(F.col("used") / F.col("size"))).otherwise(0).cast("long")
    left = F.when(F.col("size") > 0, F.col("used") % F.col("size")).otherwise(0).cast("long")
    plans = materialised(given.select("_mix_id", *cell, whole.alias("passes"), left.alias("left"), bits.alias("bits"), "source_sizes", "targets"))
    beside = F.broadcast if plans.count() <= FEW else lambda side: side
    # the sign bit is flipped, so buckets ascend with the hash
    bucket = F.expr("IF(bits = 0, 0L, shiftrightunsigned(draw ^ (-9223372036854775807L - 1L), 64 - bits))")
    open_ = narrow.join(beside(plans.filter("left > 0")), cell).withColumn("bucket", bucket)
    sums = open_.groupBy("_mix_id", "left", "bucket").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("_mix_id").orderBy("bucket")  # 2^bits rows at most
    at = (
        sums.withColumn("sum", F.sum("size").over(upto))
        .filter("sum - size < left AND left <= sum")
        .select("_mix_id", "bucket", (F.col("left") - F.col("sum") + F.col("size")).alias("left"))
    )
    inside = open_.drop("left").join(beside(at), ["_mix_id", "bucket"])
    cuts = (
        inside.groupBy("_mix_id", "left", "draw")
        .agg(F.sum("size").alias("size"))
        .groupBy("_mix_id")
        .applyInPandas(_cut, "_mix_id long, below long, fill array<long>")
    )
    ends = cuts.join(at.select("_mix_id", F.col("bucket").alias("_mix_bucket")), "_mix_id")
    decisions = materialised(plans.join(ends, "_mix_id", "left").drop("_mix_id"))
    joined = marked.join(beside(decisions), cell)
    here = F.expr("IF(bits = 0, 0L, shiftrightunsigned(_mix_draw ^ (-9223372036854775807L - 1L), 64 - bits))")
    below = F.coalesce(F.col("_mix_draw") < F.col("below"), F.lit(True))
    more = (here < F.col("_mix_bucket")) | ((here == F.col("_mix_bucket")) & (below | F.array_contains("fill", F.col("_mix_draw"))))
    copies = F.col("passes") + F.when(F.col("left") > 0, F.coalesce(more, F.lit(False)).cast("long")).otherwise(0)
    kept = [c for c in df.columns if c not in ("copies", "source_sizes", "targets")]
    return joined.select(*kept, copies.cast("int").alias("copies"), "source_sizes", "targets")


def document_draw(seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def held_by(df: DataFrame, source: str = "source") -> DataFrame:
    """``df`` (with ``words``, a column that is equal for equal texts) with ``held``, the sources that hold its text, and ``alike``, how many rows do.

    Texts of one source are told apart from those of several by aggregates; nothing is gathered but
    sets of sources, and only texts of several rows come back to them.
    """
    groups = df.groupBy("words").agg(F.collect_set(F.struct(F.col(source).alias("s"))).alias("sources"), F.count("*").alias("alike"))
    several = groups.filter("alike > 1").select("words", F.array_sort(F.transform("sources", lambda x: x["s"])).alias("held"), "alike")
    return df.join(several, "words", "left").withColumns({"held": F.coalesce("held", F.array(source)), "alike": F.coalesce("alike", F.lit(1))})


def op4_min_cost_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to 150 % of their words by the weights 5, 2, 1 of their sources; texts that several sources hold overlap them."""
    docs = table(spark, sf_dir, "documents")
    # equal texts agree in two hashes and their length; empty ones have nothing to give and stand alone
    size = word_count(F.col("text"))
    known = [F.when(size > 0, x).otherwise(y).alias(n) for n, x, y in (("a", F.xxhash64("text"), F.col("doc_id")), ("b", F.xxhash64(F.lit(SEED), "text"), F.lit(0)), ("c", F.octet_length("text"), F.lit(-1)))]
    words = F.struct(*known)
    sized = docs.select("doc_id", "source", size.alias("size"), document_draw().alias("draw"), words.alias("words"))
    sized = materialised(held_by(materialised(sized)).drop("words"))
    mix = mixed(sized, weighted_targets, F.col("held"), F.col("size"), F.col("draw"), own=F.col("source"), alike=F.col("alike"))
    return mix.select(
        "doc_id",
        "size",
        F.col("source_sizes")[0].alias("source_size"),
        F.col("targets")[0].alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"),
    )
