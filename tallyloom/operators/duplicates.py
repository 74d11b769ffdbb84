"""Near-duplicates of 64-bit perceptual hashes and of clips of such frames, by bands that similar hashes must share."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.stages import cut

BITS = 64


def bands(value: Column, distance: int, shared: int = 2) -> Column:
    """Keys that hashes within ``distance`` bits have in common, at least one of them.

    A hash is cut into ``distance`` + ``shared`` stretches; close hashes agree in ``shared``
    of them, so each choice of that many is a key.  More of them make longer keys, and fewer
    hashes that meet by chance.
    """
    n = distance + shared
    edges = [BITS * i // n for i in range(n + 1)]
    stretches = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    keys = []
    for i, chosen in enumerate(combinations(stretches, shared)):
        mask = sum(chosen)
        keys.append(F.struct(F.lit(i).alias("band"), value.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask)).alias("bits")))
    return F.array(*keys)


def near_pairs(df: DataFrame, distance: int, within: list[str] | None = None) -> DataFrame:
    """Pairs (id_a < id_b, hamming) of ``df`` (id, hash: long) that differ in at most ``distance`` bits.

    Equal hashes are one class and stand for themselves once: pairs are of the classes'
    smallest ids, so copies don't multiply.
    """
    keys = within or []
    classes = df.groupBy(*keys, "hash").agg(F.min("id").alias("id"))
    banded = classes.select(*keys, "id", "hash", F.explode(bands(F.col("hash"), distance)).alias("b")).select(*keys, "id", "hash", "b.band", "b.bits")
    other = banded.select(*keys, F.col("id").alias("id_b"), F.col("hash").alias("hash_b"), "band", "bits")
    joined = banded.join(other, [*keys, "band", "bits"]).filter(F.col("id") < F.col("id_b"))
    far = F.bit_count(F.col("hash").bitwiseXOR(F.col("hash_b"))).cast("int")
    return joined.withColumn("hamming", far).filter(F.col("hamming") <= distance).select(*keys, F.col("id").alias("id_a"), "id_b", "hamming").distinct()


def earliest_duplicate(df: DataFrame, distance: int, order: str = "ord", within: list[str] | None = None) -> DataFrame:
    """For each row (id, hash, ord) the earliest row before it within ``distance`` bits, and with equal ``within``.

    Of equal hashes the earliest stands for all when others are compared with them.
    """
    by = within or []
    first = df.groupBy("hash", *by).agg(F.min_by("id", order).alias("prior_id"), F.min(order).alias("prior_ord"))
    keys = F.explode(bands(F.col("hash"), distance)).alias("b")
    prior = first.select(*by, "prior_id", F.col("hash").alias("prior_hash"), "prior_ord", keys)
    classes = df.select("hash", *by).distinct().select("hash", *by, keys)
    # which classes are near, and since when, is found once for each hash
    met = classes.join(prior, [*by, "b"]).filter(F.bit_count(F.col("hash").bitwiseXOR(F.col("prior_hash"))) <= distance)
    known = met.groupBy("hash", *by).agg(F.min_by("prior_id", "prior_ord").alias("prior_id"), F.min("prior_ord").alias("prior_ord"))
    return df.join(known, ["hash", *by]).filter(F.col("prior_ord") < F.col(order)).select(*by, "id", "prior_id")


def frame_sets(frames: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(id, hashes) of frames (id, position, hash: long): each clip's hashes in order, nulls where a frame has none."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "hash")))  # the frames of one clip
    return frames.groupBy(*(by or []), "id").agg(F.transform(ordered, lambda x: x["hash"]).alias("hashes"))


def _compared(a: Column, b: Column) -> Column:
    """(n, median, least, most) of the distances at the positions both have; null if a hash is missing there."""
    n = F.least(F.size(a), F.size(b))
    far = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int"))
    far = F.sort_array(far)
    whole = (n > 0) & ~F.exists(far, lambda x: x.isNull())
    median = (F.get(far, ((n - 1) / 2).cast("int")) + F.get(far, (n / 2).cast("int"))) / 2
    return F.when(whole, F.struct(n.alias("n"), median.alias("median"), F.get(far, F.lit(0)).alias("least"), F.get(far, n - 1).alias("most")))


def _first_band(x: Column, y: Column, distance: int) -> Column:
    """The first of the bands in which two hashes agree: by it a pair is told once."""
    agree = F.zip_with(bands(x, distance), bands(y, distance), lambda a, b: F.when(a["bits"] == b["bits"], a["band"]))
    return F.array_min(agree)


def near_sets(sets: DataFrame, distance: int, by: list[str] | None = None) -> DataFrame:
    """Pairs (a, b, n, median, least, most), both ways, of distinct ``hashes`` whose median distance is at most ``distance``.

    A median of at most ``distance`` over n positions takes half of them, rounded up, within ``distance``
    each.  So of any n // 2 + 1 positions of a set one is near the other set's frame there:
    those with the rarest hashes look for partners, by bands, and a frame that very many clips share
    (a black one, a title) finds none unless most of a clip is made of such.  What is found is compared
    in full.  ``sets``: (set, hashes, and ``by``), each once.
    """
    by = by or []
    frames = sets.select(*by, "set", F.size("hashes").alias("n"), F.posexplode("hashes").alias("position", "hash")).filter("hash IS NOT NULL")
    banded = frames.select("*", F.explode(bands(F.col("hash"), distance)).alias("b")).select(*by, "set", "n", "position", "hash", "b.band", "b.bits")
    key = [*by, "position", "band", "bits"]
    cost = banded.join(banded.groupBy(*key).agg(F.count("*").alias("met")), key).groupBy(*by, "set", "n", "position", "hash").agg(F.sum("met").alias("cost"))
    lengths = sets.select(F.size("hashes").alias("count")).filter("count > 0").distinct()  # as many as a clip has frames
    rarest = Window.partitionBy(*by, "set", "count").orderBy("cost", "position")
    asking = cost.join(F.broadcast(lengths), (F.col("count") <= F.col("n")) & (F.col("position") < F.col("count")))
    asking = asking.withColumn("place", F.row_number().over(rarest)).filter(F.col("place") <= F.floor(F.col("count") / 2) + 1)
    asking = asking.select(*by, F.col("set").alias("a"), F.col("hash").alias("own"), "n", "count", "position", F.explode(bands(F.col("hash"), distance)).alias("k"))
    asking = asking.select(*by, "a", "own", "n", "count", "position", "k.band", "k.bits")
    other = banded.select(*by, F.col("set").alias("b"), F.col("n").alias("m"), "hash", "position", "band", "bits")
    met = asking.join(other, key).filter((F.col("b") < F.col("a")) & (F.col("count") == F.least("n", "m")))
    met = met.filter((F.bit_count(F.col("own").bitwiseXOR(F.col("hash"))) <= distance) & (_first_band(F.col("own"), F.col("hash"), distance) == F.col("band")))
    pairs = met.select(*by, "a", "b").distinct()
    one, two = (sets.select(*by, F.col("set").alias(n), F.col("hashes").alias(f"of_{n}")) for n in "ab")
    told = pairs.join(one, [*by, "a"]).join(two, [*by, "b"]).select(*by, "a", "b", _compared(F.col("of_a"), F.col("of_b")).alias("c"))
    near = told.filter(F.col("c.median") <= distance).select(*by, "a", "b", "c.*")
    return near.unionByName(near.withColumns({"a": F.col("b"), "b": F.col("a")}))


def clip_classes(clips: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``clips`` (id, ord, hashes, and ``by``) with ``set``: a number that clips with equal frames have in common."""
    first = clips.groupBy(*(by or []), "hashes").agg(F.min(F.struct("ord", "id")).alias("first"))
    return clips.join(first.select(*(by or []), "hashes", F.col("first.id").alias("set")), [*(by or []), "hashes"])


def first_priors(clips: DataFrame, distance: int, by: list[str] | None = None, compared: Column | None = None) -> DataFrame:
    """For each clip (id, ord, hashes) the earliest clip before it whose frames differ by a median of ``distance`` bits at most.

    (id, prior_id, n, median, least, most); clips are compared at equal positions, as many as the
    shorter one has, and not at all if a hash is missing there.  Ties of ``ord`` go by id.
    Only clips for which ``compared`` is true are priors to others.
    """
    by = by or []
    clips = clips.select(*by, "id", "ord", "hashes", (F.lit(True) if compared is None else F.coalesce(compared, F.lit(False))).alias("compared"))
    known = clip_classes(clips, by)
    sets = known.select(*by, "set", "hashes").distinct()
    firsts = known.filter("compared").groupBy(*by, "set").agg(F.min(F.struct("ord", "id")).alias("first"))
    own = sets.select(*by, F.col("set").alias("a"), F.col("set").alias("b"), _compared(F.col("hashes"), F.col("hashes")).alias("c")).filter("c IS NOT NULL").select(*by, "a", "b", "c.*")
    near = near_sets(sets, distance, by).unionByName(own).join(firsts.withColumnRenamed("set", "b"), [*by, "b"])
    # a clip's prior is the first of all classes near its own, so only that one has to be held against it
    best = near.groupBy(*by, "a").agg(F.min(F.struct("first", "n", "median", "least", "most")).alias("best")).withColumnRenamed("a", "set")
    found = known.join(best, [*by, "set"]).filter(F.col("best.first") < F.struct("ord", "id"))
    return found.select(*by, "id", F.col("best.first.id").alias("prior_id"), "best.n", "best.median", "best.least", "best.most")


def upload_batch(uploads: DataFrame, distance: int, by: list[str] | None = None) -> DataFrame:
    """What becomes of a batch of files (id, ord, hashes, known, junk, blocked): (id, state, prior_id).

    Junk is counted and not compared; blocked files stay listed and join nothing; others are stored, duplicates too,
    and name the earliest of what the library knows and of what was stored before them that they duplicate.
    """
    by = by or []
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    state = F.when(flag("known"), "known").when(flag("junk"), "filtered").when(flag("blocked"), "blocked").otherwise("stored")
    told = uploads.select(*by, "id", F.struct((~flag("known")).alias("late"), "ord").alias("ord"), "hashes", state.alias("state"))
    priors = first_priors(told.filter("state <> 'filtered'"), distance, by, compared=F.col("state").isin("known", "stored"))
    return told.join(priors.select(*by, "id", "prior_id"), [*by, "id"], "left").select(*by, "id", "state", F.when(F.col("state") != "known", F.col("prior_id")).alias("prior_id"))


def accepted_in_order(clips: DataFrame, distance: int, by: list[str] | None = None) -> DataFrame:
    """Each clip (id, ord, hashes, known) in turn is accepted unless an accepted one before it is near: (id, accepted, prior_id).

    ``known`` clips are in the library and always accepted, before all others; of the rest one is compared
    with those alone that were accepted before it, so what resembles only a refused clip is
    accepted.  That is the first maximal independent set, in this order, of the graph of near clips, and
    it is found in rounds: a clip without an undecided or accepted one before it is accepted, those near an
    accepted one are refused.  Copies of one frame set are one node: all but its first are refused.
    A round settles all heads of chains at once, in every batch; a chain of n near clips takes n / 2 rounds.
    """
    by = by or []
    ranked = clips.select(*by, "id", "ord", "hashes", F.coalesce("known", F.lit(False)).alias("known"))
    order = F.struct((~F.col("known")).alias("late"), "ord", "id")
    classed = clip_classes(ranked, by).withColumn("rank", order)
    nodes = cut(classed.groupBy(*by, "set", "hashes").agg(F.min("rank").alias("rank"), F.bool_or("known").alias("kept")))
    near = near_sets(nodes.select(*by, "set", "hashes"), distance, by).select(*by, "a", "b")
    ranks = nodes.select(*by, "set", "rank", "kept")
    before = ranks.select(*by, F.col("set").alias("b"), F.col("rank").alias("first"), F.col("kept").alias("b_kept"))
    edges = near.join(ranks.withColumnRenamed("set", "a"), [*by, "a"]).join(before, [*by, "b"]).filter((F.col("first") < F.col("rank")) & ~F.col("kept"))
    edges = cut(edges.select(*by, "a", "b", "first", "b_kept"))
    # accepted already: what is known, and what has nothing near before it
    fresh = cut(nodes.join(edges.select(*by, F.col("a").alias("set")).distinct(), [*by, "set"], "left_anti").select(*by, "set", F.lit(True).alias("accepted")))
    told, left = [fresh], edges
    while left.head(1):
        refused = cut(left.join(fresh.filter("accepted").withColumnRenamed("set", "b"), [*by, "b"], "left_semi").select(*by, "a").distinct())
        # a refused clip stands in nobody's way
        open_ = cut(left.join(refused, [*by, "a"], "left_anti").join(refused.withColumnRenamed("a", "b"), [*by, "b"], "left_anti"))
        free = left.select(*by, "a").distinct().join(refused.unionByName(open_.select(*by, "a")).distinct(), [*by, "a"], "left_anti")
        fresh = refused.withColumn("accepted", F.lit(False)).unionByName(free.withColumn("accepted", F.lit(True)))
        fresh = cut(fresh.withColumnRenamed("a", "set"))
        told, left = [*told, fresh], open_
    done = cut(reduce(DataFrame.unionByName, told))
    taken = done.filter("accepted").join(ranks, [*by, "set"]).select(*by, F.col("set").alias("b"), F.col("rank").alias("taken"))
    prior = near.join(taken, [*by, "b"]).groupBy(*by, F.col("a").alias("set")).agg(F.min("taken").alias("prior"))
    heads = nodes.select(*by, "set", F.col("rank").alias("head"))
    state = classed.join(heads, [*by, "set"]).join(done, [*by, "set"]).join(prior, [*by, "set"], "left")
    whole = (F.size("hashes") > 0) & ~F.exists("hashes", lambda x: x.isNull())
    copy = whole & (F.col("rank") != F.col("head"))
    accepted = F.col("known") | (F.col("accepted") & ~copy)
    first = F.least("prior", F.when(F.col("accepted") & copy, F.col("head")))
    return state.select(*by, "id", accepted.alias("accepted"), F.when(~accepted, first["id"]).alias("prior_id"))


def exact_groups(df: DataFrame, key: Column, least: int = 2) -> DataFrame:
    """(key, n, first_id) of keys that several rows share."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter(F.col("n") >= least)
