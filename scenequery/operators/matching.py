"""Feature matches: nearest neighbours (exact, binary, by cascaded hashes), ratio and mutual tests, filters, guided matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequery.operators import stats

#: Bytes of query vectors in a block, and of the distances that a task holds at a time.
BLOCK_BYTES, TILE_BYTES = 32 << 20, 16 << 20


def _matrix(column, kind) -> np.ndarray:
    """A batch's arrays, all of one length, as rows."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)


def _squared(q: np.ndarray, x: np.ndarray, k: int):
    """For each of q the places in x of at least its k nearest, and their exact squared distances, by one matrix product and a margin for its error."""
    near = (x * x).sum(1)[None] - 2 * (q @ x.T)
    size = (q * q).sum(1) + (x * x).sum(1).max()
    cut = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
    i, j = np.nonzero(near <= (cut + 1e-12 * (1 + size) * x.shape[1])[:, None])
    return i, j, ((q[i] - x[j]) ** 2).sum(1)


def _bits(q: np.ndarray, x: np.ndarray, k: int):
    # as narrow numbers as hold the values and the distances
    most = max(int(q.max(initial=0)), int(x.max(initial=0)))
    kind = next(t for t in (np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)
    q, x = np.ascontiguousarray(q.T, dtype=kind), np.ascontiguousarray(x.T, dtype=kind)
    d = np.zeros((q.shape[1], x.shape[1]), np.uint8 if len(q) * 8 * q.itemsize < 256 else np.uint32)
    for a, b in zip(q, x):
        d += np.bitwise_count(a[:, None] ^ b[None])
    cut = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
    i, j = np.nonzero(d <= cut[:, None])
    return i, j, d[i, j].astype(float)


def _best(i, j, d, k: int):
    """The first k of each i by (d, j)."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.empty(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    return i[rank < k], j[rank < k], d[rank < k]


def _nearest(block, k: int, kind, metric, others: bool):
    def run(batches):
        ids, vectors = block.value
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            other, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), kind)
            step = max(1, TILE_BYTES // (8 * len(x)))
            for at in range(0, len(ids), step):
                i, j, d = metric(vectors[at : at + step], x, k + others)
                i, j = ids[at : at + step][i], other[j]
                ok = (i != j) if others else np.ones(len(i), bool)
                found = tuple(np.concatenate(p) for p in zip(found, (i[ok], j[ok], d[ok])))
            found = _best(*found, k)
        if len(found[0]):
            yield pa.record_batch([pa.array(v) for v in found], ["i", "j", "d2"])

    return run


def _search(queries: DataFrame, data: DataFrame, k: int, block_bytes: int, kind, metric, others: bool) -> DataFrame:
    spark = queries.sparkSession
    ok = F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull())
    queries, data = (x.select(F.col("id").cast("long").alias("id"), "vec").filter(ok) for x in (queries, data))
    n, dims = queries.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    parts = max(1, -(-n * (dims or 0) * 8 // block_bytes))
    out = None
    for b in range(parts):
        rows = (queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == b)).toArrow()
        if not rows.num_rows:
            continue
        ids = rows.column(0).to_numpy()
        block = spark.sparkContext.broadcast((ids, _matrix(rows.column(1).combine_chunks(), kind)))
        near = data.filter(F.size("vec") == dims).mapInArrow(_nearest(block, k, kind, metric, others), "i bigint, j bigint, d2 double")
        out = near if out is None else out.union(near)
    if out is None:
        return spark.createDataFrame([], "i bigint, j bigint, d2 double, rank int")
    return stats.ranked(out, ["i"], ["d2", "j"], k)


def knn(queries: DataFrame, data: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(i, j, d2, rank): the k nearest rows of data(id, vec) to each of queries(id, vec) by squared distance; ties by id.

    Queries go out in broadcast blocks of bounded size; each task walks its rows in tiles of bounded size
    and keeps k candidates a query, which then meet by query.  Vectors with a null or of another length take no part.
    """
    return _search(queries, data, k, block_bytes, np.float64, _squared, False)


def knn_others(queries: DataFrame, data: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """knn among the rows of data with another id than the query."""
    return _search(queries, data, k, block_bytes, np.float64, _squared, True)


def knn_binary(queries: DataFrame, data: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """knn by differing bits of arrays of longs.

    Equal vectors are compared once: whatever is among a query's k nearest has a vector among the first k by (distance,
    least id), and is one of the k least ids of that vector.
    """
    ok = F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull())
    queries, data = (x.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<long>").alias("vec")).filter(ok) for x in (queries, data))
    few = stats.ranked(data, ["vec"], ["id"], k)
    groups = stats.cut(few.groupBy("vec").agg(F.min("id").alias("id"), F.collect_list("id").alias("ids")))
    asked = stats.cut(queries.join(queries.groupBy("vec").agg(F.min("id").alias("rep")), "vec").select("id", "rep", "vec"))
    near = _search(asked.filter("id = rep").select("id", "vec").distinct(), groups, k, block_bytes, np.uint64, _bits, False)
    near = near.select(F.col("i").alias("rep"), F.col("j").alias("id"), "d2").join(groups.select("id", "ids"), "id")
    near = stats.ranked(near.select("rep", F.explode("ids").alias("j"), "d2"), ["rep"], ["d2", "j"], k)
    return asked.select(F.col("id").alias("i"), "rep").distinct().join(near, "rep").select("i", "j", "d2", "rank")


# Approximate neighbours by cascaded hashes.

CODE_BITS, GROUPS, GROUP_BITS, BEST = 128, 6, 8, 10


def hashed(vectors: DataFrame, mean: list[float], seed: int = 0) -> DataFrame:
    """vectors(id, vec) with code (two longs: signs of random projections) and buckets (a number per group of projections)."""
    r = np.random.default_rng(seed)
    dims = len(mean)
    code, groups = r.normal(size=(dims, CODE_BITS)), r.normal(size=(dims, GROUPS * GROUP_BITS))
    middle = np.array(mean)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), np.float64) - middle
                bits = np.packbits(x @ code > 0, axis=1).view(np.int64)
                buckets = ((x @ groups > 0).reshape(len(x), GROUPS, GROUP_BITS) << np.arange(GROUP_BITS)).sum(2)
                lists = [pa.array(list(v), pa.list_(pa.int64())) for v in (bits, buckets)]
                yield pa.record_batch([b.column(0), b.column(1), *lists], ["id", "vec", "code", "buckets"])

    ok = vectors.filter((F.size("vec") == dims) & ~F.exists("vec", lambda v: v.isNull())).select(F.col("id").cast("long"), F.col("vec").cast("array<double>"))
    return ok.mapInArrow(run, "id bigint, vec array<double>, code array<bigint>, buckets array<bigint>")


def mean_vector(vectors: DataFrame) -> list[float]:
    rows = vectors.select(F.posexplode("vec").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).orderBy("k").collect()  # a row per dimension
    return [r.m for r in rows]


def knn_hashed(queries: DataFrame, data: DataFrame, k: int, seed: int = 0, best: int = BEST) -> DataFrame:
    """(i, j, d2, rank): of the rows that share a bucket with the query in some group, the `best` by differing bits of their codes, and of those the k nearest.

    Queries with no more than k such rows have none.  Both sides are moved by the mean of data.
    """
    mean = mean_vector(data)
    if not mean:
        return queries.sparkSession.createDataFrame([], "i bigint, j bigint, d2 double, rank int")
    q, x = hashed(queries, mean, seed), hashed(data, mean, seed)
    deal = lambda d, n: d.select(F.col("id").alias(n), F.col("code").alias(f"c{n}"), F.posexplode("buckets").alias("group", "bucket"))
    pairs = deal(q, "i").join(deal(x, "j"), ["group", "bucket"]).select("i", "j", *[(F.bit_count(F.col("ci")[w].bitwiseXOR(F.col("cj")[w]))).alias(f"b{w}") for w in (0, 1)]).distinct()
    pairs = pairs.select("i", "j", (F.col("b0") + F.col("b1")).alias("bits"))
    n = F.count(F.lit(1)).over(Window.partitionBy("i"))
    top = stats.ranked(pairs.withColumn("n_", n).filter(F.col("n_") > k), ["i"], ["bits", "j"], best).select("i", "j")
    both = top.join(q.select(F.col("id").alias("i"), F.col("vec").alias("p")), "i").join(x.select(F.col("id").alias("j"), F.col("vec").alias("q")), "j")
    d2 = F.aggregate(F.zip_with("p", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return stats.ranked(both.select("i", "j", d2.alias("d2")), ["i"], ["d2", "j"], k)


MATCHERS = {"brute_force": knn, "brute_force_hamming": knn_binary, "cascade_hashing": knn_hashed}


def matcher(name: str):
    """The search of that name, from (queries, data, k)."""
    if name not in MATCHERS:
        raise ValueError(f"unknown matcher {name}; there are {', '.join(MATCHERS)}")
    return MATCHERS[name]


# Filters of neighbours and matches.


def ratio_test(near: DataFrame, ratio: float) -> DataFrame:
    """Nearest neighbours whose squared distance is below ratio ** 2 times that of the second."""
    w = Window.partitionBy("i").orderBy("rank")
    return near.withColumn("second", F.lead("d2").over(w)).filter((F.col("rank") == 1) & (F.col("d2") < ratio**2 * F.col("second"))).select("i", "j", "d2")


def with_ratio(near: DataFrame, ratio: float) -> DataFrame:
    """`ratio_test` with the ratio of both distances (not squared)."""
    w = Window.partitionBy("i").orderBy("rank")
    x = near.withColumn("ratio", F.sqrt(F.col("d2") / F.lead("d2").over(w)))
    return x.filter((F.col("rank") == 1) & (F.col("ratio") < ratio)).select("i", "j", "d2", "ratio")


def mutual(forth: DataFrame, back: DataFrame) -> DataFrame:
    """Matches (i, j) of forth whose reverse is in back."""
    return forth.select("i", "j").intersect(back.select(F.col("j").alias("i"), F.col("i").alias("j")))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def distinct_coordinates(matches: DataFrame, coordinates: list[str], order: list) -> DataFrame:
    """Of matches between equal coordinates, the first."""
    return stats.ranked(matches, coordinates, order, 1, "k_").drop("k_")


def match_regions(queries: DataFrame, data: DataFrame, ratio: float, search=knn) -> DataFrame:
    """(i, j, d2): two neighbours, ratio test, one match per pair of ids and per pair of places; both sides have (id, vec, x, y)."""
    m = ratio_test(search(queries.select("id", "vec"), data.select("id", "vec"), 2), ratio)
    place = lambda d, e: d.select(F.col("id").alias(e), F.col("x").alias(f"x{e}"), F.col("y").alias(f"y{e}"))
    m = m.join(place(queries, "i"), "i").join(place(data, "j"), "j")
    return distinct_coordinates(m, ["xi", "yi", "xj", "yj"], ["i", "j"]).select("i", "j", "d2")


def top_matches(matches: DataFrame, by: list[str], order: list, least: int, most: int) -> DataFrame:
    """The first `most` of each group (all for 0); groups of fewer than `least` are emptied.  Only the first `most` are ever ordered together."""
    many = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*by)
    x = stats.ranked(matches, by, order, most, "_k").drop("_k") if most > 0 else matches
    return x.join(many, by, "left_semi")


def by_views(matches: DataFrame, keys: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """Matches with both ends among keys(v)."""
    for end in ends:
        matches = matches.join(keys.select(F.col("v").alias(end)), end, "left_semi")
    return matches


def by_kind(matches: DataFrame, kinds: list[str], column: str = "kind") -> DataFrame:
    return matches.filter(F.col(column).isin(kinds)) if kinds else matches


def moving(matches: DataFrame, least: float) -> DataFrame:
    """Matches whose ends lie at least least * 2 ** (the greater scale) apart; all for a negative least; matches(xi, yi, si, xj, yj, sj, ...)."""
    gap = F.sqrt((F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj")) + (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj")))
    return matches.filter(gap >= least * F.pow(F.lit(2.0), F.greatest("si", "sj"))) if least >= 0 else matches


def poor_overlap(before: DataFrame, after: DataFrame, by: list[str], ratio: float, least: int) -> DataFrame:
    """Groups of which at least `least` matches and a share of `ratio` are left."""
    a = before.groupBy(*by).agg(F.count(F.lit(1)).alias("n_before"))
    b = after.groupBy(*by).agg(F.count(F.lit(1)).alias("n_after"))
    return a.join(b, by).filter((F.col("n_after") >= least) & (F.col("n_after") >= ratio * F.col("n_before")))


def grid_top(points: DataFrame, cell: list[Column], by: list[str], order: list, n: int) -> DataFrame:
    """The first n points of each grid cell."""
    x = points.withColumns({f"cell_{i}": c for i, c in enumerate(cell)})
    return stats.ranked(x, [*by, *[f"cell_{i}" for i in range(len(cell))]], order, n, "_k").drop("_k")


def by_scale(matches: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    """Matches numbered within their group by mean feature scale, the greatest first; ties by feature; matches(si, sj, fi, fj, ...)."""
    return matches.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc((F.col("si") + F.col("sj")) / 2), "fi", "fj")))


def by_ratio(matches: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    """Matches numbered within their group by distance ratio, the least first."""
    return matches.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("ratio", "fi", "fj")))


def spread(matches: DataFrame, most: int, grid: int = 3) -> DataFrame:
    """(i, j, kind, fi, fj, rank): each pair's matches of a kind, those of great features first, dealt over the cells of both images and taken cell by cell in turn.

    matches(i, j, kind, fi, fj, xi, yi, si, xj, yj, sj, wi, hi, wj, hj).  A match goes to the emptier of its two cells
    (ties: the first image's).  Cell numbers stop at grid - 1, so that only the first row of cells is used: a fixed quirk
    of the format's first writers that results depend on.  A pair's matches are bounded by its views' features.
    """
    def deal(t):
        d = {n: t.column(n).to_pylist() for n in t.schema.names}
        n = t.num_rows
        order = sorted(range(n), key=lambda r: (-(d["si"][r] + d["sj"][r]) / 2, d["fi"][r], d["fj"][r]))

        def cell(r, e):
            w, h = (-(-d[f"{s}{e}"][r] // grid) for s in "wh")
            return int(min(max(d[f"x{e}"][r] // w + d[f"y{e}"][r] // h * grid, 0), grid - 1))

        cells: list[list[int]] = [[] for _ in range(2 * grid)]
        for r in order:
            a, b = cells[cell(r, "i")], cells[grid + cell(r, "j")]
            (a if len(a) <= len(b) else b).append(r)
        turns = sorted((at, c, r) for c, rows in enumerate(cells) for at, r in enumerate(rows))
        kept = [r for _, _, r in turns][: most or None]
        return pa.table({n: pa.array([d[n][r] for r in kept], t.schema.field(n).type) for n in ("i", "j", "kind", "fi", "fj")} | {"rank": pa.array(range(1, len(kept) + 1), pa.int64())})

    types = dict(matches.dtypes)
    return matches.groupBy("i", "j", "kind").applyInArrow(deal, ", ".join(f"{n} {types[n]}" for n in ("i", "j", "kind", "fi", "fj")) + ", rank bigint")


# Strength of support: fixed values, weight of a match by the kind of its descriptor.
SUPPORT = {"sift": 0.14, "sift_float": 0.14, "sift_upright": 0.14, "dspsift": 0.14, "akaze": 0.14, "akaze_liop": 0.14, "akaze_mldb": 0.14, "cctag3": 1.0, "cctag4": 1.0, "tag16h5": 1.0, "sift_ocv": 0.14, "akaze_ocv": 0.14, "unknown": 1.0}
MARKERS = ("cctag3", "cctag4", "tag16h5")


def support(kind: Column, weights: dict[str, float] | None = None) -> Column:
    """The weight of a kind; null for a kind without one."""
    out = F.lit(None).cast("double")
    for k, w in (SUPPORT if weights is None else weights).items():
        out = F.when(kind == k, w).otherwise(out)
    return out


def is_marker(kind: Column) -> Column:
    return kind.isin(*MARKERS)


def strong_support(matches: DataFrame, by: list[str], least: float, weights: dict[str, float] | None = None) -> DataFrame:
    """(by, weight) of groups whose matches weigh more than `least` together; matches(kind, ...)."""
    return matches.groupBy(*by).agg(F.sum(support(F.col("kind"), weights)).alias("weight")).filter(F.col("weight") > least)


# Guided matching.


def guided(left: DataFrame, right: DataFrame, model: list[float], most: float) -> DataFrame:
    """(i, j, error): for each point of left the point of right nearest to where a homography (9 numbers) takes it, if nearer than `most`; points(id, x, y).

    Points of right are dealt over cells `most` wide, of which a point of left looks at nine.
    """
    h = model
    w = h[6] * F.col("x") + h[7] * F.col("y") + h[8]
    p = left.select(F.col("id").alias("i"), ((h[0] * F.col("x") + h[1] * F.col("y") + h[2]) / w).alias("u"), ((h[3] * F.col("x") + h[4] * F.col("y") + h[5]) / w).alias("v"))
    at = lambda c: F.floor(F.col(c) / most).cast("long")
    for c, s in (("cx", "u"), ("cy", "v")):
        p = p.withColumn(c, F.explode(F.array(*[at(s) + d for d in (-1, 0, 1)])))
    q = right.select(F.col("id").alias("j"), F.col("x").alias("qx"), F.col("y").alias("qy"), at("x").alias("cx"), at("y").alias("cy"))
    error = F.sqrt((F.col("u") - F.col("qx")) * (F.col("u") - F.col("qx")) + (F.col("v") - F.col("qy")) * (F.col("v") - F.col("qy")))
    near = p.join(q, ["cx", "cy"]).withColumn("error", error).filter(F.col("error") < most)
    return stats.ranked(near.select("i", "j", "error"), ["i"], ["error", "j"], 1).drop("rank")


def guided_epipolar(left: DataFrame, right: DataFrame, f: list[float], most: float, size: tuple[int, int], cell: int = 32) -> DataFrame:
    """(i, j, error): for each point of left the point of right nearest to its epipolar line (F x), if nearer than `most`.

    The line walks the columns of cells (rows, if it is steep) of the right image, size = (width, height), and meets the
    points of the cells that its band touches.
    """
    a, b, c = (f[3 * k] * F.col("x") + f[3 * k + 1] * F.col("y") + f[3 * k + 2] for k in range(3))
    n = F.sqrt(a * a + b * b)
    p = left.select(F.col("id").alias("i"), (a / n).alias("a"), (b / n).alias("b"), (c / n).alias("c")).filter(F.col("a").isNotNull() & ~F.isnan("a"))
    steep = F.abs("a") > F.abs("b")
    steps = F.when(steep, F.lit(-(-size[1] // cell))).otherwise(F.lit(-(-size[0] // cell)))
    p = p.withColumns({"steep": steep, "s": F.explode(F.sequence(F.lit(-1), steps))})
    # along the walked axis from s to s + 1 cells, the other coordinate lies between the line's ends there, widened by the band
    along, across = F.when(F.col("steep"), F.col("b")).otherwise(F.col("a")), F.when(F.col("steep"), F.col("a")).otherwise(F.col("b"))
    other = lambda t: -(F.col("c") + along * t) / across
    ends = [other(F.col("s") * cell), other((F.col("s") + 1) * cell)]
    wide = F.abs(most / across)
    first, last = F.floor((F.least(*ends) - wide) / cell).cast("int"), F.floor((F.greatest(*ends) + wide) / cell).cast("int")
    limit = F.when(F.col("steep"), size[0] // cell + 1).otherwise(size[1] // cell + 1)
    p = p.withColumns({"first": F.greatest(first, F.lit(-1)), "last": F.least(last, limit)}).filter("first <= last").withColumn("o", F.explode(F.sequence("first", "last")))
    p = p.select("i", "a", "b", "c", F.when(F.col("steep"), F.col("o")).otherwise(F.col("s")).alias("cx"), F.when(F.col("steep"), F.col("s")).otherwise(F.col("o")).alias("cy"))
    at = lambda v: F.floor(F.col(v) / cell).cast("int")
    q = right.select(F.col("id").alias("j"), F.col("x").alias("qx"), F.col("y").alias("qy"), at("x").alias("cx"), at("y").alias("cy"))
    error = F.abs(F.col("a") * F.col("qx") + F.col("b") * F.col("qy") + F.col("c"))
    near = p.join(q, ["cx", "cy"]).withColumn("error", error).filter(F.col("error") < most)
    return stats.ranked(near.select("i", "j", "error").distinct(), ["i"], ["error", "j"], 1).drop("rank")
