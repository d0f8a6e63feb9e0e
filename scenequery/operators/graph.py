"""Graphs over edge tables (i, j): components, bridges, spanning trees, triangles, distances.  Iterations cut their lineage in the shared folder."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Edges that one task contracts.
BLOCK = 1 << 18

#: Of triangles: edges from one group of vertices to another on average, wedges closed at a time, bits of a table of edges.
EDGES, WEDGES, TABLE = 300_000, 1 << 20, 1 << 25


def _shared(spark) -> str:
    """URI of a new path in the shared folder of spark.checkpoint.dir; in a folder of this machine only where that is unset and Spark runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="scenequery-")
        spark.sparkContext.setCheckpointDir(where)
    return f"{where if '://' in where or where.startswith('file:') else 'file://' + where}/cut-{uuid.uuid4().hex}"


def _cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    path = _shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _contract(batches):
    """(v, label) of all ends of a block of edges: label is the least v that the block's edges lead to."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    for i in range(0, len(nodes), 10_000):
        part = nodes[i : i + 10_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([root(v) for v in part], pa.int64())], ["v", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the least vertex of each vertex' component.

    Blocks of about BLOCK edges are contracted to stars, each in one task; of several blocks' stars,
    least labels spread along edges and jump along labels.
    """
    e = _cut(edges.select(F.col("i").cast("long"), F.col("j").cast("long")).distinct())
    blocks = -(-e.count() // BLOCK)
    stars = _cut((e.repartition(blocks) if blocks > 1 else e.coalesce(1)).mapInArrow(_contract, "v bigint, label bigint"))
    if blocks <= 1:
        return stars.withColumnRenamed("label", "component")
    both = _cut(stars.select("v", F.col("label").alias("w")).union(stars.select("label", "v")).toDF("v", "w").distinct())
    label = _cut(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        near = both.join(label.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("label").alias("m"))
        step = label.join(near, "v").select("v", "label", F.least("label", "m").alias("m"))
        new = _cut(step.join(label.select(F.col("v").alias("m"), F.col("label").alias("far")), "m").select("v", "label", F.least("m", "far").alias("new")))
        label = new.select("v", F.col("new").alias("label"))
        if new.filter("label != new").isEmpty():
            return label.withColumnRenamed("label", "component")


def largest_component(edges: DataFrame) -> DataFrame:
    """The vertices of the largest component; ties: the least label."""
    c = components(edges)
    top = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(F.broadcast(top), "component", "left_semi")


def _sparse_certificate(batches):
    """Of a block of edges (i, j), two edge-disjoint spanning forests: they have the same bridges."""
    forests: list[dict] = [{}, {}]

    def root(up, x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for batch in batches:
        for a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
            for up in forests:
                x, y = root(up, a), root(up, b)
                if x != y:
                    up[x] = y
                    out.append((a, b))
                    break
    for i in range(0, len(out), 10_000):
        yield pa.record_batch([pa.array([e[k] for e in out[i : i + 10_000]], pa.int64()) for k in (0, 1)], ["i", "j"])


def _bridges(batches):
    """The bridges of the edges at hand, by least reachable numbers of a depth-first walk."""
    near: dict = {}
    for batch in batches:
        for a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    number, low, out = {}, {}, []
    for start in near:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        stack = [(start, None, iter(near[start]))]
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append((w, v, iter(near[w])))
                    break
                if w != parent:
                    low[v] = min(low[v], number[w])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > number[parent]:
                        out.append((min(v, parent), max(v, parent)))
    yield pa.record_batch([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["i", "j"])


def bridges(edges: DataFrame) -> DataFrame:
    """(i, j), i < j: edges whose loss would part a component.

    Blocks of edges shrink to two disjoint spanning forests, which keep every bridge and make no new one,
    until what is left (at most 2 (n - 1) edges) fits one block, or does not shrink any more.
    """
    e = _cut(edges.select(F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j")).filter("i != j").distinct())
    n = e.count()
    while n > BLOCK:
        e = _cut(e.repartition(max(1, n // BLOCK), "i", "j").mapInArrow(_sparse_certificate, "i bigint, j bigint"))
        left = e.count()
        if left == n:
            break
        n = left
    return e.coalesce(1).mapInArrow(_bridges, "i bigint, j bigint")


def without_bridges(edges: DataFrame) -> DataFrame:
    """(v): the vertices of the largest component once all bridges are gone."""
    e = _cut(edges.select(F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j")).filter("i != j").distinct())
    return largest_component(e.join(bridges(e), ["i", "j"], "left_anti")).select("v")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(i, j, weight): a maximum spanning forest; ties: the lesser i, then j.

    Every component takes its heaviest edge to another one, round after round; components at least halve.
    """
    e = _cut(edges.select(F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"), "weight").filter("i != j").groupBy("i", "j").agg(F.max("weight").alias("weight")))
    label = _cut(e.select(F.col("i").alias("v")).union(e.select("j")).distinct().withColumn("label", F.col("v")))
    taken = None
    while True:
        x = e
        for end in "ij":
            x = x.join(label.select(F.col("v").alias(end), F.col("label").alias(f"l{end}")), end)
        x = x.filter("li != lj")
        both = x.select(F.col("li").alias("l"), "i", "j", "weight").union(x.select("lj", "i", "j", "weight"))
        best = both.groupBy("l").agg(F.min(F.struct((-F.col("weight")).alias("w"), "i", "j")).alias("m"))
        best = _cut(best.select("m.i", "m.j", (-F.col("m.w")).alias("weight")).distinct())
        if best.isEmpty():
            return taken if taken is not None else e.limit(0)
        taken = best if taken is None else _cut(taken.union(best))
        joined = components(taken).select("v", F.col("component").alias("c"))
        label = _cut(label.join(joined, "v", "left").select("v", F.coalesce("c", "label").alias("label")))


def _closed(ab, ac, bc, wedges: int):
    """Arrays u, v, w of the triangles whose edges (u, v), (u, w), (v, w) stand in ab, ac and bc; from the shorter of both ends' lists, `wedges` at a time."""

    def lists(e):
        e = e[np.lexsort((e[:, 1], e[:, 0]))]
        names, start, count = np.unique(e[:, 0], return_index=True, return_counts=True)
        return e, names, start, count

    ac, u_names, u_start, u_count = lists(ac)
    bc, v_names, v_start, v_count = lists(bc)
    w_names = np.unique(np.concatenate([ac[:, 1], bc[:, 1]]))
    place = lambda names, v: np.minimum(np.searchsorted(names, v), len(names) - 1)
    if not len(ac) or not len(bc):
        return
    pu, pv = place(u_names, ab[:, 0]), place(v_names, ab[:, 1])
    ok = (u_names[pu] == ab[:, 0]) & (v_names[pv] == ab[:, 1])
    ab, pu, pv = ab[ok], pu[ok], pv[ok]
    first = u_count[pu] <= v_count[pv]
    for mine, start, count, walked, other, names, at in ((first, u_start, u_count, ac, bc, v_names, pv), (~first, v_start, v_count, bc, ac, u_names, pu)):
        walk = (pu if walked is ac else pv)[mine]
        edges, far = ab[mine], at[mine]
        # the other list's edges, as a table where that is small, else as ordered numbers
        key = place(names, other[:, 0]) * len(w_names) + place(w_names, other[:, 1])
        table = np.zeros(len(names) * len(w_names), bool) if len(names) * len(w_names) <= TABLE else None
        if table is not None:
            table[key] = True
        local = place(w_names, walked[:, 1])
        upto = np.cumsum(count[walk])
        i = 0
        while i < len(walk):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + wedges, "right")))
            n = count[walk[i:j]]
            line = np.repeat(np.arange(i, j), n)
            w = local[np.arange(len(line)) + np.repeat(start[walk[i:j]] - np.cumsum(n) + n, n)]
            want = far[line] * len(w_names) + w
            there = table[want] if table is not None else key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want
            line, w = line[there], w[there]
            if len(line):
                yield edges[line, 0], edges[line, 1], w_names[w]
            i = j


def _grouped(uri: str, n: int):
    """Triangles (a, b, c) whose a and b fall into the groups of each number at hand (a's times n and b's), from the files of edges by such numbers."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(uri)

        def edges(p: int, q: int):
            found = fs.get_file_info(pafs.FileSelector(f"{root}/g={p * n + q}", allow_not_found=True))
            parts = [pq.read_table(f.path, columns=["i", "j"], filesystem=fs, partitioning=None) for f in found if f.path.endswith(".parquet")]
            return np.concatenate([np.stack([c.to_numpy() for c in t.columns], 1) for t in parts]) if parts else np.empty((0, 2), np.int64)

        for batch in batches:
            for t in batch.column(0).to_pylist():
                p, q = divmod(t, n)
                ab = edges(p, q)
                for r in range(n) if len(ab) else ():
                    ac = edges(p, r)
                    for found in _closed(ab, ac, edges(q, r), WEDGES) if len(ac) else ():
                        for i in range(0, len(found[0]), 100_000):
                            yield pa.record_batch([pa.array(x[i : i + 100_000]) for x in found], ["a", "b", "c"])

    return run


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, from canonical edges.

    Vertices fall into groups by hash, edges into files by the groups of their lesser and greater end.  A task has
    the groups of a and b, and goes through those of c; edges are shuffled once, wedges and triangles never.
    """
    e = _cut(edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).filter("i != j").distinct())
    spark, n = e.sparkSession, max(4, math.ceil(math.sqrt(e.count() / EDGES)))
    group = lambda v: F.pmod(F.xxhash64(v), F.lit(n))
    x = e.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    x = x.withColumn("g", group("i") * n + group("j"))
    path = _shared(spark)
    x.repartition(n * n, "g").sortWithinPartitions("g", "i", "j").write.partitionBy("g").parquet(path)
    uri = path if "://" in path else path.replace("file:", "file://", 1)
    return spark.range(0, n * n, 1, n * n).mapInArrow(_grouped(uri, n), "a bigint, b bigint, c bigint")


def distances(edges: DataFrame, source: int | list[int], most: int | None = None) -> DataFrame:
    """(v, distance) of all vertices, -1 where no source reaches; with `most`, only of those within so many steps."""
    both = _cut(edges.select("i", "j").union(edges.select("j", "i")).toDF("v", "w").distinct())
    sources = [source] if isinstance(source, int) else list(source)
    seen = edges.sparkSession.createDataFrame([(s,) for s in sources], "v long").select("v", F.lit(0).alias("distance"))
    front, step = seen, 0
    while most is None or step < most:
        step += 1
        new = both.join(front.select("v"), "v").select(F.col("w").alias("v")).distinct().join(seen, "v", "left_anti").withColumn("distance", F.lit(step))
        front = _cut(new)
        if front.isEmpty():
            break
        seen = _cut(seen.union(front))
    if most is None:
        seen = seen.union(both.select("v").distinct().join(seen, "v", "left_anti").withColumn("distance", F.lit(-1)))
    return seen


def states(distance: DataFrame, limit: int) -> DataFrame:
    """(v, distance, state): refined within the limit, constant one step beyond, ignored elsewhere."""
    d = F.col("distance")
    return distance.withColumn("state", F.when((d >= 0) & (d <= limit), "refined").when(d == limit + 1, "constant").otherwise("ignored"))


def local_edges(shared: DataFrame, new: DataFrame, least: int, best: int = 10) -> DataFrame:
    """(i, j), i < j: for each new view its `best` neighbours by shared landmarks (ties: the lesser id), and all with `least` or more; shared(i, j, n), new(view)."""
    both = shared.select("i", "j", "n").union(shared.select("j", "i", "n")).toDF("view", "other", "n").join(new.select("view"), "view", "left_semi")
    rank = F.row_number().over(Window.partitionBy("view").orderBy(F.desc("n"), "other"))
    x = both.withColumn("rank", rank).filter((F.col("rank") <= best) | (F.col("n") >= least))
    return x.select(F.least("view", "other").alias("i"), F.greatest("view", "other").alias("j")).distinct()


def strong_links(shared: DataFrame, least_shared: int, least_links: int) -> DataFrame:
    """(view, other, n): for each view its links with `least_shared` or more in common, and at least its `least_links` strongest (ties: the greater id)."""
    both = shared.select("i", "j", "n").union(shared.select("j", "i", "n")).toDF("view", "other", "n")
    rank = F.row_number().over(Window.partitionBy("view").orderBy(F.desc("n"), F.desc("other")))
    return both.withColumn("rank", rank).filter((F.col("n") >= least_shared) | (F.col("rank") <= least_links)).drop("rank")


def graphviz(edges: DataFrame) -> DataFrame:
    """(line): a DOT text's lines, in their order by `no`."""
    e = edges.select(F.concat(F.lit("  n"), F.col("i").cast("string"), F.lit(" -- n"), F.col("j").cast("string"), F.lit(";")).alias("line"), F.lit(1).alias("no"))
    ends = edges.sparkSession.createDataFrame([("graph g {", 0), ("}", 2)], "line string, no int")
    return ends.union(e)


def adjacency_svg(counts: DataFrame, size: int = 5) -> DataFrame:
    """(no, line): an SVG picture of pairs(i, j, n), a square each, whose title names the pair and its matches."""
    n = counts.agg(F.max(F.greatest("i", "j"))).first()[0]
    side = 0 if n is None else (int(n) + 1) * size
    square = F.format_string(f'<rect x="%d" y="%d" width="{size}" height="{size}"><title>(%d, %d: %d)</title></rect>', F.col("j") * size, F.col("i") * size, "i", "j", "n")
    head = counts.sparkSession.createDataFrame([(0, f'<svg xmlns="http://www.w3.org/2000/svg" width="{side}" height="{side}">'), (2, "</svg>")], "no int, line string")
    return head.union(counts.select(F.lit(1), square))
