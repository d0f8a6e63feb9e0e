"""Classes of linked vertices in blocks of edges: little is shuffled, and as packed numbers.

Edges go to blocks by their greater end, and are contracted there.  Vertices go to ranges of
their values, where each gets its number and is known to lie in one block or in several.  Back
in the blocks, vertices of several blocks link what the blocks found: a smaller graph.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequery.operators import graph

#: Edges of a block on average, and read at a time; edges of one end, of those read at a time, from which on they are spread.
EDGES, CHUNK, HOT = 1 << 20, 1 << 20, 1 << 14
#: Values that each chunk contributes to the bounds of the ranges; rows given on at a time.
SAMPLE, ROWS = 256, 100_000


def _pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Non-negative numbers, first bytes first, compressed; of ascending ones their steps."""
    x = np.diff(x, prepend=0) if ascending else x
    planes = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n) if n else np.zeros((8, 0), np.uint8)
    x = np.ascontiguousarray(planes.T).view("<i8").reshape(-1)
    return np.cumsum(x) if ascending else x


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _mask(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _batch(rows: list[tuple], names: list[str]):
    return pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(names)}, schema=pa.schema([(k, pa.binary() if len(k) == 1 else pa.int64()) for k in names]))


def _hash(x: np.ndarray, n: int) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(n)


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least vertex linked with each of 0 .. n - 1."""
    root = np.arange(n)
    while len(i):
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while True:
            far = root[root]
            if np.array_equal(far, root):
                break
            root = far
        i, j = root[i], root[j]
        on = i != j
        i, j = i[on], j[on]
    return root


def _deal(batches, n: int):
    """A row per chunk of edges (a, b) and block; the first of a chunk has a sample of its vertices."""

    def rows(parts):
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        block = _hash(b, n)
        start = np.flatnonzero(np.diff(b, prepend=-1))
        size = np.diff(start, append=len(b))
        # edges of one frequent end go by the other
        hot = np.repeat(size > HOT, size)
        block[hot] = _hash(a[hot], n)
        order = np.argsort(block, kind="stable")
        a, b, block = a[order], b[order], block[order]
        ends = np.sort(np.concatenate([a[:: max(1, len(a) // SAMPLE)], b[:: max(1, len(b) // SAMPLE)]]))
        at = [*np.flatnonzero(np.diff(block, prepend=block[0])), len(block)]
        for lo, hi in zip([0, *at[:-1]], at):
            yield (int(block[lo]), hi - lo, _pack(a[lo:hi]), _pack(b[lo:hi], True) if hi - lo else b"", ends.tobytes() if lo == 0 else b"")

    parts, have = [], 0
    for batch in batches:
        parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        have += batch.num_rows
        if have >= CHUNK:
            yield from (_batch([r], DEALT) for r in rows(parts))
            parts, have = [], 0
    if have:
        yield from (_batch([r], DEALT) for r in rows(parts))


#: Columns: those of one letter are binary, others numbers.
DEALT = ["block", "size", "a", "b", "s"]
SEEN = ["range", "block", "size", "v", "r"]
NUMBERED = ["block", "range", "size", "numbers", "shared_n", "r", "s", "o", "n"]
MEMBERS = ["size", "links", "v", "r", "i", "j"]


def _groups(batches, key: str):
    """The rows of each key, as dicts; they come key by key."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != now:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _contracted(rows):
    """A block's vertices, ascending, and the place of each one's root."""
    ends = [(_unpack(r["a"], r["size"]), _unpack(r["b"], r["size"], True)) for r in rows]
    e = np.concatenate([np.concatenate([x[k] for x in ends]) for k in (0, 1)])
    v, place = np.unique(e, return_inverse=True)
    half = len(e) // 2
    return v, _roots(place[:half], place[half:], len(v))


def _see(batches, bounds: np.ndarray):
    """A row per block and range of values: the block's vertices there, and which are roots."""
    for block, rows in _groups(batches, "block"):
        v, root = _contracted(rows)
        is_root = root == np.arange(len(v))
        at = [0, *np.searchsorted(v, bounds), len(v)]
        for k, (lo, hi) in enumerate(zip(at, at[1:])):
            if lo < hi:
                yield _batch([(k, block, hi - lo, _pack(v[lo:hi], True), _bits(is_root[lo:hi]))], SEEN)


def _number(batches):
    """For each range and block: numbers (from 0 in the range) of the block's roots, which vertices other blocks have too, which are left to this block, and numbers of the former."""
    for k, rows in _groups(batches, "range"):
        parts = [_unpack(r["v"], r["size"], True) for r in rows]
        known, first, place, times = np.unique(np.concatenate(parts), return_index=True, return_inverse=True, return_counts=True)
        at = 0
        for r, v in zip(rows, parts):
            mine = place[at : at + len(v)]
            own = first[mine] == np.arange(at, at + len(v))
            shared = times[mine] > 1
            yield _batch([(r["block"], k, len(v), len(known), int(shared.sum()), _pack(mine[_mask(r["r"], len(v))], True), _bits(shared), _bits(own), _pack(mine[shared], True))], NUMBERED)
            at += len(v)


def _link(batches, offsets: dict):
    """For each block: its own vertices and the numbers of their roots; links (i, j) of roots and shared vertices, by number."""
    for _, rows in _groups(batches, "block"):
        v, root = _contracted([r for r in rows if r["range"] < 0])
        is_root = root == np.arange(len(v))
        number, shared, own = np.zeros(len(v), np.int64), np.zeros(len(v), bool), np.zeros(len(v), bool)
        lo = 0
        for r in rows:
            if r["range"] >= 0:
                hi, base = lo + r["size"], offsets[r["range"]]
                roots = lo + np.flatnonzero(is_root[lo:hi])
                number[roots] = base + _unpack(r["r"], len(roots), True)
                shared[lo:hi], own[lo:hi] = _mask(r["s"], r["size"]), _mask(r["o"], r["size"])
                number[lo + np.flatnonzero(shared[lo:hi])] = base + _unpack(r["n"], r["shared_n"], True)
                lo = hi
        i, j = number[root[shared]], number[shared]
        i, j = i[i != j], j[i != j]
        yield _batch([(int(own.sum()), len(i), _pack(v[own], True), _pack(number[root[own]]), _pack(i), _pack(j))], MEMBERS)


def _spread(batches, names: tuple, size: str, ascending: tuple):
    """The numbers of two packed columns, a row each."""
    for batch in batches:
        for row in batch.to_pylist():
            x, y = (_unpack(row[k], row[size], up) for k, up in zip(names, ascending))
            for at in range(0, len(x), ROWS):
                yield pa.record_batch([pa.array(z[at : at + ROWS]) for z in (x, y)], ["i", "j"])


def _schema(names: list[str]) -> str:
    return ", ".join(f"`{k}` {'binary' if len(k) == 1 else 'bigint'}" for k in names)


def classes(edges: DataFrame, n: int) -> DataFrame:
    """(v, label): each vertex of n edges (a, b), a <= b, none negative, and the least number in its component; vertices are numbered 1, 2, ... in ascending order."""
    blocks = max(1, -(-n // EDGES))
    dealt = graph._cut(edges.select("a", "b").mapInArrow(partial(_deal, n=blocks), _schema(DEALT)))
    sample = [np.frombuffer(r.s, np.int64) for r in dealt.filter("length(s) > 0").select("s").collect()]
    sample = np.sort(np.concatenate([*sample, np.zeros(0, np.int64)]))
    bounds = np.unique(sample[[len(sample) * k // blocks for k in range(1, blocks)]]) if len(sample) else sample
    by = lambda x, *keys: x.repartition(2 * blocks, keys[0]).sortWithinPartitions(*keys)
    edges_of = dealt.select(*DEALT[:4])
    seen = by(edges_of, "block").mapInArrow(partial(_see, bounds=bounds), _schema(SEEN))
    numbered = graph._cut(by(seen, "range", "block").mapInArrow(_number, _schema(NUMBERED)))
    counts = dict(numbered.groupBy("range").agg(F.max("numbers")).collect())
    offsets, total = {}, 1
    for k in sorted(counts):
        offsets[k], total = total, total + counts[k]
    both = edges_of.withColumn("range", F.lit(-1).cast("long")).unionByName(numbered, allowMissingColumns=True)
    members = graph._cut(by(both, "block", "range").mapInArrow(partial(_link, offsets=offsets), _schema(MEMBERS)))
    spread = lambda *how: members.mapInArrow(partial(_spread, names=how[0], size=how[1], ascending=how[2]), "i bigint, j bigint")
    found = spread(("v", "r"), "size", (True, False)).toDF("v", "r")
    left = members.agg(F.sum("links")).first()[0] or 0
    if not left:
        return found.withColumnRenamed("r", "label")
    links = spread(("i", "j"), "links", (False, False))
    if graph.BLOCK < left <= n // 2:
        # numbers of numbers: the least vertex of a class is the one with the least number
        inner = classes(links.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")), left)
        joined = graph._cut(inner)
        least = joined.groupBy("label").agg(F.min("v").alias("component"))
        links = joined.join(least, "label").select("v", "component")
    else:
        links = graph.components(links)
    joined = links.select(F.col("v").alias("r"), "component")
    return found.join(joined, "r", "left").select("v", F.coalesce("component", "r").alias("label"))
