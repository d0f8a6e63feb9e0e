"""Near-duplicate documents: a signature-coordinate inverted join with exact confirmation.

A document's set: its distinct 4-word shingles as 64-bit hashes; of fewer words,
the whole sequence as one.  One-permutation MinHash cuts the hash range into
BINS coordinates; a coordinate's value is the least hash in it (none, if empty).

1. Documents with equal sets are one class (128-bit digest of the set, cut to 96 bits).
2. Coordinate-value pairs are counted, and a class stays in the lists of its
   rarest pairs only: two sets with Jaccard >= 0.8 differ in at most n // 4 shingles
   of either's count n, so in as many coordinates at most; for large sets, two
   such sets differ in more than SLACK of BINS coordinates with a probability
   below 1e-12 (binomial, a fifth each).  So min(n // 4, SLACK) + 1 pairs
   suffice for a common list.  Pairs that no other class has come first and need no list.
3. Each posting list pairs its members with one of them, its centre; collisions are counted over the whole
   signatures, and pairs below the match threshold of step 2 are dropped.
4. Pairs are confirmed on the full sets: of a class first the pair with most
   postings in common, and of the others those between different components (skip merging).
5. Lists whose members still are in several components: members outside the
   largest meet all others, packed into groups, and only pairs above the match threshold come out;
   long lists are first dealt out anew by the rarest n - ceil(0.8 n) + 1
   shingles of each member, an exact prefix filter, and two groups count all their
   intersections at once and give a spanning forest of the links (skip merging).
   So no list emits all its pairs, and no link between components is lost.

Very long lists are not dealt out by their token: see common.spread_join.
Words are known by 64-bit hashes mixed word by word (beyond LONG bytes: BLAKE2b).

Links, components and sets stay in tables; lineage is cut by written tables.

Defined results: null, empty or blank texts have no shingles, component_id =
doc_id, kept; rows with equal doc_id are nodes of their own, that the id doesn't link; a null doc_id
is no component's smallest unless all are null; repeated rows form one class;
an empty table gives no rows; other columns are ignored by `report` and kept by `keep`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenequery.llm.common import BATCH_ROWS, materialise, spread_join, spread_join_sized

SHINGLE, BINS, SLACK, SHORT_LIST = 4, 64, 38, 64
#: Members of long lists meet in groups of so many, or of so many shingles; so many columns of two groups are counted at a time.
GROUP, MOST_SHINGLES, COLUMNS = 256, 1 << 19, 4096
#: Edges that one task contracts.
BLOCK = 1 << 18
#: Jaccard threshold as a fraction.
PART, WHOLE = 80, 100
EMPTY = 0xFFFFFFFF

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of more bytes are hashed one by one.
LONG = 64
#: Keeps the first n bytes of a little-endian number of 8 bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut_words(texts: list[bytes], blank: np.ndarray = _BLANK, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of all texts: their hashes, the number of words before each text, their first bytes and ends, and the folded bytes that these point into.

    Words stand between bytes of `blank` and are read through `fold`; eight bytes at a time are mixed in.
    """
    joined = np.frombuffer(b" ".join([*texts, bytes(8)]), np.uint8)
    joined = joined[: len(joined) - 8]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[: len(texts)]
    solid = ~blank[joined]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    size = end - first
    bytes_ = np.concatenate([fold[joined], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(bytes_) - 7,), "<u8", bytes_.data, strides=(1,))
    h = _mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(size <= LONG)
    for j in range(0, LONG, 8):
        at = at[size[at] > j]
        if not len(at):
            break
        h[at] = _mix((h[at] ^ (eight[first[at] + j] & _FIRST[np.minimum(size[at] - j, 8)])) + np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(bytes_[first[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h, np.searchsorted(first, np.append(starts, len(joined))), first, end, bytes_


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words before each text."""
    return cut_words(texts)[:2]


def sets_of(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    out = []
    for i in range(0, len(texts), 64):
        part = texts[i : i + 64]
        h, at = word_hashes(part)
        n = max(0, len(h) - size + 1)
        x = _mix(h[:n].copy())
        for j in range(1, size):
            x = _mix(x * np.uint64(0x9FB21C651E98DF25) + h[j : j + n])
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= size:
                out.append(np.unique(x[a : b - size + 1]))
            elif b > a:
                whole = np.frombuffer(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), np.uint64)
                out.append(whole)
            else:
                out.append(np.empty(0, np.uint64))
    return out


_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - (BINS - 1).bit_length())).astype(np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """BINS values (uint32) of a sorted set; EMPTY where a coordinate has none."""
    at = np.searchsorted(s, _EDGES)
    full = np.append(at[1:], len(s)) > at
    out = np.full(BINS, EMPTY, np.uint32)
    out[full] = np.minimum((s[at[full]] >> np.uint64(20)) & np.uint64(EMPTY), np.uint64(EMPTY - 1))
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=12).digest()


def _sign(batches):
    for batch in batches:
        sets = sets_of([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
        yield pa.record_batch(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([int((signature(s) != EMPTY).sum()) for s in sets], pa.int32())],
            ["doc_id", "n", "v", "sig", "m"],
        )


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, v, sig, m: coordinates with a value) of each document, written once; v and sig are null without shingles."""
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sign, "doc_id bigint, n bigint, v binary, sig binary, m int"), "signatures")


def _pairs_of(sig: bytes) -> np.ndarray:
    x = np.frombuffer(sig, np.uint32)
    full = np.flatnonzero(x != EMPTY)
    return (full.astype(np.uint64) << np.uint64(32)) | x[full]


def _post(batches):
    for batch in batches:
        tokens = [_pairs_of(sig) for sig in batch.column(1).to_pylist()]
        if tokens:
            rows = pa.array(np.repeat(np.arange(len(tokens)), [len(x) for x in tokens]))
            yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), batch.column(0).take(rows)], ["token", "v"])


def _post_sets(batches):
    for batch in batches:
        for i, raw in enumerate(batch.column(1).to_pylist()):
            s = np.frombuffer(raw, np.int64)
            yield pa.record_batch([pa.array(s), batch.column(0).take(pa.array(np.full(len(s), i)))], ["token", "v"])


def rarest(posted: DataFrame, limits: DataFrame) -> DataFrame:
    """(token, v, n) of posted(token, v) for the first `most` of v's `m` tokens, rarest first, that other v have too; limits(v, n, m, most)."""
    counts = materialise(posted.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "counts")
    x = spread_join_sized(posted, counts, "token", "size").join(limits, "v")
    own = Window.partitionBy("v")
    x = x.withColumn("common", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("size", F.xxhash64("token"), "token")))
    return x.filter(F.col("rank") <= F.col("most") - F.col("m") + F.col("common")).select("token", "v", "n")


def _matches(batches):
    """Keep pairs whose signatures agree often enough."""
    for batch in batches:
        a, b = (np.array([np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()]).reshape(-1, BINS) for c in ("sig_a", "sig_b"))
        same = ((a == b) & (a != EMPTY)).sum(1)
        ok = np.ones(len(same), bool)
        for x, c in ((a, "n_a"), (b, "n_b")):
            ok &= same >= (x != EMPTY).sum(1) - np.minimum(batch.column(c).to_numpy() // 4, SLACK)
        yield batch.filter(pa.array(ok)).select(["a", "b", "w"])


def _alike(x: bytes, y: bytes) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return WHOLE * both >= PART * (len(x) + len(y) - both)


def _confirm(batches):
    for batch in batches:
        ok = [_alike(x, y) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())]
        yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])


def _full_sets(batches):
    for batch in batches:
        sets = sets_of([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()])
        yield pa.record_batch([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["v", "set"])


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
    for i in range(0, len(nodes), BATCH_ROWS):
        part = nodes[i : i + BATCH_ROWS]
        yield pa.record_batch([pa.array(part, pa.binary()), pa.array([root(v) for v in part], pa.binary())], ["v", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of all ends of edges(a, b): label is the least v of the component.

    Blocks of at most about BLOCK edges are contracted to stars, each in one task; of several
    blocks' stars, least labels spread along edges and jump along labels.
    """
    blocks = -(-edges.count() // BLOCK)
    edges = edges.select("a", "b")
    stars = materialise((edges.repartition(blocks) if blocks > 1 else edges.coalesce(1)).mapInArrow(_contract, "v binary, label binary"), "stars")
    if blocks <= 1:
        return stars
    both = materialise(stars.select("v", F.col("label").alias("w")).union(stars.select("label", "v")).distinct(), "edges")
    label = materialise(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = spread_join(both, label.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("label").alias("m"))
        step = label.join(near, "v").select("v", "label", F.least("label", "m").alias("m"))
        jump = label.select(F.col("v").alias("m"), F.col("label").alias("far"))
        new = materialise(spread_join(materialise(step, "steps"), jump, "m").select("v", "label", F.least("m", "far").alias("new")), "labels")
        label = new.select("v", F.col("new").alias("label"))
        if new.filter("label != new").isEmpty():
            return label


class Links:
    """Confirmed links between classes, found in rounds."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes = docs, classes
        self.labels = self.sets = None

    def between(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b, ...) whose ends are in different components so far."""
        if self.labels is None:
            return pairs
        for end in ("a", "b"):
            pairs = pairs.join(self.labels.select(F.col("v").alias(end), F.col("label").alias(f"l{end}")), end, "left")
        return pairs.filter(~F.coalesce("la", "a").eqNullSafe(F.coalesce("lb", "b"))).drop("la", "lb")

    def matching(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b, w) above the match threshold."""
        for end in ("a", "b"):
            pairs = pairs.join(self.classes.select(F.col("v").alias(end), F.col("n").alias(f"n_{end}"), F.col("sig").alias(f"sig_{end}")), end)
        return materialise(pairs.filter(PART * F.greatest("n_a", "n_b") <= WHOLE * F.least("n_a", "n_b")).mapInArrow(_matches, "a binary, b binary, w bigint"), "pairs")

    def want(self, nodes: DataFrame) -> None:
        """Make the sets of nodes(v) at hand; those already there stay."""
        if self.sets is not None:
            nodes = nodes.join(self.sets, "v", "left_anti")
        ids = self.classes.join(nodes, "v", "left_semi").select(F.col("doc_id").alias("id"))
        text = self.docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
        new = text.mapInArrow(_full_sets, "v binary, set binary").join(nodes, "v", "left_semi").dropDuplicates(["v"])
        new = materialise(new, "sets")
        self.sets = new if self.sets is None else self.sets.union(new)

    def confirm(self, pairs: DataFrame) -> None:
        """Add the links among pairs(a, b)."""
        pairs = pairs.select("a", "b")
        self.want(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct())
        x = pairs
        for end in ("a", "b"):
            x = x.join(self.sets.select(F.col("v").alias(end), F.col("set").alias(f"set_{end}")), end)
        self.add(materialise(x.mapInArrow(_confirm, "a binary, b binary"), "links"))

    def add(self, found: DataFrame) -> None:
        """Add confirmed links(a, b)."""
        if not found.isEmpty():
            if self.labels is not None:
                found = found.union(self.labels.select("v", "label"))
            self.labels = components(found)

    def labelled(self, members: DataFrame) -> DataFrame:
        """members(token, v) with their component."""
        if self.labels is None:
            return members.withColumn("label", F.col("v"))
        return members.join(self.labels, "v", "left").withColumn("label", F.coalesce("label", "v"))


def _meet(batches):
    """Of two groups of a list's members, the pairs of different components above the match threshold.

    A pair comes out in one list alone, that of the least token that both have.
    """
    for batch in batches:
        out = []
        for token, main, left, right in zip(*(batch.column(c).to_pylist() for c in ("token", "main", "left", "right"))):
            a, b = (np.stack([np.frombuffer(g["sig"], np.uint32) for g in x]) for x in (left, right))
            na, nb = (np.array([g["n"] for g in x]) for x in (left, right))
            same = ((a[:, None] == b[None]) & (a != EMPTY)[:, None]).sum(2)
            need = [(x != EMPTY).sum(1) - np.minimum(n // 4, SLACK) for x, n in ((a, na), (b, nb))]
            near = PART * np.maximum(na[:, None], nb[None]) <= WHOLE * np.minimum(na[:, None], nb[None])
            (la, lb), (va, vb) = ([np.array([g[c] for g in x], object) for x in (left, right)] for c in ("label", "v"))
            near &= (same >= need[0][:, None]) & (same >= need[1][None]) & (la[:, None] != lb[None]) & ((lb == main)[None] | (va[:, None] < vb[None]))
            tokens = [[set(g["tokens"]) for g in x] for x in (left, right)]
            for i, j in np.argwhere(near):
                if min(tokens[0][i] & tokens[1][j]) == token:
                    out.append((min(va[i], vb[j]), max(va[i], vb[j])))
        yield pa.record_batch([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["a", "b"])


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, each a sorted array."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(shared), COLUMNS):
        part = shared[at : at + COLUMNS]
        sides = []
        for sets in (left, right):
            m = np.zeros((len(sets), len(part)), np.float32)
            for row, s in zip(m, sets):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                k = np.searchsorted(part, s)
                row[k[part[k] == s]] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _unite(batches):
    """Of two groups of a list's members with their sets, links (a, b) that unite the components which any of their links unite."""
    for batch in batches:
        out = []
        for left, right in zip(*(batch.column(c).to_pylist() for c in ("left", "right"))):
            sets = [[np.frombuffer(g["set"], np.uint64) for g in x] for x in (left, right)]
            both = common_counts(*sets)
            size = [np.array([len(s) for s in x]) for x in sets]
            alike = WHOLE * both >= PART * (size[0][:, None] + size[1][None] - both)
            number: dict = {}
            label = [np.array([number.setdefault(g["label"], len(number)) for g in x]) for x in (left, right)]
            root = list(range(len(number)))
            for i, j in np.argwhere(alike & (label[0][:, None] != label[1][None])):
                x, y = label[0][i], label[1][j]
                while root[x] != x:
                    root[x] = x = root[root[x]]
                while root[y] != y:
                    root[y] = y = root[root[y]]
                if x != y:
                    root[x] = y
                    out.append((left[i]["v"], right[j]["v"]))
        yield pa.record_batch([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["a", "b"])


def _rest(members: DataFrame, own: DataFrame, fields: list[str], group: int) -> DataFrame:
    """(token, main, left, right): groups of all outside a list's largest component beside groups of all its members.

    members(token, v, label); own(v, n, ...) has the fields a member carries.  A group has about
    `group` members, or fewer whose sets together have about MOST_SHINGLES shingles.
    """
    members = materialise(members.join(own.select("v", "n"), "v"), "members")
    sizes = members.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    main = sizes.groupBy("token").agg(F.max(F.struct("k", "label", "n")).alias("m"), F.sum("k").alias("all"), F.sum("n").alias("n")).filter("all > m.k")
    parts = lambda k, n: F.ceil(F.greatest(k / group, n / MOST_SHINGLES))
    main = main.select("token", F.col("m.label").alias("main"), parts(F.col("all") - F.col("m.k"), F.col("n") - F.col("m.n")).alias("few"), parts(F.col("all"), F.col("n")).alias("many"))
    x = spread_join(members.select("token", "v", "label"), main, "token").join(own.drop("n") if "n" not in fields else own, "v")
    one = F.collect_list(F.struct("v", "label", *fields))
    h = F.xxhash64("v")
    left = x.filter("label != main").groupBy("token", "many", F.pmod(h, "few").alias("part")).agg(one.alias("left"))
    left = left.select("token", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many").cast("long") - 1)).alias("g"))
    right = x.groupBy("token", "main", F.pmod(h, "many").cast("long").alias("g")).agg(one.alias("right"))
    return left.join(right, ["token", "g"]).select("token", "main", "left", "right")


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(signed documents, labels of classes with links or None)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = signed(docs)
    classes = materialise(marks.filter("v is not null").groupBy("v").agg(F.min(F.struct(F.col("doc_id").isNull().alias("k"), "doc_id", "n", "m", "sig")).alias("r")).select("v", "r.doc_id", "r.n", "r.m", "r.sig"), "classes")
    limits = classes.select("v", "n", F.col("m").cast("long").alias("m"), (F.least(F.floor(F.col("n") / 4), F.lit(SLACK)) + 1).alias("most"))
    posted = classes.select("v", "sig").mapInArrow(_post, "token bigint, v binary")
    posted = materialise(rarest(posted, limits).withColumn("h", F.xxhash64("token", "v")), "postings")
    first = F.min(F.struct("h", "v", "n"))
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("size"), first.alias("first")).filter("size > 1")
    lists = lists.select("token", "size", F.col("first.v").alias("c"), F.col("first.n").alias("cn"))
    shared = materialise(spread_join(posted, lists, "token"), "lists")
    pairs = shared.filter((F.col("v") != F.col("c")) & (PART * F.greatest("n", "cn") <= WHOLE * F.least("n", "cn")))
    pairs = pairs.groupBy(F.least("v", "c").alias("a"), F.greatest("v", "c").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    found = Links(docs, classes)
    pairs = found.matching(pairs)
    # the best partner of either end first
    top = pairs.groupBy("b").agg(F.max(F.struct("w", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    top = top.union(pairs.groupBy("a").agg(F.max(F.struct("w", "b")).alias("m")).select("a", F.col("m.b").alias("b"))).distinct()
    found.confirm(top)
    found.confirm(materialise(found.between(pairs.join(top, ["a", "b"], "left_anti")), "pairs"))
    short = shared.filter(F.col("size") <= SHORT_LIST).filter("size > 2").select("token", "v")
    own = short.groupBy("v").agg(F.collect_list("token").alias("tokens")).join(classes.select("v", "n", "sig"), "v")
    rest = _rest(found.labelled(short), own, ["n", "sig", "tokens"], SHORT_LIST).mapInArrow(_meet, "a binary, b binary").join(pairs, ["a", "b"], "left_anti")
    found.confirm(materialise(rest, "pairs"))
    several = found.labelled(shared.filter(F.col("size") > SHORT_LIST).select("token", "v"))
    several = several.join(several.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("token"), "token", "left_semi")
    nodes = materialise(several.select("v").distinct(), "nodes")
    if not nodes.isEmpty():
        found.want(nodes)
        limits = classes.join(nodes, "v", "left_semi").select("v", "n", F.col("n").alias("m"), (F.col("n") - F.ceil(F.col("n") * PART / WHOLE) + 1).alias("most"))
        keys = found.sets.join(nodes, "v", "left_semi").mapInArrow(_post_sets, "token bigint, v binary")
        keys = materialise(rarest(keys, limits).select("token", "v"), "prefixes")
        own = found.sets.join(nodes, "v", "left_semi").join(classes.select("v", "n"), "v")
        found.add(materialise(_rest(found.labelled(keys), own, ["set"], GROUP).mapInArrow(_unite, "a binary, b binary"), "links"))
    return marks, found.labels


def report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept."""
    marks, labels = linked(docs)
    least = marks.filter("v is not null").groupBy("v").agg(F.min("doc_id").alias("least"))
    if labels is not None:
        least = materialise(least.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v")), "least")
        whole = least.groupBy("label").agg(F.min("least").alias("m"))
        least = spread_join(least, whole, "label").select("v", F.col("m").alias("least"))
    x = marks.select("doc_id", F.col("n").alias("n_shingles"), "v").join(least, "v", "left")
    x = x.select("doc_id", "n_shingles", F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return x.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that stand for their component, with their own columns; of rows with equal doc_id, all."""
    gone = report(docs).filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")


def shingles(text: str | None) -> set:
    """The contract's set; for tests."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()
