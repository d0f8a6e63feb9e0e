"""Document fingerprints from closed syncmers over words.

Of the k-word windows of a text, those count whose smallest inner s-word window
(by hash) is the first or the last: whether a window counts depends on its own
words only, so an edit elsewhere neither adds nor drops it, and the windows
that count anchor the same places in any text that shares the passage.
Words are what stands between spaces and line feeds; a text of fewer than k words, but not
none, has all of them as its one window.  The fingerprint is the smallest distinct
hashes of the windows that count: one in PART of them, SKETCH at least, so that it grows
with the text; likeness is the share of common hashes among as many of the smallest of both
together as the shorter fingerprint has (SKETCH at least).

Texts meet their successor by id: the order is found on ids alone, in buckets
between quantiles of the ids, and a text moves once, with the needed part of the
next one.  All is DataFrame functions.

Defined results: a null text is an empty one; an empty fingerprint equals
itself (likeness 1) and nothing else (0); of documents with equal doc_id, each
is followed by the next smaller id, and of those that share it the text that
sorts first stands for it; a null doc_id sorts below all (the smallest long
counts as null); a lone document
follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequery.llm.hof import let, none

K, S, SKETCH, PART = 5, 3, 64, 8
#: Ids of a bucket, and most buckets.
BUCKET_ROWS, MOST_BUCKETS = 5_000, 256
#: Stands for a null doc_id.
NULL_ID = -(1 << 63)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")


def _windows(text: Column, k: int, s: int, out) -> Column:
    """out(i, hash) for each closed syncmer, in order."""

    def from_hashes(h: Column) -> Column:
        inner = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, s)]))

        def closed(m: Column) -> Column:
            w, n = k - s + 1, F.size(h) - k + 1
            at = lambda i, j: F.get(m, i + j)
            # inner windows that together hold all words: first, last, and every s-th between
            parts = lambda a, i: F.xxhash64(a, *[at(i, j) for j in range(s, w - 1, s)], *([at(i, w - 1)] if w > 1 else []))
            edge = lambda a, i: (F.least(a, at(i, w - 1)) <= (F.least(*[at(i, j) for j in range(1, w - 1)]) if w > 3 else at(i, 1))) if w > 2 else F.lit(True)
            return F.filter(F.transform(m, lambda a, i: F.when((i < n) & edge(a, i), out(i, parts(a, i)))), lambda x: x.isNotNull())

        whole = F.array(out(F.lit(0), F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))))
        return F.when(F.size(h) >= k, let(inner, closed)).when(F.size(h) > 0, whole)

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), from_hashes)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<pos, hash>> of the windows that count; pos: the window's first word."""
    return F.coalesce(_windows(F.coalesce(text, F.lit("")), k, s, lambda i, h: F.struct(i.cast("int").alias("pos"), h.alias("hash"))), none("struct<pos:int,hash:bigint>"))


def sketch(text: Column, k: int = K, s: int = S, size: int = SKETCH, part: int = PART) -> Column:
    """The fingerprint as sorted hashes."""
    least = lambda h: F.slice(h, F.lit(1), F.greatest(F.lit(size), F.ceil(F.size(h) / part).cast("int")))
    return F.coalesce(let(F.sort_array(F.array_distinct(_windows(F.coalesce(text, F.lit("")), k, s, lambda i, h: h))), least), none("bigint"))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    first = F.slice(F.sort_array(F.array_union(a, b)), F.lit(1), F.greatest(F.lit(size), F.least(F.size(a), F.size(b))))
    share = let(first, lambda f: F.size(F.array_intersect(f, F.array_intersect(a, b))) / F.greatest(F.size(f), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(share)


def shared_anchors(a: Column, b: Column) -> Column:
    """Positional matching: array<struct<pos_a, pos_b>> of anchors whose hash stands once in either text."""
    once = lambda x: F.map_from_entries(F.transform(F.filter(F.array_distinct(F.transform(x, lambda e: e["hash"])), lambda h: F.size(F.filter(x, lambda e: e["hash"] == h)) == 1), lambda h: F.struct(h, F.get(F.filter(x, lambda e: e["hash"] == h), 0)["pos"])))
    return let(once(b), lambda m: F.transform(F.filter(F.map_entries(once(a)), lambda e: F.map_contains_key(m, e["key"])), lambda e: F.struct(e["value"].alias("pos_a"), F.try_element_at(m, e["key"]).alias("pos_b"))))


def next_ids(ids: DataFrame) -> DataFrame:
    """ids(doc_id, ...), distinct and not null, with next_id: the next smaller one; after the smallest, the largest."""
    known = ids.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    if not known[0]:
        return ids.withColumn("next_id", F.col("doc_id"))
    n = min(MOST_BUCKETS, -(-known[0] // BUCKET_ROWS))
    cuts = []
    if n > 1:
        cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []))

    def bucket(lo: int, hi: int) -> Column:  # the number of cuts that are <= doc_id, by bisection
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < cuts[mid], bucket(lo, mid)).otherwise(bucket(mid + 1, hi))

    x = ids.withColumn("bucket", bucket(0, len(cuts)))
    tops = dict(x.groupBy("bucket").agg(F.max("doc_id")).collect())  # a row per bucket
    below, last = {}, None
    for b in sorted(tops):
        below[b], last = last, tops[b]
    lowest = min(tops)
    step = F.lead("doc_id").over(Window.partitionBy("bucket").orderBy(F.col("doc_id").desc()))
    end = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id")) == 1
    jump = F.lit(None).cast("long")
    for b, top in below.items():
        jump = F.when(F.col("bucket") == b, F.lit(known[1] if b == lowest else top).cast("long")).otherwise(jump)
    return x.withColumn("next_id", F.when(end, jump).otherwise(step)).drop("bucket")


def report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The texts are dealt out by id once; that exchange serves both the documents
    and their successors, whose needed part goes on to the document before.
    """
    x = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = next_ids(x.groupBy("doc_id").agg(F.max(F.length("text")).alias("n")))
    want = ids.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), F.floor(F.col("n") / 2).cast("int").alias("part"))
    x = x.repartition("doc_id")
    one = x.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter("rank = 1")
    after = one.join(want, "doc_id").select(F.col("before").alias("doc_id"), F.substring("text", F.lit(1), F.col("part")).alias("start"), sketch(F.col("text")).alias("next_sketch"))
    y = x.join(after, "doc_id")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    y = y.select("doc_id", n.cast("long").alias("n_chars"), "text", F.concat(F.substring("text", F.lit(1), n - half), F.substring("start", F.lit(1), half)).alias("edited"), "next_sketch")
    y = y.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), sketch(F.col("text")).alias("a"), sketch(F.col("edited")).alias("e"), "next_sketch")
    return y.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("next_sketch")).alias("near_next"))
