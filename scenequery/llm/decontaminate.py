"""Benchmark decontamination by a prefix-filtered set join on windows of words.

An item of n >= 10 words has n - 9 windows of ten words; a shorter item with at
least one word is itself one window.  A window must stand in a text as a whole,
so one prefix token is all that containment needs: windows are posted under
their rarest word (rarity: the number of documents with it; ties: the hash),
and a window with a word that no document has is dropped.  Documents are joined
to the windows by that token; the window must fit into the document around it
(length and positional bounds), and the join compares all its words.

1. One pass counts, for the words of the benchmark, the documents that have them.
2. Windows take their rarest word; all of them stay in a written table.
3. One pass over the documents looks for words whose bit is set in a bitmap of
   the prefix tokens, and around them for places whose bit is set in a bitmap of
   the windows.  Bitmaps have BITS bits at most, whatever the benchmark's size, and
   let more through when they fill up, never less.  Such places go out with their words.
4. Places meet windows by token and words; hits are united per document.

Items and documents of any number take the same way; no table of windows is
collected.  What a document's row gathers is its own hits and the items of these.

Defined results: a null or empty text has no words, so n_words = 0 and nothing
hit; a null or empty item has no windows; a null item_id counts under the name
"null"; repeated items count once by item_id; repeated documents give repeated
rows; an empty benchmark hits nothing.  Other columns of either table have no
effect.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequery.llm.common import materialise, spread_join
from scenequery.llm.minhash import _mix, cut_words

#: Words of a window; bits of a bitmap, and bits for each entry below that.
WINDOW, BITS, BITS_EACH = 10, 1 << 26, 32

#: Lower-cases A-Z and turns what is no word byte into a space: word bytes are [0-9a-z] and all of UTF-8 beyond ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FOLD = np.frombuffer(FOLD, np.uint8)
_NO_WORD = _FOLD == 32


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    n = min(size, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def window_hashes(h: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each start on."""
    x = np.full(len(start), n, np.uint64)
    for j in range(n):
        x = _mix(x * np.uint64(0x9FB21C651E98DF25) + h[start + j])
    return x


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


# The benchmark's side.


def _windows(size: int):
    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                words = words_of(text)
                h = cut_words([text], _NO_WORD, _FOLD)[0]
                n = min(size, len(words))
                for i in range(0, len(words) - n + 1 if n else 0, 2000):
                    at = np.arange(i, min(i + 2000, len(words) - n + 1))
                    yield pa.record_batch(
                        [pa.array([item] * len(at)), pa.array([b" ".join(words[a : a + n]) for a in at], pa.binary()), pa.array(np.full(len(at), n, np.int32)), pa.array(window_hashes(h, at, n).view(np.int64)), pa.array([h[a : a + n].view(np.int64) for a in at], pa.list_(pa.int64()))],
                        ["item", "w", "n", "h", "words"],
                    )

    return run


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, w, n, h, words): the windows of every item, their words joined by spaces, and the words' hashes."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("string").alias("t"))
    return materialise(items.mapInArrow(_windows(size), "item string, w binary, n int, h bigint, words array<bigint>").distinct(), "windows")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits, a power of two of them and BITS at most, set where a value of hashes(h) points; collected as numbers of 64 bits."""
    n = hashes.count()
    bits = 1 << 16
    while bits < min(BITS, n * BITS_EACH):
        bits *= 2
    at = hashes.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("b"))
    rows = at.groupBy(F.shiftrightunsigned("b", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("x")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("i").to_numpy()] = rows.column("x").to_numpy()
    return out.view(np.uint8)


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _count_words(bits):
    def run(batches):
        for batch in batches:
            texts = _texts(batch.column(0))
            found = []
            for i in range(0, len(texts), 64):
                h, at, *_ = cut_words(texts[i : i + 64], _NO_WORD, _FOLD)
                k = np.flatnonzero(has(bits.value, h))
                both = np.stack([np.searchsorted(at, k, "right").astype(np.uint64), h[k]])
                found.append(np.unique(both, axis=1)[1] if len(k) else h[:0])
            words, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(n)], ["token", "df"])

    return run


def prefixes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(token, at, n, w, h): the distinct ones of windows found(w, n, h, words), each under its rarest word, the at-th."""
    each = materialise(found.select("w", "n", "h", F.posexplode("words").alias("at", "token")).distinct(), "window-words")
    vocabulary = each.select(F.col("token").alias("h")).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(materialise(vocabulary, "vocabulary")))
    df = docs.select("text").mapInArrow(_count_words(bits), "token bigint, df bigint").groupBy("token").agg(F.sum("df").alias("df"))
    x = spread_join(each, materialise(df, "word-counts"), "token")
    x = x.groupBy("w", "n", "h").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("df", "token", "at")).alias("m")).filter("k = n")
    return materialise(x.select("m.token", "m.at", "n", "w", "h"), "prefixes")


# The documents' side.

PLACES = "array<struct<start:int,token:bigint,at:int,w:binary>>"
_PLACE = pa.struct([("start", pa.int32()), ("token", pa.int64()), ("at", pa.int32()), ("w", pa.binary())])


def _places(tokens, whole, shapes: list[tuple[int, int]]):
    """n_words and the places that may be windows; shapes: (place of the token in the window, words of the window)."""

    def run(batches):
        for batch in batches:
            texts = _texts(batch.column(2))
            n_words, places = [], []
            for i in range(0, len(texts), 64):
                h, at, first, end, folded = cut_words(texts[i : i + 64], _NO_WORD, _FOLD)
                n_words.extend(np.diff(at).tolist())
                rows = [[] for _ in at[1:]]
                near = np.flatnonzero(has(tokens.value, h))
                doc = np.searchsorted(at, near, "right") - 1
                for back, n in shapes if len(near) else ():
                    ok = (near - back >= at[doc]) & (near - back + n <= at[doc + 1])
                    start, d, token = near[ok] - back, doc[ok], near[ok]
                    ok = has(whole.value, window_hashes(h, start, n))
                    for s, k, t in zip(start[ok].tolist(), d[ok].tolist(), token[ok].tolist()):
                        w = b" ".join(folded[first[j] : end[j]].tobytes() for j in range(s, s + n))
                        rows[k].append((s - int(at[k]), int(h[t : t + 1].view(np.int64)[0]), back, w))
                places.extend([dict(zip(("start", "token", "at", "w"), p)) for p in r] or None for r in rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(places, pa.list_(_PLACE))], ["doc_id", "mark", "n_words", "places"])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row per document: doc_id, mark (a hash of the text), n_words, places; the windows; and the hits (doc_id, mark, start, n, w).

    Documents that share doc_id and text share their hits.
    """
    sc = docs.sparkSession.sparkContext
    found = windows(benchmark, size)
    first = prefixes(docs, found.select("w", "n", "h", "words"))
    shapes = sorted(tuple(r) for r in first.select("at", "n").distinct().collect())  # at most `size` lengths, each with as many places
    tokens, whole = (sc.broadcast(bitmap(x)) for x in (first.select(F.col("token").alias("h")), first.select("h")))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    x = materialise(x.mapInArrow(_places(tokens, whole, shapes), f"doc_id bigint, mark bigint, n_words bigint, places {PLACES}"), "places")
    one = x.filter("places is not null").select("doc_id", "mark", F.explode("places").alias("p")).select("doc_id", "mark", "p.start", "p.token", "p.at", "p.w").distinct()
    one = materialise(one.withColumn("key", F.struct("token", "at", "w")), "candidates")
    hits = spread_join(one.select("doc_id", "mark", "start", "key"), first.select(F.struct("token", "at", "w").alias("key"), "n"), "key")
    hits = materialise(hits.select("doc_id", "mark", "start", "n", F.col("key.w").alias("w")), "hits")
    return x, found, hits


def report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    x, found, hits = overlaps(docs, benchmark, **kw)
    key = ["doc_id", "mark"]
    # the union of the hit ranges, in the order of their starts
    spans = hits.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    united = F.aggregate("spans", F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n")))
    spans = spans.select(*key, united["n"].alias("n_hit"))
    items = hits.select(*key, "w").distinct().join(found.select("w", "item"), "w").select(*key, "item").distinct()
    items = items.groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    got = spans.join(items, (spans["doc_id"].eqNullSafe(items["doc_id"])) & (spans["mark"] == items["mark"])).select(spans["doc_id"].alias("d"), spans["mark"].alias("m"), "n_hit", "items")
    no = F.array().cast("array<string>")
    clean_ = x.filter("places is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), no.alias("items"))
    some = x.filter("places is not null").drop("places")
    some = some.join(got, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", no).alias("items"))
    return clean_.unionByName(some).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that no window hits, with their own columns."""
    names = docs.columns
    gone = overlaps(docs, benchmark, **kw)[2].select(F.col("doc_id").alias("gone_"), F.col("mark").alias("mark_")).distinct()
    x = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    return x.join(gone, doc_id.cast("long").eqNullSafe(F.col("gone_")) & (F.xxhash64(text.cast("string")) == F.col("mark_")), "left_anti").toDF(*names)


def brute(docs: list[tuple], items: list[tuple], size: int = WINDOW) -> list[tuple]:
    """The contract, word by word; for tests."""
    out = []
    for doc_id, text in docs:
        words, hit, ids = words_of(text.encode() if text else None), set(), set()
        for item_id, t in items:
            for w in windows_of(words_of(t.encode() if t else None), size):
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        hit.update(range(i, i + len(w)))
                        ids.add(str(item_id))
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
