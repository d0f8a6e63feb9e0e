"""Line deduplication by content-defined chunks of lines.

A line ends at a newline and, as passages begin and end inside lines, behind words
with certain last letters (ENDS).  A boundary stands behind a line where the rolling
hash of the last two lines is 0 modulo DIVISOR.  Boundaries depend on nearby lines only,
so that a passage put into another text is cut alike from its first boundary on.
The lines between two boundaries are a piece; a chunk is SPAN pieces in a row, and
chunks overlap: whatever lies between the first and the last boundary of a repeated
passage is covered.  What is cut off at its ends, about a piece on either side, stays.
A text of fewer pieces is one chunk.

Chunks of at least `least` characters that occur more than once anywhere
are removed, except those of the least doc_id that has them, and there
all but the first.  They meet by a 64-bit hash; then the bytes of
all pieces of repeated chunks are compared: pieces under one hash must be the
same bytes, and chunks under one hash the same pieces; what fails stays.

Counts meet after partial aggregation; chunks then meet their count by hash, and
hashes of many chunks (HOT_KEYS at most, whatever the data) by broadcast.  What is removed is
collected per document (its own chunks).  All is DataFrame functions.

Defined results: a null text stays null; an empty one has nothing to remove;
of rows with equal doc_id, neither goes for the other's sake; equal rows are
cleaned alike; a null doc_id is the least; an empty table gives no rows; other
columns are kept by `clean` and ignored by `report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequery.llm import common
from scenequery.llm.common import materialise
from scenequery.llm.hof import let, none

DIVISOR, SPAN, MIN_CHARS = 3, 2, 60
ENDS = ("\n", "e ", "s ", "n ")
#: Stands for a null doc_id.
NULL_ID = -(1 << 63)
#: Stands where a text is cut; a text that holds it is cut by a pattern instead.
MARK = "\x01"


def lines_of(text: Column) -> Column:
    """The lines, each with its end; joined they are the text."""
    marked = text
    for end in ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, "|".join(f"(?<={e})" for e in ENDS), -1)).otherwise(F.split(marked, MARK, -1))


def _bounds(lines: Column, divisor: int) -> Column:
    """Numbers of lines before each boundary, and of all."""
    closes = lambda x, i: (i == F.size(lines) - 1) | ((i > 0) & (F.pmod(F.xxhash64(x, F.get(lines, i - 1)), F.lit(divisor)) == 0))
    return F.filter(F.transform(lines, lambda x, i: F.when(closes(x, i), i + 1)), lambda e: e.isNotNull())


def _pieces(text: Column, divisor: int, of) -> Column:
    """of(lines of the piece) for each piece."""

    def cut(lines: Column, b: Column) -> Column:
        start = lambda i: F.when(i == 0, 0).otherwise(F.get(b, i - 1))
        return F.transform(b, lambda e, i: of(F.slice(lines, start(i) + 1, e - start(i))))

    return let(lines_of(text), lambda lines: let(_bounds(lines, divisor), lambda b: cut(lines, b)))


def pieces_of(text: Column, divisor: int = DIVISOR) -> Column:
    """array<string>: the text cut at the boundaries; joined they are the text."""
    return _pieces(text, divisor, lambda lines: F.array_join(lines, ""))


def _keyed(text: Column) -> Column:
    """The hashes of a text's chunks, in order."""

    def of(h: Column) -> Column:
        n = F.greatest(F.size(h) - SPAN + 1, F.lit(1))
        return F.transform(F.slice(h, F.lit(1), n), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, SPAN)]))

    return let(_pieces(text, DIVISOR, lambda lines: F.xxhash64(lines)), of)


def _id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID))


def _mark(text: Column) -> Column:
    """Tells texts of equal doc_id apart."""
    return F.shiftrightunsigned(F.xxhash64(text), 33).cast("int")


def marks(docs: DataFrame) -> DataFrame:
    """(d, m, found): per doc_id and mark of the text, its chunks that occur more than once: array<struct<no, h, gone>>, in order."""
    text = F.col("text").cast("string")
    x = docs.select(_id(docs).alias("d"), _mark(text).alias("m"), F.posexplode(_keyed(text)).alias("no", "h"))
    x = materialise(x, "chunks", plain=("h",))
    groups = materialise(x.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first")).filter("n > 1"), "chunk-groups", clean=True)
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(common.COLD_ROWS, total // common.HOT_KEYS)
    # chunks of hot hashes are not dealt out by hash, where each hash would fall to one task; a hash join does not sort the others
    few = groups.filter(hot).select("h", "first")
    rare = x.join(F.broadcast(few.select("h")), "h", "left_anti").join(groups.filter(~hot).select("h", "first").hint("shuffle_hash"), "h")
    x = x.join(F.broadcast(few), "h").unionByName(rare)
    one = F.struct("h", "no", (F.col("d") != F.col("first")).alias("gone"))
    found = x.groupBy("d", "m").agg(F.sort_array(F.collect_set(one)).alias("found"))
    # of equal chunks of one text the first stays
    again = lambda a: F.transform(a, lambda c, i: F.struct(c["no"].alias("no"), c["h"].alias("h"), (c["gone"] | F.coalesce(F.get(a, i - 1)["h"] == c["h"], F.lit(False))).alias("gone")))
    return found.select("d", "m", F.sort_array(let(F.col("found"), again)).alias("found"))


def refuted(cut: DataFrame) -> DataFrame:
    """(h): of cut(pieces, found), hashes of chunks that stand for different pieces, stand alone (their like was too short), or hold a piece whose hash stands for different bytes."""
    size = F.size("pieces")
    numbers = F.array_distinct(F.flatten(F.transform("found", lambda c: F.sequence(c["no"], F.least(c["no"] + (SPAN - 1), size - 1)))))
    of = lambda i: F.get("pieces", i)
    bytes_ = F.transform(numbers, lambda i: F.struct(F.xxhash64(of(i)).alias("key"), F.lit(False).alias("chunk"), of(i).cast("binary").alias("x")))
    hashes = lambda c: F.array_join(F.transform(F.slice("pieces", c["no"] + 1, F.lit(SPAN)), lambda p: F.xxhash64(p).cast("string")), " ").cast("binary")
    chunks = F.transform("found", lambda c: F.struct(c["h"].alias("key"), F.lit(True).alias("chunk"), hashes(c).alias("x")))
    rows = cut.select(F.explode(F.concat(bytes_, chunks)).alias("r")).select("r.*")
    # grouping by the bytes compares them; what differs under one key stands in two groups
    same = rows.groupBy("key", "chunk", "x").agg(F.count(F.lit(1)).alias("n"))
    wrong = materialise(same.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).filter("k > 1 OR chunk AND n = 1").select("key", "chunk"), "refuted", clean=True)
    holds = cut.select(F.explode("found").alias("c"), "pieces").select("c.h", F.explode(F.slice("pieces", F.col("c.no") + 1, F.lit(SPAN))).alias("p"))
    direct = wrong.filter("chunk").select(F.col("key").alias("h"))
    if wrong.filter("not chunk").isEmpty():
        return direct
    return direct.union(holds.withColumn("key", F.xxhash64("p")).join(wrong.filter("not chunk").select("key"), "key", "left_semi").select("h")).distinct()


def _without(pieces: Column, gone: Column) -> Column:
    """The pieces joined, but for those whose numbers are in gone, ascending."""
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
    end = lambda i: F.when(i == F.size(gone), F.size(pieces)).otherwise(F.get(gone, i))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.array_join(F.slice(pieces, start(i) + 1, end(i) - start(i)), "")), "")


def _cut(docs: DataFrame, least: int, whole=None) -> DataFrame:
    """docs with columns c0, c1, ..., found, and pieces in place of the text where something was found; whole: more columns, of the text."""
    names = docs.columns
    found = materialise(marks(docs), "chunk-marks", clean=True).withColumnsRenamed({"d": "d_", "m": "m_"})
    x = docs.toDF(*[f"c{i}" for i in range(len(names))])
    name = f"c{names.index('text')}"
    text = F.col(name).cast("string")
    # a hash join: texts are not sorted, and the other side holds a row of a few numbers a text
    x = x.join(found.hint("shuffle_hash"), (F.coalesce(F.col(f"c{names.index('doc_id')}").cast("long"), F.lit(NULL_ID)) == F.col("d_")) & (_mark(text) == F.col("m_")), "left").drop("d_", "m_")
    more = whole(text) if whole else {}
    keep = F.when(F.col("found").isNull() & F.lit(not whole), text)
    x = x.select(*[F.col(c) if c != name else keep.alias(c) for c in x.columns if c != "found"], *[v.alias(k) for k, v in more.items()], "found", F.when(F.col("found").isNotNull(), pieces_of(text)).alias("pieces"))
    # short chunks are told from their text, and take no part from here on
    size = lambda c: sum((F.coalesce(F.length(F.get("pieces", c["no"] + j)), F.lit(0)) for j in range(1, SPAN)), F.length(F.get("pieces", c["no"])))
    long = F.filter("found", lambda c: size(c) >= least)
    # texts, on the disk beside the exchange they came by
    return materialise(x.withColumn("found", long), "chunk-cut", codec="zstd", clean=True)


def _cleaned(x: DataFrame) -> DataFrame:
    """What _cut gives, with gone_chunks, and left: the text that stays, null where the text had no repeated chunk."""
    some = x.filter(F.size("found") > 0)
    wrong = materialise(refuted(some.select("pieces", "found")), "chunk-refuted", clean=True)
    gone = F.filter("found", lambda c: c["gone"])
    if not wrong.isEmpty():
        bad = some.select(F.col("found").alias("f_"), F.explode("found").alias("c")).select("f_", "c.h").join(wrong, "h", "left_semi").groupBy("f_").agg(F.collect_set("h").alias("bad"))
        x = x.join(bad, F.col("found") == F.col("f_"), "left").drop("f_")
        gone = F.filter("found", lambda c: c["gone"] & ~F.coalesce(F.array_contains("bad", c["h"]), F.lit(False)))
    x = x.withColumn("gone_chunks", F.coalesce(gone, none("struct<no:int,h:bigint,gone:boolean>")))
    numbers = F.flatten(F.transform("gone_chunks", lambda c: F.sequence(c["no"], F.least(c["no"] + (SPAN - 1), F.size("pieces") - 1))))
    x = x.withColumn("gone_pieces", F.sort_array(F.array_distinct(numbers)))
    return x.withColumn("left", F.when(F.col("pieces").isNotNull(), _without(F.col("pieces"), F.col("gone_pieces"))))


def clean(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """docs with `text` cleaned, and two columns behind: n_removed_chars, n_removed_chunks (with _ behind them where docs has these names)."""
    names = docs.columns
    x = _cleaned(_cut(docs, least))
    at = names.index("text")
    text = F.col(f"c{at}")
    lost = F.when(F.col("left").isNull(), 0).otherwise(F.length(F.array_join("pieces", "")) - F.length("left"))
    out = [F.coalesce("left", text) if i == at else F.col(f"c{i}") for i in range(len(names))]
    return x.select(*out, lost, F.size("gone_chunks")).toDF(*names, *[common.spare_name(names, n) for n in ("n_removed_chars", "n_removed_chunks")])


def report(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """A row per document: doc_id, n_removed_chars, n_removed_chunks, n_chars (left), text_sha256 (of what is left)."""
    sha = lambda t: F.sha2(F.encode(F.coalesce(t, F.lit("")), "UTF-8"), 256)
    whole = lambda t: {"n": F.coalesce(F.length(t), F.lit(0)), "s": F.when(F.col("found").isNull(), sha(t))}
    x = _cleaned(_cut(docs.select("doc_id", "text"), least, whole))
    left = F.coalesce(F.length("left"), F.col("n"))
    return x.select(F.col("c0").alias("doc_id"), (F.col("n") - left).cast("long").alias("n_removed_chars"), F.size("gone_chunks").cast("long").alias("n_removed_chunks"), left.cast("long").alias("n_chars"), F.coalesce("s", sha(F.col("left"))).alias("text_sha256"))
