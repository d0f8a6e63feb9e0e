import hashlib
import random
import re
import time
from pathlib import Path

import pytest

from scenequery.llm import common
from scenequery.llm import line_chunks as L

from .sparkhash import xx

DOCS = "doc_id long, text string, n_removed_chars string, d int, found int, c0 string"


def pieces_of(t):
    lines = re.split("|".join(f"(?<={e})" for e in L.ENDS), t)
    bounds = [i + 1 for i, x in enumerate(lines) if i == len(lines) - 1 or (i and xx(x, lines[i - 1]) % L.DIVISOR == 0)]
    return ["".join(lines[a:b]) for a, b in zip([0, *bounds], bounds)]


def chunks_of(t):
    p = pieces_of(t)
    return [(no, p[no : no + L.SPAN]) for no in range(max(1, len(p) - L.SPAN + 1))]


def brute(docs, least=L.MIN_CHARS):
    key = lambda i: L.NULL_ID if i is None else i
    first = {}
    for i, t in docs:
        for _, c in chunks_of(t) if t is not None else []:
            first[tuple(c)] = min(first.get(tuple(c), key(i)), key(i))
    out = []
    for i, t in docs:
        if t is None:
            out.append((i, 0, 0, 0, hashlib.sha256(b"").hexdigest()))
            continue
        p, gone, n, seen = pieces_of(t), set(), 0, set()
        for no, c in chunks_of(t):
            if len("".join(c)) >= least and (first[tuple(c)] != key(i) or tuple(c) in seen):
                gone.update(range(no, no + len(c)))
                n += 1
            seen.add(tuple(c))
        left = "".join(x for k, x in enumerate(p) if k not in gone)
        out.append((i, len(t) - len(left), n, len(left), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in docs], DOCS)
    got = sorted((tuple(r) for r in L.report(df, **kw).collect()), key=repr)
    assert got == brute(docs, **kw)
    return df, {r[0]: r for r in got}


def passage(r, n):
    return " ".join(" ".join(r.choice("alpha beta gamma delta of the".split()) for _ in range(9)).capitalize() + "." for _ in range(n)) + "\n"


def words(r, n):
    return " ".join("".join(r.choice("aeinorstdl") for _ in range(6)) + r.choice(["", "", "", "", "", "", "", "."]) for _ in range(n))


def test_against_brute_force(spark):
    r = random.Random(2)
    shared = [passage(r, 8) for _ in range(3)]
    docs = []
    for i in range(200):
        parts = [passage(r, r.randint(1, 6)) for _ in range(r.randint(0, 4))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        docs.append((i, "".join(parts)))
    _, got = check(spark, docs)
    assert sum(x[2] > 0 for x in got.values()) > 60


def test_planted_passages(spark):
    """Passages of 51 to 150 words in the middle of other texts go, but for their ends; the rest stays."""
    r = random.Random(3)
    docs, sizes = [], []
    for k in range(200):
        n = r.randint(51, 150)
        p = words(r, n) if k % 3 else re.sub(r"\.", "", words(r, n))
        docs += [(i, words(r, r.randint(5, 90)) + " " + p + " " + words(r, r.randint(5, 90))) for i in (k, 1000 + k)]
        sizes.append(len(p))
    docs += [(5000 + k, words(r, 200)) for k in range(100)]
    _, got = check(spark, docs)
    assert all(got[k][1] == 0 for k in got if not 1000 <= k < 5000)
    gone = [got[1000 + k][1] / n for k, n in enumerate(sizes)]
    assert max(gone) <= 1 and sum(gone) / len(gone) > 0.65 and sum(x > 0 for x in gone) >= 0.96 * len(gone)


def test_hot_chunks(spark, monkeypatch):
    monkeypatch.setattr(common, "COLD_ROWS", 3)
    r = random.Random(5)
    hot = words(r, 70)
    check(spark, [(i, words(r, 20) + " " + hot + " " + words(r, 20)) for i in range(40)] + [(100 + i, words(r, 60)) for i in range(10)] * 2)


def test_wrong_hashes_are_found_out(spark, monkeypatch):
    """With hashes of few values, chunks and pieces that only look alike stay."""
    few = L.F.xxhash64
    r = random.Random(7)
    p = words(r, 80)
    docs = [(i, words(r, 60)) for i in range(20)] + [(50, p), (51, p)]
    monkeypatch.setattr(L.F, "xxhash64", lambda *c: L.F.pmod(few(*c), L.F.lit(64)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.text for x in L.clean(df).collect()}
    assert all(got[i] == t for i, t in docs[:21])


def test_odd_rows(spark):
    r = random.Random(4)
    p = passage(r, 10)
    docs = [(1, None), (2, ""), (3, "\n\n\n"), (None, p), (4, p), (4, p), (4, p + "x"), (5, p + p), (6, "é🙂. " * 50), (7, "no end"), (8, "line\n" * 20_000), (9, passage(r, 3000)), (10, "short text that stands twice, with more than sixty characters"), (11, "short text that stands twice, with more than sixty characters"), (12, p + "\x01"), (13, "\x01" + p)]
    df, got = check(spark, docs)
    assert got[11][3] == 0 and got[10][3] > 0
    out = L.clean(df)
    assert out.columns == [*df.columns, "n_removed_chars_", "n_removed_chunks"] and len(out.collect()) == len(docs)
    assert {(x.doc_id, hashlib.sha256((x.text or "").encode()).hexdigest()) for x in out.collect()} == {(x[0], x[4]) for x in brute(docs)}
    check(spark, [])
    check(spark, docs, least=10)


def test_whole_table(spark, sf):
    from scenequery.llm.queries import op7_line_chunks

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op7_line_chunks(spark, sf).collect()), key=repr) == brute(docs)


def test_pieces_are_kept_small_on_disk(spark, tmp_path):
    """The table of pieces, the largest one that stays, takes no more than two thirds of what the session's codec makes of it."""
    r = random.Random(8)
    p = [passage(r, 40) for _ in range(40)]
    docs = [(i, words(r, 300) + p[i % 40] + words(r, 300)) for i in range(400)]
    x = L._cut(spark.createDataFrame(docs, "doc_id long, text string"), L.MIN_CHARS)
    x.write.parquet(f"{tmp_path}/x")
    size = lambda d: sum(f.stat().st_size for f in d.glob("*.parquet"))
    kept = {Path(f.removeprefix("file://")).parent for f in x.inputFiles()}
    assert len(kept) == 1 and size(kept.pop()) < 2 / 3 * size(tmp_path / "x")


def test_shuffled_files_go_with_their_step(spark, sf):
    """Of what the steps shuffle, at most the last one's files are left when op7's table is ready to be read."""

    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_") and files.apply(i).getName().endswith(".data")}

    docs, before = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), shuffles()
    L._cut(docs, L.MIN_CHARS).count()
    for _ in range(50):
        if len(shuffles() - before) <= 16:
            break
        time.sleep(0.2)
    # the files of two counts' exchanges may be there, those of hashes, chunks, marks and texts not
    left = {f.split("_")[1] for f in shuffles() - before}
    assert len(left) <= 2 and spark.conf.get(common.CLEAN) == "false"


@pytest.mark.parametrize("text", ["", "a", "a\nb", " x  y \n\n"])
def test_pieces_join_to_the_text(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(L.pieces_of(L.F.col("t"))).first()[0]
    assert "".join(row) == text and row == pieces_of(text)
