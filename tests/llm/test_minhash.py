import random

import numpy as np
import pytest

from scenequery.llm import minhash as M

DOCS = "doc_id long, text string, v string, n int"


def brute(docs):
    sets = [M.shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    post = {}
    for i, s in enumerate(sets):
        for x in s:
            post.setdefault(x, []).append(i)
    seen = set()
    for ids in post.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    out = []
    for i, (d, _) in enumerate(docs):
        c = least.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def check(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    got = sorted((tuple(r) for r in M.report(df).collect()), key=repr)
    assert got == brute(docs)
    return df


def variants(r, n, length, edits):
    base = [f"w{r.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(length)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "SHORT_LIST", 12)
    r = random.Random(1)
    texts = variants(r, 60, 150, 9) + variants(r, 40, 400, 24) + variants(r, 30, 12, 1) + variants(r, 20, 6, 1) + [" ".join(variants(r, 1, 40, 0) + ["the hot line that stands in all of them"] * 1) for _ in range(40)]
    hot = variants(r, 1, 100, 0)[0]
    texts += [hot + " " + " ".join(f"y{r.randrange(10**6)}" for _ in range(r.choice([10, 20, 30, 60]))) for _ in range(60)]
    texts += texts[::7]
    r.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_long_lists_of_half_alike_members(spark, monkeypatch):
    """Several groups meet, several blocks of links, several column parts."""
    for name, value in (("SHORT_LIST", 4), ("GROUP", 8), ("MOST_SHINGLES", 2000), ("COLUMNS", 16), ("BLOCK", 20)):
        monkeypatch.setattr(M, name, value)
    r = random.Random(2)
    texts = variants(r, 60, 120, 14) + variants(r, 30, 90, 5)
    r.shuffle(texts)
    check(spark, list(enumerate(texts)))


@pytest.mark.parametrize("columns", [1, 7, 4096])
def test_common_counts(monkeypatch, columns):
    monkeypatch.setattr(M, "COLUMNS", columns)
    r = random.Random(3)
    left, right = ([np.array(sorted(r.sample(range(40), r.randint(0, 30))), np.uint64) for _ in range(n)] for n in (5, 9))
    assert M.common_counts(left, right).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in right] for x in left]


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "one"), (None, "one two"), (7, "É a b c d"), (8, "é a b c d"), (7, "q r s t u v"), (9, "É a b c d"), (10, "long " + "w x y z q " * 30_000), (11, "w x y z q " * 30_000)]
    df = check(spark, docs)
    assert M.keep(df).columns == df.columns
    check(spark, [])
    check(spark, [(None, "a b c d")])


def test_whole_table(spark, sf):
    from scenequery.llm.queries import op9_near_duplicates

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op9_near_duplicates(spark, sf).collect()), key=repr) == brute(docs)


@pytest.mark.parametrize("text", ["", "a", "a b c", "A b\tc\nd e", "é é é é é é"])
def test_sets(text):
    assert len(M.sets_of([text.encode()])[0]) == len(M.shingles(text))
    assert all(np.array_equal(a, b) for a, b in zip(M.sets_of([text.encode(), b"", text.upper().encode() if text.isascii() else text.encode()])[::2], M.sets_of([text.encode()] * 2)))


def thue_morse(n):
    """Words that collide under polynomial hashes modulo a power of two."""
    x, y = "a", "b"
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("n", [8, 32, 64, 128, 1024])
def test_structured_words_differ(spark, n):
    x, y = thue_morse(n)
    h, _ = M.word_hashes([f"{x} {y}".encode()])
    assert h[0] != h[1]
    check(spark, [(1, f"one two three {x}"), (2, f"one two three {y}"), (3, f"one two three {x.upper()}")])


def test_word_hashes_know_words_only():
    words = ["a", "b", "ab", "ba", "abcdefgh", "abcdefghi", "x" * 63, "x" * 64, "x" * 65, "x" * 70_000, "é", "éa"]
    alone = [M.word_hashes([w.encode()])[0][0] for w in words]
    assert len(set(alone)) == len(words)
    h, at = M.word_hashes([b"", " ".join(words).encode(), b" \t", "\n".join(reversed(words)).encode()])
    assert h[: len(words)].tolist() == alone and h[len(words) :].tolist() == alone[::-1]
    assert at.tolist() == [0, 0, len(words), len(words), 2 * len(words)]


def test_hot_keys_are_spread(spark, monkeypatch):
    from scenequery.llm import common

    monkeypatch.setattr(common, "COLD_ROWS", 3)
    rows = common.materialise(spark.range(100).selectExpr("id % 7 * (id % 2) AS k", "id"), "rows")
    one = spark.range(7).selectExpr("id AS k", "id * 10 AS ten").filter("k != 5")
    got = common.spread_join(rows, one, "k").select("k", "id", "ten")
    assert sorted(map(tuple, got.collect())) == sorted((r.k, r.id, r.k * 10) for r in rows.collect() if r.k != 5)


def test_hot_lists(spark, monkeypatch):
    from scenequery.llm import common

    monkeypatch.setattr(common, "COLD_ROWS", 4)
    test_long_lists_of_half_alike_members(spark, monkeypatch)


def test_hot_counted_keys_are_spread(spark, monkeypatch):
    from scenequery.llm import common

    monkeypatch.setattr(common, "COLD_ROWS", 3)
    rows = spark.range(100).selectExpr("id % 7 * (id % 2) AS k", "id")
    counted = common.materialise(rows.filter("k != 5").groupBy("k").count(), "counted")
    got = common.spread_join_sized(rows, counted, "k", "count")
    n = {r.k: r["count"] for r in counted.collect()}
    assert sorted(map(tuple, got.collect())) == sorted((r.k, r.id, n[r.k]) for r in rows.collect() if r.k != 5)
