import hashlib
import random

from pyspark.sql import functions as F

from scenequery.llm import syncmers as S

from .sparkhash import xx


def words_of(t):
    return [w for w in (t or "").replace("\n", " ").split(" ") if w]


def anchors(t, k=S.K, s=S.S):
    h = [xx(w) for w in words_of(t)]
    if not h:
        return []
    if len(h) < k:
        v = 0
        for x in h:
            v = xx(v, x)
        return [(0, v)]
    inner = [xx(*h[i : i + s]) for i in range(len(h) - s + 1)]
    out = []
    for i in range(len(h) - k + 1):
        w = inner[i : i + k - s + 1]
        if min(w[0], w[-1]) == min(w):
            out.append((i, xx(*w[::s], *([w[-1]] if (len(w) - 1) % s else []))))
    return out


def near(a, b):
    a, b = (set(x) for x in (a, b))
    if not a and not b:
        return 1.0
    u = sorted(a | b)[: max(S.SKETCH, min(len(a), len(b)))]
    return len([x for x in u if x in a and x in b]) / len(u)


def brute(docs):
    def sketch(t):
        h = sorted({h for _, h in anchors(t)})
        return h[: max(S.SKETCH, -(-len(h) // S.PART))]

    text = lambda x: "".join(f"{h % (1 << 64):016x}" for h in x)
    ids = sorted({i for i, _ in docs}, key=lambda i: (i is not None, i or 0), reverse=True)
    after = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    stands = {i: min(t or "" for j, t in docs if j == i) for i in ids}
    longest = {i: max(len(t or "") for j, t in docs if j == i) for i in ids}  # noqa: F841
    out = []
    for i, t in docs:
        t, n = t or "", stands[after[i]]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b = sketch(t), sketch(e)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), text(a), text(b), near(a, b), near(a, sketch(n))))
    return sorted(out, key=repr)


def check(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, next_id string, n int")
    got = sorted((tuple(r) for r in S.report(df).collect()), key=repr)
    assert got == brute(docs)


def text(r, n):
    return "".join(r.choice(["a", "bb", "ccc", "é", "🙂", "dd", "e1", "f"]) + r.choice([" ", "\n", "  "]) for _ in range(n))


def test_against_brute_force(spark):
    r = random.Random(1)
    check(spark, [(i * 3, text(r, r.choice([0, 1, 4, 5, 6, 50, 300]))) for i in r.sample(range(1000), 80)])


def test_odd_rows(spark):
    r = random.Random(2)
    check(spark, [(1, None), (2, ""), (2, "a b"), (2, "a b"), (None, text(r, 90)), (7, text(r, 20_000)), (9, text(r, 60))])
    check(spark, [(5, "only one of them")])
    check(spark, [(None, "x y")])
    check(spark, [])


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 7)
    r = random.Random(3)
    check(spark, [(i, text(r, 8)) for i in [*range(50), *range(10**9, 10**9 + 30), -5, 10**15]])


def test_anchors_and_positions(spark):
    r = random.Random(4)
    p = " ".join(f"w{r.randrange(10**6)}" for _ in range(80))
    a, b = "x y z " + p + " end", "q " + p
    row = spark.createDataFrame([(a, b)], "a string, b string").select(S.anchors(F.col("a")).alias("x"), S.anchors(F.col("b")).alias("y"))
    row = row.select("*", S.shared_anchors(F.col("x"), F.col("y")).alias("m")).first()
    assert [tuple(x) for x in row.x] == anchors(a) and len(row.m) > 30
    assert {m.pos_a - m.pos_b for m in row.m} == {2}


def test_whole_table(spark, sf):
    from scenequery.llm.queries import op5_syncmers

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op5_syncmers(spark, sf).collect()), key=repr) == brute(docs)


def test_likeness_of_long_texts(spark):
    """A text of 20,000 words against one that shares a given part of it: the likeness tells the share."""
    r = random.Random(6)
    w = [f"w{r.randrange(10**7)}" for _ in range(20_000)]
    for share in (0.02, 0.3, 0.9):
        n = int(share * len(w))
        other = w[:n] + [f"v{r.randrange(10**7)}" for _ in range(len(w) - n)]
        got = spark.createDataFrame([(" ".join(w), " ".join(other))], "a string, b string").select(S.likeness(S.sketch(F.col("a")), S.sketch(F.col("b")))).first()[0]
        assert abs(got - share / (2 - share)) < 0.03 and got > 0
