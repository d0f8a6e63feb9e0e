import hashlib
import random
import re

from scenequery.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(m):
    d = [int(c) for c in m if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def passes(kind, m):
    n = sum(c.isdigit() for c in m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 14 <= n <= 19 and luhn(m), "phone": 10 <= n <= 15}[kind]


def expected(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def check(spark, texts, model=None):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, t int")
    got = {r.doc_id: r for r in P.report(df, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base, r = expected(t), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (t, base, r)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in P.KINDS]
        have = r.spans.split(",") if r.spans else []
        assert set(base) <= set(have) and len(have) == len(base) + r.n_added
        assert have == sorted(have, key=lambda x: (int(x.split(":")[1]), P.KINDS.index(x.split(":")[0])))
    return got


def test_odd_texts(spark):
    texts = [None, "", "a@b.com@c.org x@y z@@q.de _@a.b-c.d..e", "1.2.3.4.5 256.1.1.1 0255.0.0.1 1.2.3 9.9.9.9.9.9.9.9", "é🙂 4111 1111 1111 1111é4111-1111-1111-1112 41111111111111111111111", "4 4111111111111111 1  4111111111111111", "+1 (499) 555-6503. ++1234567890+ +1-2 +49(0)123.456.789-", "a@b.c" * 50, "5 " * 500 + "x@y.zz", "x" * 100_000 + "@", "1" * 50_000, "+1-2 " * 3000, "1-" * 40_000, "a.b" * 20_000]
    check(spark, texts, {})


def test_random_texts(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["1", "23", "4111111111111111", "@", ".", "-", " ", "a", "b.c", "+", "(", ")", "255", "é", "+12345"]) for _ in range(r.randint(0, 40))) for _ in range(500)]
    check(spark, texts, {})


def test_trees_find_more(spark):
    r = random.Random(5)
    with_check = lambda n: next(n + str(d) for d in range(10) if luhn(n + str(d)))
    texts = [f"w {with_check(str(r.randrange(10**14, 10**15)))} x {r.randrange(10**15, 10**16)}, ip {r.randrange(256)}.2.3.{r.randrange(400)} a{i}@b.com" for i in range(300)]
    texts += ["clean words only, no. 12"] * 50 + ["card " + "/".join(re.findall("....", with_check("411111111111111"))) + " end"] * 3
    got = check(spark, texts)
    assert all(got[i].n_added == 0 for i in range(300, 350))
    model = P.fit(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert "card" in model and "email" in model


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.report(empty).collect() == []
    df = spark.createDataFrame([(None, "a@b.cc"), (1, "a@b.cc"), (1, "a@b.cc")], "doc_id long, text string")
    assert [r.n_email for r in P.report(df).collect()] == [1, 1, 1]


def test_whole_table(spark, sf):
    from scenequery.llm.queries import op4_personal_data

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_personal_data(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(",".join(expected(texts[r.doc_id])).encode()).hexdigest()
