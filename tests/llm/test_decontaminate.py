import random

from scenequery.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string, hit_items string, word int", "item_id long, text string, text2 string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], ITEMS)
    got = rows(D.report(d, b, **kw))
    assert got == sorted(D.brute(docs, [("null" if i is None else i, t) for i, t in items]), key=repr)
    return got


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(1)
    word = lambda: r.choice(["a", "Bb", "c1", "é", "dd", "e"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 3, 9, 10, 11, 15])))) for i in range(12)]
    docs = [(i, " ,".join(word() for _ in range(r.randint(0, 60)))) for i in range(60)]
    docs += [(100 + i, "x-y " + t + " z! " + t) for i, t in items]
    check(spark, docs, items)
    monkeypatch.setattr(D, "BITS", 1 << 16)
    monkeypatch.setattr(D, "bitmap", lambda x: D.np.full(8, 255, D.np.uint8))  # a full bitmap lets all through
    check(spark, docs, items)


def test_odd_rows(spark):
    items = [(1, "one two"), (1, "one two"), (None, "three"), (3, None), (4, ""), (10, "..."), (2, "one")]
    docs = [(1, None), (2, ""), (3, "ONE  two;three"), (3, "ONE  two;three"), (None, "two one"), (5, "w " * 200_000 + "one")]
    got = check(spark, docs, items)
    assert sum(r[5] for r in got) == 4
    check(spark, docs, [])
    check(spark, [], items)


def test_clean_keeps_columns(spark):
    d = spark.createDataFrame([(1, "a b", "k"), (2, "z", "k")], "doc_id long, text string, hit_spans string")
    got = D.clean(d, spark.createDataFrame([(1, "b")], "item_id long, text string"))
    assert got.columns == d.columns and [r.doc_id for r in got.collect()] == [2]


def test_whole_table(spark, sf):
    from scenequery.llm.queries import op10_decontaminate

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(op10_decontaminate(spark, sf)) == sorted(D.brute(docs, items), key=repr)
