import zlib

import numpy as np

from scenequery.llm import quality as Q


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_interaction_is_learnt():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.fit_arrays(x[:3000], y[:3000])
    assert auc(m.score(x[3000:]), y[3000:]) > 0.97


def test_held_out_accuracy(spark):
    from scenequery.llm.queries import op6_quality_gam

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op6_quality_gam(spark, sf).collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    y = np.array([r.quality for r in labels])
    assert auc(np.array([got[r.doc_id].score for r in labels]), y) > 0.95
    right = np.array([got[r.doc_id].predicted for r in labels]) == y
    assert right.mean() > 0.93 and right[y == 1].mean() > 0.97


DOCS = "doc_id long, text string, score double, y int"


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Good words here."), (3, "Good words here."), (None, "| | ###"), (5, "w " * 100_000)]
    docs = spark.createDataFrame([(i, t, 7.0, 1) for i, t in rows], DOCS)
    labels = lambda xs: spark.createDataFrame(xs, "doc_id long, quality int, toxic int")
    for xs in ([], [(1, 1, 0), (3, 1, None)], [(1, 0, 0), (3, 1, 0), (3, 0, 0), (2, None, 0), (None, 1, 1), (77, 1, 1)]):
        got = Q.report(docs, labels(xs)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert {r.score for r in Q.report(docs, labels([])).collect()} == {0.5}
    assert Q.report(docs.limit(0), labels([(1, 1, 0)])).collect() == []
    kept = Q.keep(docs, labels([]))
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_scores_by_hand(spark, sf):
    """Every score is the logistic of the base and the table entries of the text's bins, looked up one by one here."""
    import math

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = Q.fit(docs, labels)
    got = {r.doc_id: r.score for r in Q.report(docs, labels).collect()}
    for r in docs.select("doc_id", "text").collect():
        x = Q.features_of((r.text or "").encode())
        b = [sum(e <= v for e in edges) for v, edges in zip(x, m.edges)]
        z = m.base + sum(t[k] for t, k in zip(m.tables, b)) + sum(t[b[i], b[j]] for i, j, t in m.pairs)
        assert got[r.doc_id] == 1 / (1 + math.exp(-z)) or abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-12
