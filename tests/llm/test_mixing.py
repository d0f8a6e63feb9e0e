import random
import zlib

import pytest

from scenequery.llm import mixing as M

from .sparkhash import xx

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tokens int, slice int"


def docs_of(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        hot = r.random() < 0.4
        out.append((i, " ".join("w" for _ in range(r.randint(0, 30))), "en" if hot else r.choice(["en", "de", None]), "src0" if hot else f"src{r.randint(0, 9)}", 0, 1, 2))
    return out


def fill(nodes, budget):
    """Water filling by repeated sharing out; nodes: [(weight, capacity)]."""
    given, open_ = [0.0] * len(nodes), [i for i, (w, c) in enumerate(nodes) if w > 0 and c > 0]
    left = budget
    while open_ and left > 1e-9:
        total = sum(nodes[i][0] for i in open_)
        level = min([(nodes[i][1] - given[i]) / nodes[i][0] for i in open_] + [left / total])
        for i in open_:
            given[i] += level * nodes[i][0]
        left -= level * total
        open_ = [i for i in open_ if nodes[i][1] - given[i] > 1e-9]
    return given


def brute(docs, share=M.SHARE, epochs=M.MAX_EPOCHS, alpha=M.ALPHA, weights=None, seed=M.SEED):
    rows = []
    for d in docs:
        src = d[3] or ""
        rows.append((d[0], (f"domain{zlib.crc32(src.encode()) % M.N_DOMAINS}", d[2] or "", src), len([w for w in (d[1] or "").replace("\n", " ").split(" ") if w])))
    leaves = {}
    for _, k, n in rows:
        leaves[k] = leaves.get(k, 0) + n

    def down(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: int(budget + 1e-6)}
        kids = sorted({k[: depth + 1] for k in leaves if k[:depth] == prefix})
        tokens = [sum(n for k, n in leaves.items() if k[: depth + 1] == kid) for kid in kids]
        w = [(weights or {}).get(M.LEVELS[depth], {}).get(kid[-1], t**alpha) for kid, t in zip(kids, tokens)]
        out = {}
        for kid, g in zip(kids, fill([(a, t * epochs) for a, t in zip(w, tokens)], budget)):
            out |= down(kid, g)
        return out

    budget = down((), min(share, epochs) * sum(leaves.values()))
    got = []
    for k, total in leaves.items():
        full = budget[k] // total if total else 0
        rest = budget[k] - full * total if total else 0
        mine = sorted(((xx(("i", seed), ("i", full), i) % (1 << 64), i, n) for i, kk, n in rows if kk == k))
        for _, i, n in mine:
            part = min(n, max(rest, 0))
            rest -= n
            got.append((i, *k, n, full, part, full * n + part))
    return sorted(got), budget


@pytest.mark.parametrize("kw", [{}, {"share": 2.5}, {"share": 9}, {"weights": {"lang": {"de": 1000.0, "en": 0.0}, "domain": {"domain1": 50.0}}}])
def test_against_brute_force(spark, kw):
    docs = docs_of(600)
    got = sorted(tuple(r) for r in M.report(spark.createDataFrame(docs, DOCS), **kw).collect())
    want, budget = brute(docs, **{k: v for k, v in kw.items()})
    taken = {}
    for r in got:
        taken[r[1:4]] = taken.get(r[1:4], 0) + r[7]
    assert max(abs(taken[k] - budget[k]) for k in budget) <= 1
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 2 * len(budget)  # a token more or less at a leaf's cut


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    equal = {level: {k: 1.0 for k in "abxy1234"} for level in M.LEVELS}
    got = {r.source: r.budget for r in M.budgets(leaves, total=800, max_epochs=1, weights=equal).collect()}
    assert got == {"1": 10, "2": 190, "3": 200, "4": 400}


def test_odd_tables(spark):
    assert M.report(spark.createDataFrame([], DOCS)).collect() == []
    docs = [(None, None, None, None, 0, 1, 2), (1, "", "en", "s", 0, 1, 2), (2, "a b", "en", "s", 0, 1, 2), (2, "a b", "en", "s", 0, 1, 2), (3, "w " * 100_000, "en", "t", 0, 1, 2)]
    df = spark.createDataFrame(docs, DOCS)
    got = M.report(df).collect()
    assert len(got) == 5 and len({tuple(r) for r in got if r.doc_id == 2}) == 1
    mixed = M.mix(df, share=3.0)
    assert mixed.columns == df.columns
    times = {r.doc_id: r.epochs + (r.prefix_tokens > 0) for r in M.report(df, share=3.0).collect() if r.doc_id != 2}
    have = [r.doc_id for r in mixed.collect()]
    assert all(have.count(k) == n for k, n in times.items())
