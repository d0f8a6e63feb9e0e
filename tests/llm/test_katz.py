import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from scenequery.llm import katz as K


def tokens(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w] + [None]


class Brute:
    def __init__(self, docs, order=3):
        train = [tokens(t) for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
        self.order = order
        self.count = {m: Counter((h, w) for d in train for h, w in self.grams(d, m)) for m in range(1, order + 1)}
        self.uni = Counter({w: c for (_, w), c in self.count[1].items()})
        self.n = sum(self.uni.values())
        self.d = {m: self.discount(c) for m, c in self.count.items()}
        mass = sum(self.d[1][min(c, 6)] * c for c in self.uni.values())
        self.over = self.n + (mass >= self.n * (1 - 1e-12))
        self.unseen = 1 - mass / self.over if self.n else 1.0
        self.after = {}
        for m in range(2, order + 1):
            for h, w in self.count[m]:
                self.after.setdefault(h, []).append(w)
        self.memo = {}

    @staticmethod
    def grams(d, m):
        d = ["<s>"] * (m - 1) + d
        return [(tuple(d[i - m + 1 : i]), d[i]) for i in range(m - 1, len(d))]

    @staticmethod
    def discount(counts):
        n = Counter(counts.values())
        out = [1.0] * 7
        a = 6 * n[6] / n[1] if n[1] else 1.0
        for r in range(1, 6):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 0
            out[r] = d if 0 < d < 1 else r / (r + 1)
        return out

    def back(self, h):
        if h not in self.memo:
            c, d = self.count[len(h) + 1], self.d[len(h) + 1]
            total = sum(c[h, w] for w in self.after[h])
            mass = sum(d[min(c[h, w], 6)] * c[h, w] for w in self.after[h])
            over = total + (mass >= total * (1 - 1e-12))
            self.memo[h] = over, (1 - mass / over) / (1 - sum(self.p(h[1:], w) for w in self.after[h]))
        return self.memo[h]

    def p(self, h, w):
        if not h:
            c = self.uni[w]
            return self.d[1][min(c, 6)] * c / self.over if c else self.unseen
        if h not in self.after:
            return self.p(h[1:], w)
        over, alpha = self.back(h)
        c = self.count[len(h) + 1][h, w]
        return self.d[len(h) + 1][min(c, 6)] * c / over if c else alpha * self.p(h[1:], w)

    def row(self, i, t):
        w = tokens(t)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        base = sum(math.log10((self.uni[x] + 1) / (self.n + len(self.uni) + 1)) for x in w)
        return (i, held, len(w), sum(self.uni[x] > 0 for x in w), self.n, base, sum(math.log10(self.p(h, x)) for h, x in self.grams(w, self.order)))


def check(spark, docs, order=3):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, block int, word string")
    got = sorted(map(tuple, K.report(df, order).collect()), key=repr)
    b = Brute(docs, order)
    want = sorted((b.row(i, t) for i, t in docs), key=repr)
    assert len(got) == len(want)
    for x, y in zip(sorted(got, key=lambda r: repr(r[:5]) + f"{r[6]:.6f}"), sorted(want, key=lambda r: repr(r[:5]) + f"{r[6]:.6f}")):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9, abs=1e-9)
    return b, got


def corpus(seed, n):
    """Texts whose words depend on the word before."""
    r, out = random.Random(seed), []
    for i in range(n):
        at, words = 0, []
        for _ in range(r.randint(0, 60)):
            at = (at * 37 + r.choice([1, 1, 1, 2, 2, 3, 9, r.randrange(300)])) % 300
            words.append(f"w{at}" + r.choice([""] * 9 + ["É", "X"]))
        out.append((i, " ".join(words)))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_TOKENS", 500)
    docs = corpus(1, 400)
    b, got = check(spark, docs)
    for h in [("<s>",), ("<s>", "<s>"), ("w1",), ("w250É",), ("w2X", "w1"), *list(b.after)[:50], *list(b.after)[-50:]]:
        assert sum(b.p(h, w) for w in b.uni) + b.p(h, "never seen") == pytest.approx(1, abs=1e-9)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than the base


@pytest.mark.parametrize("order", [1, 2, 4])
def test_other_orders(spark, order):
    check(spark, corpus(2, 60), order)


def test_hot_histories(spark, monkeypatch):
    """Histories dealt out by word, several buckets and blocks."""
    for name, value in (("HOT", 8), ("HOTTEST", 10**9), ("BLOCK_TOKENS", 300), ("BUCKET_TOKENS", 900)):
        monkeypatch.setattr(K, name, value)
    check(spark, corpus(3, 300) + [(1000 + i, "the hot one of all") for i in range(40)])


@pytest.mark.parametrize("size", [10**6, 300])
def test_tables(spark, monkeypatch, size):
    """The stored n-grams, read back as rows, are those of the corpus."""
    monkeypatch.setattr(K, "BLOCK_TOKENS", size)
    docs = corpus(4, 80)
    model, b = K.Model(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)), Brute(docs)
    names = {None: "<s>"}
    for w in {x for _, t in docs for x in tokens(t)}:
        h = K.END if w is None else K.word_hashes([w.encode()])[0][0]
        names[int(np.uint64(h).astype(np.int64))] = w
    for m in (1, 2, 3):
        got = [(tuple(names[w] for w in r.words), r.n) for r in model.ngrams(m).collect()]
        assert len(got) == len(dict(got)) and dict(got) == {(*h, w): n for (h, w), n in b.count[m].items()}


def test_structured_words_differ(spark):
    from .test_minhash import thue_morse

    x, y = thue_morse(1024)
    train = next(i for i in range(99) if K.is_training(i))
    held = next(i for i in range(99) if not K.is_training(i))
    _, got = check(spark, [(train, f"one two three four {y}"), (held, f"one two three four {x}")])
    assert {r[0]: r[3] for r in got} == {train: 6, held: 5}


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (None, "a a b"), (3, "A\tb\x0bC"), (3, "A\tb\x0bC"), (4, "long " * 100_000), (5, "é")])
    assert K.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(99) if not K.is_training(i))
    assert [tuple(r)[4:] for r in K.report(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()] == [(0, 0.0, 0.0)]


def test_packing():
    x = np.array([0, 5, 2**40, 2**63 + 7, 2**64 - 1], np.uint64)
    assert (K.unpack_keys(K.pack_keys(x)) == x).all() and (K.unpack(K.pack(x)) == x).all()
    y = np.array([0.0, -1.5, 1e-300, math.pi])
    assert (K.unpack_reals(K.pack_reals(y)) == y).all() and len(K.unpack(K.pack(x[:0]))) == 0


def test_whole_table(spark, sf):
    from scenequery.llm.queries import op2_katz

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    b = Brute(docs)
    got = {r.doc_id: tuple(r) for r in op2_katz(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        want = b.row(i, t)
        assert got[i][:5] == want[:5] and got[i][5:] == pytest.approx(want[5:], rel=1e-9)
