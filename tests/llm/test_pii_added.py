"""Personal data that no base pattern matches is added; the base spans and clean texts stay."""

import random
import re

from scenequery.llm import pii as P

from .test_pii import check, luhn


def test_masked_cases_are_added(spark):
    r = random.Random(8)
    card = lambda: next(n + str(d) for n in [str(r.randrange(10**14, 10**15))] for d in range(10) if luhn(n + str(d)))
    wrong = lambda: (lambda n: n[:-1] + str((int(n[-1]) + 1) % 10))(card())
    groups = lambda n, mark: mark.join(re.findall("....", n))
    texts, planted = [], []
    for i in range(200):
        for t, kind in [
            (f"write to ann{i} (at) host{i} (dot) org now", "email"),
            (f"my card is {groups(card(), '/')} here", "card"),
            (f"please call 030 {r.randrange(10**3, 10**4)} {r.randrange(10**3, 10**4)} today", "phone"),
            (f"mail a{i}@b{i}.com and card {groups(card(), '-')} or phone +49 30 {r.randrange(10**7, 10**8)} at 10.2.{i}.4", None),
            (f"order {groups(wrong(), '/')} of item {r.randrange(10**11, 10**12)} we met (at) noon", None),
        ]:
            if kind:
                planted.append((len(texts), kind))
            texts.append(t)
    got = check(spark, texts)
    found = {k: [any(x.startswith(k) for x in (got[i].spans or "").split(",")) for i, kind in planted if kind == k] for k in ("email", "card", "phone")}
    assert {k: sum(v) for k, v in found.items()} == {k: 200 for k in found}
    assert sum(got[i].n_added for i in range(4, len(texts), 5)) <= 10


def test_overlaps_among_many(spark):
    """Proposals that meet a taken span, or an earlier proposal, go; by pairs here."""
    F, r = P.F, random.Random(9)
    span = lambda n: sorted((s, s + r.randint(1, n)) for s in (r.randrange(400) for _ in range(60)))
    rows = [(span(9), span(12)) for _ in range(20)] + [([], span(5)), (span(5), [])]
    df = spark.createDataFrame(rows, "a array<struct<s:bigint,e:bigint>>, taken array<struct<s:bigint,e:bigint>>")
    for (a, taken), got in zip(rows, df.select(P._ends_before(F.col("a"), F.col("taken"))).collect()):
        assert got[0] == [max([e for s, e in taken if s < c[1]], default=-1) for c in a]


def test_dense_numbers(spark):
    """Texts full of proposals take time in proportion to their length."""
    r = random.Random(10)
    texts = [" ".join(str(r.randrange(10**12, 10**13)) for _ in range(4000)), "a@b.cc " * 3000 + "1.2.3.4 " * 3000]
    check(spark, texts, {k: ([0.0], -1.0) for k in P.KINDS})
