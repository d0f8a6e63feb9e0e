"""Personal data: base spans by rule, further spans by boosted trees.

Base spans are the leftmost non-overlapping matches of one pattern per kind
that pass its check.  The patterns below are written so that a failed start is
not tried again inside the same run; what they match is the same.

High-recall generators propose candidates per kind, which may overlap one
another and the base spans.  A candidate has small whole-number features of its
format (digits, separators, checks) and its context (neighbouring characters, hint words within
NEAR characters).  A candidate is positive if it is a base span of its kind, or
passes the kind's check once its separators and (at), (dot) are written plainly
(`LIKE`); a phone without + also needs a hint word before it.  All candidates of
all documents are counted per feature row, and boosted trees are fitted to those
counts on the driver (MAX_ROWS feature rows a kind at most, the most frequent
ones; documents whose crc32(doc_id) mod 5 is 0 are left out).  On all feature
rows of those, by margin in steps of 1 / STEPS, each kind gets the lowest
threshold at which PRECISION of the weight is positive.  Candidates at or above
it that overlap no base span are added, leftmost first.

Scanning, features, tree scoring and selection are DataFrame functions.

Defined results: a null text has no spans; a kind without positive held-out
candidates adds none; rows with equal doc_id are handled each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequery.llm.common import crc_mod, materialise
from scenequery.llm.hof import let, none, prefix_max, prefix_sums

KINDS = ("email", "ip", "card", "phone")
MAX_ROWS, TREES, DEPTH, RATE, RIDGE, PRECISION, FOLDS, NEAR = 20_000, 20, 3, 0.4, 1.0, 0.99, 5, 24
#: Thresholds are whole multiples of 1 / STEPS.
STEPS = 64

#: Base patterns: runs are possessive and start where a run starts (or where the last match ended).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Proposals, wider than the base patterns.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]{1,9}+(?:[.:][0-9]{1,9}+){3,7}+",
    "card": r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){11,}+",
    "phone": r"[+(]?(?<![0-9])[0-9](?:[ ()./-]{0,3}[0-9]){6,}+",
}
HINTS = {"email": "mail|contact|kontakt|correo", "ip": "ip|host|server|adres", "card": "card|visa|credit|karte|carte|tarjeta", "phone": "tel|phone|call|fax|anruf|mobil"}
#: The features of a candidate, in order; all are whole numbers below 32.
FEATURES = ("digits", "length", "ats", "dots", "spaces", "dashes", "brackets", "slashes", "plus", "luhn", "bytes_ok", "before", "after", "hint", "lines")


def digits_of(m: Column) -> Column:
    return F.translate(m, " ().+-/:", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the check sum; m holds digits, spaces and marks only."""
    value = lambda c, i: F.when(i % 2 == 0, c).when(c > 4, c * 2 - 9).otherwise(c * 2)
    digits = F.transform(F.filter(F.split(F.reverse(digits_of(m)), ""), lambda c: c.rlike("^[0-9]$")), lambda c: c.cast("int"))
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x) % 10 == 0


_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CHECK = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"),
    "card": lambda m: F.length(digits_of(m)).between(14, 19) & F.when(F.length(digits_of(m)) <= 19, luhn(m)).otherwise(False),
    "phone": lambda m: F.length(digits_of(m)).between(10, 15),
}
#: Whether a proposal, with the text before it, is personal data once written plainly.
LIKE = {
    "email": lambda m, left: m.rlike(r"^[A-Za-z0-9._%+-]+(?:@| ?(?:\(at\)|\[at\]) ?)[A-Za-z0-9-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]+)+$"),
    "ip": lambda m, left: CHECK["ip"](F.translate(m, ":", ".")),
    "card": lambda m, left: CHECK["card"](m),
    "phone": lambda m, left: CHECK["phone"](m) & (m.startswith("+") | left.rlike(HINTS["phone"])),
}
#: What a text must hold for a pattern to match.
NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike("[0-9]"), "card": lambda t: t.rlike("[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}
WIDE_NEEDS = {"email": lambda t: F.contains(t, F.lit("@")) | F.contains(t, F.lit("at)")) | F.contains(t, F.lit("at]")), "ip": NEEDS["ip"], "card": NEEDS["ip"], "phone": NEEDS["ip"]}

_SPAN = "struct<s:bigint,e:bigint,m:string>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: where the pattern matches, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)

    def place(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        return let(gaps, lambda g: let(prefix_sums(F.transform(m, lambda x, i: F.get(g, i) + F.length(x))), lambda b: F.transform(m, lambda x, i: F.struct((F.get(b, i) + F.get(g, i)).alias("s"), (F.get(b, i) + F.get(g, i) + F.length(x)).alias("e"), x.alias("m")))))

    return let(found, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(none(_SPAN)))


def base_spans(text: Column, kind: str) -> Column:
    return F.when(NEEDS[kind](text), F.filter(matches(text, BASE[kind]), lambda x: CHECK[kind](x["m"]))).otherwise(none(_SPAN))


def _left(text: Column, x: Column) -> Column:
    """The NEAR characters before x, in lower case."""
    return F.lower(F.substring(text, F.greatest(x["s"] - NEAR, F.lit(0)).cast("int") + 1, F.least(x["s"], F.lit(NEAR)).cast("int")))


def _features(text: Column, kind: str, x: Column) -> Column:
    count = lambda chars: F.length(x["m"]) - F.length(F.translate(x["m"], chars, ""))
    cap = lambda c: F.least(c, F.lit(31)).cast("int")
    left = _left(text, x)
    right = F.substring(text, x["e"].cast("int") + 1, F.lit(1))
    kind_of = lambda c: F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^\p{L}"), 3).otherwise(4)
    luhn_ok = F.when(F.length(digits_of(x["m"])) <= 31, luhn(x["m"]).cast("int")).otherwise(0) if kind in ("card", "phone") else F.lit(0)
    values = [
        cap(count("0123456789")), cap(F.length(x["m"])), cap(count("@")), cap(count(".")), cap(count(" ")), cap(count("-")), cap(count("()[]")), cap(count("/:")), cap(count("+")),
        luhn_ok, CHECK["ip"](x["m"]).cast("int"), kind_of(F.right(left, F.lit(1))), kind_of(right), left.rlike(HINTS[kind]).cast("int"), cap(count("\n")),
    ]
    return F.array(*[v.cast("int") for v in values])


_CANDIDATE = "struct<s:bigint,e:bigint,x:array<int>>"


def candidates(text: Column, kind: str, label: bool = False) -> Column:
    """array<struct<s, e, x>>: proposals and their features; with `label`, also y, whether LIKE holds."""
    more = lambda c: [F.coalesce(LIKE[kind](c["m"], _left(text, c)), F.lit(False)).alias("y")] if label else []
    made = F.transform(matches(text, WIDE[kind]), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), _features(text, kind, c).alias("x"), *more(c)))
    return F.when(WIDE_NEEDS[kind](text), made).otherwise(none(_CANDIDATE[:-1] + ",y:boolean>" if label else _CANDIDATE))


# Boosted trees over counted feature rows.


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A leaf value, or (feature, cut, below, at or above)."""
    best, at = g.sum() ** 2 / (h.sum() + RIDGE) + 1e-6, None
    for j in range(x.shape[1]) if depth else ():
        a, b = (np.cumsum(np.bincount(x[:, j], w, 33)) for w in (g, h))
        gain = a[:-1] ** 2 / (b[:-1] + RIDGE) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + RIDGE)
        if gain.max() > best:
            best, at = gain.max(), (j, int(gain.argmax()) + 1)
    if at is None:
        return float(RATE * g.sum() / (h.sum() + RIDGE))
    low = x[:, at[0]] < at[1]
    return (*at, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] < tree[1], _value(tree[2], x), _value(tree[3], x))


def fit_trees(x: np.ndarray, n: np.ndarray, pos: np.ndarray) -> list:
    """[base, tree, ...] for rows of features that occurred n times, pos of them positive."""
    model = [float(np.log((pos.sum() + 1) / (n.sum() - pos.sum() + 1)))]
    z = np.full(len(x), model[0])
    for _ in range(TREES if 0 < pos.sum() < n.sum() else 0):
        p = 1 / (1 + np.exp(-z))
        model.append(_grow(x, pos - n * p, n * p * (1 - p), DEPTH))
        z += _value(model[-1], x)
    return model


def margin(model: list, x: np.ndarray) -> np.ndarray:
    return sum((_value(t, x) for t in model[1:]), np.full(len(x), model[0]))


def threshold(z: np.ndarray, n: np.ndarray, pos: np.ndarray) -> float | None:
    """The lowest margin from which on upwards PRECISION of the weight is positive, and some is."""
    order = np.argsort(-z, kind="stable")
    z, n, pos = z[order], np.cumsum(n[order]), np.cumsum(pos[order])
    ok = [i for i in range(len(z)) if pos[i] > 0 and pos[i] >= PRECISION * n[i] and (i + 1 == len(z) or z[i + 1] < z[i])]
    return float(z[ok[-1]]) - 1e-9 if ok else None


def margin_column(model: list, x: Column) -> Column:
    def tree(t) -> Column:
        return F.when(F.get(x, t[0]) < t[1], tree(t[2])).otherwise(tree(t[3])) if isinstance(t, tuple) else F.lit(t)

    out = F.lit(model[0])
    for t in model[1:]:
        out = out + tree(t)
    return out


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def fit(docs: DataFrame) -> dict[str, tuple[list, float]]:
    """Per kind, its trees and its threshold; kinds that can't be calibrated are left out."""
    x = docs.select(F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held"), _text(docs).alias("t")).filter(F.col("t").rlike(r"[0-9@]|at[)\]]"))
    t = F.col("t")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), base_spans(t, k).alias("base"), candidates(t, k, True).alias("all")) for k in KINDS])
    x = x.select("held", F.explode(kinds).alias("k")).select("held", "k.kind", "k.base", F.explode("k.all").alias("c"))
    is_base = F.exists("base", lambda b: (b["s"] == F.col("c.s")) & (b["e"] == F.col("c.e")))
    x = x.select("held", "kind", "c.x", (is_base | F.col("c.y")).cast("int").alias("y"))
    rows = materialise(x.groupBy("kind", "held", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")), "personal")
    out = {}
    for kind in KINDS:
        of = lambda held: rows.filter((F.col("kind") == kind) & (F.col("held") == held))  # noqa: B023, E731
        a = of(False).orderBy(F.desc("n"), "x").limit(MAX_ROWS).collect()
        if a:
            arrays = lambda rs: (np.array([r.x for r in rs]), np.array([r.n for r in rs], float), np.array([r.pos for r in rs], float))
            model = fit_trees(*arrays(a))
            step = F.floor(margin_column(model, F.col("x")) * STEPS)
            b = of(True).groupBy(step.alias("x")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()
            z, n, pos = arrays(b)
            if b and (cut := threshold(z / STEPS, n, pos)) is not None:
                out[kind] = (model, cut)
    return out


_OUT = "array<struct<s:bigint,rank:int,e:bigint,kind:string>>"


def spans(docs: DataFrame, model: dict[str, tuple[list, float]]) -> DataFrame:
    """docs(doc_id, text) with base_<kind> (array<struct<s, e, m>>) and added (array<struct<s, rank, e, kind>>)."""
    x = docs.select("doc_id", _text(docs).alias("t"))
    t, any_ = F.col("t"), F.col("t").rlike(r"[0-9@]|at[)\]]")
    x = x.withColumns({f"base_{k}": F.when(any_, base_spans(t, k)).otherwise(none(_SPAN)) for k in KINDS})
    taken = F.concat(*[F.transform(f"base_{k}", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))) for k in KINDS])
    more = [F.transform(F.filter(candidates(t, k), lambda c: margin_column(m, c["x"]) >= cut), lambda c: F.struct(c["s"].alias("s"), F.lit(KINDS.index(k)).alias("rank"), c["e"].alias("e"), F.lit(k).alias("kind"))) for k, (m, cut) in model.items()]  # noqa: B023
    if not more:
        return x.withColumn("added", none("struct<s:bigint,rank:int,e:bigint,kind:string>")).drop("t")
    x = x.withColumn("taken", taken).withColumn("added", F.when(any_, F.sort_array(F.concat(*more))).otherwise(F.from_json(F.lit("[]"), _OUT)))
    free = let(_ends_before(F.col("added"), F.col("taken")), lambda m: F.filter("added", lambda c, i: F.get(m, i) <= c["s"]))
    # of overlapping proposals the leftmost stays
    first = lambda a: let(prefix_max(F.transform(a, lambda c: c["e"])), lambda m: F.filter(a, lambda c, i: F.get(m, i) <= c["s"]))
    return x.withColumn("added", F.when((F.size("taken") > 0) & (F.size("added") > 0), free).otherwise(F.col("added"))).withColumn("added", F.when(F.size("added") > 1, first(F.col("added"))).otherwise(F.col("added"))).drop("t", "taken")


def _ends_before(a: Column, taken: Column) -> Column:
    """For each of a, the greatest end of those in taken that start before a's end; both in one order, so that no pair is looked at."""
    kind = "struct<at:bigint,taken:int,i:int,e:bigint>"
    of = lambda at, t, i, e: F.struct(at.cast("bigint").alias("at"), F.lit(t).alias("taken"), i.cast("int").alias("i"), e.cast("bigint").alias("e")).cast(kind)
    events = F.sort_array(F.concat(F.transform(a, lambda c, i: of(c["e"], 0, i, F.lit(-1))), F.transform(taken, lambda b: of(b["s"], 1, F.lit(-1), b["e"]))))
    asked = lambda ev, m: F.filter(F.transform(ev, lambda x, k: F.when(x["taken"] == 0, F.struct(x["i"].alias("i"), F.get(m, k).alias("m")))), lambda x: x.isNotNull())
    return let(events, lambda ev: let(prefix_max(F.transform(ev, lambda x: x["e"])), lambda m: F.transform(F.sort_array(asked(ev, m)), lambda x: x["m"])))


def _joined(a: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(a), lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")


def report(docs: DataFrame, model: dict[str, tuple[list, float]] | None = None) -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    x = spans(docs, fit(docs) if model is None else model)
    base = F.concat(*[F.transform(f"base_{k}", lambda b: F.struct(b["s"].alias("s"), F.lit(i).alias("rank"), b["e"].alias("e"), F.lit(k).alias("kind"))) for i, k in enumerate(KINDS)])  # noqa: B023
    x = x.withColumn("base", base)
    return x.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
