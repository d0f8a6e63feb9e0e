"""Mixing sources to target weights over a domain - language - source tree.

Weights pass down the tree: a node's share of its parent's budget is its weight
over its siblings'.  No node gets more than its capacity, max_epochs times the
tokens below it; what one can't take goes to its siblings in proportion to
their weights, and only what all of them can't take reaches the parent's
siblings (a parent's capacity is the sum of its children's, so filling level by
level from the top does just that).  With siblings in the order of capacity
over weight, the filling level is the largest (budget - capacities before) /
(weights from here on): one window per level over one row per node.

A leaf with budget A and T tokens gives floor(A / T) whole epochs, then a prefix
of the next epoch, whose seeded order is that of a hash of (seed, epoch,
doc_id).  The prefix ends inside the document at the leaf's cut hash.  To find
it, tokens are summed over SLICES equal slices of the hash range; only the
slice that holds the cut is put in order.  No window holds a leaf's documents.

Everything is DataFrame functions; leaf tables are joined as Spark's own size
check decides, and by splitting skewed partitions beyond it.

Defined results: a null text has no tokens; null domain, language or source
count as the leaf ""; a leaf without tokens or weight gets nothing; documents
with equal doc_id share their place in the order (all of them or none are in a
prefix, and the cut falls on each); a null doc_id hashes as null; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequery.llm.common import materialise

LEVELS = ("domain", "lang", "source")
#: Share of all tokens to give out, most epochs of a leaf, exponent of a node's tokens where no weight is given.
SHARE, MAX_EPOCHS, ALPHA, SEED, SLICES = 0.8, 4, 0.5, 17, 4096
#: The domain of a source where documents have none.
N_DOMAINS = 4


def n_tokens(text: Column) -> Column:
    """Words between spaces and line feeds."""
    words = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), " ")
    return (F.size(words) - F.size(F.filter(words, lambda w: w == ""))).cast("long")


def domain_of(source: Column) -> Column:
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % N_DOMAINS).cast("string"))


def leaves_of(docs: DataFrame, domain: Column | None = None) -> dict[str, Column]:
    """The three keys of a document's leaf."""
    domain = domain if domain is not None else domain_of(docs["source"].cast("string"))
    keys = {"domain": domain, "lang": docs["lang"], "source": docs["source"]}
    return {k: F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in keys.items()}


def fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes(parent..., key, weight, capacity, budget: the parent's) with `given`: each node's part of it."""
    by = Window.partitionBy(*parent).orderBy("ratio", *[c for c in nodes.columns if c in LEVELS])
    x = nodes.withColumn("ratio", F.when((F.col("weight") > 0) & (F.col("capacity") > 0), F.col("capacity") / F.col("weight")))
    x = x.withColumn("before", F.coalesce(F.sum(F.when(F.col("ratio").isNotNull(), F.col("capacity"))).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("after", F.sum(F.when(F.col("ratio").isNotNull(), F.col("weight"))).over(by.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max(F.when(F.col("ratio").isNotNull(), (F.col("budget") - F.col("before")) / F.col("after"))).over(Window.partitionBy(*parent))
    given = F.when(F.col("ratio").isNull(), 0.0).otherwise(F.least("capacity", F.col("weight") * F.greatest(level, F.lit(0.0))))
    return x.withColumn("given", given).drop("ratio", "before", "after")


def budgets(leaves: DataFrame, total: float | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, alpha: float = ALPHA, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """leaves(domain, lang, source, tokens) with `budget`, a whole number of tokens.

    weights: for a level, the weights of some keys; all others weigh tokens ** alpha.
    """
    weights = weights or {}
    budget = None
    for depth in range(3):
        keys, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = leaves.groupBy(*keys).agg(F.sum("tokens").cast("double").alias("t"))
        own = F.pow("t", F.lit(alpha))
        for key, w in weights.get(LEVELS[depth], {}).items():
            own = F.when(F.col(LEVELS[depth]) == key, F.lit(float(w))).otherwise(own)
        nodes = nodes.select(*keys, own.alias("weight"), (F.col("t") * max_epochs).alias("capacity"))
        if budget is None:
            want = F.lit(float(total)) if total is not None else F.sum("capacity").over(Window.partitionBy()) * (share / max_epochs)
            nodes = nodes.withColumn("budget", F.least(want, F.sum("capacity").over(Window.partitionBy())))
        else:
            nodes = nodes.join(budget, parent)
        budget = fill(nodes, parent).select(*keys, F.col("given").alias("budget"))
    return leaves.join(budget.withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long")), list(LEVELS))


def order_hash(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), doc_id)


def plan(rows: DataFrame, seed: int = SEED, slices: int = SLICES, **kw) -> DataFrame:
    """rows(doc_id, domain, lang, source, tokens) -> a row per leaf: tokens, budget, epochs, rest, cut, cut_tokens.

    Documents of the leaf are taken `epochs` times; once more whole if their hash
    in epoch `epochs` is below `cut`, and for their first `cut_tokens` tokens if it equals it.
    """
    on = list(LEVELS)
    leaves = budgets(rows.groupBy(*on).agg(F.sum("tokens").alias("tokens")), **kw)
    some = F.col("tokens") > 0
    leaves = leaves.withColumn("epochs", F.when(some, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
    leaves = materialise(leaves.withColumn("rest", F.when(some, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0).cast("long")), "mixing-leaves")
    placed = rows.join(leaves.filter("rest > 0").select(*on, "epochs", "rest"), on).withColumn("h", order_hash(F.col("epochs"), F.col("doc_id"), seed))
    part = F.pmod(F.shiftrightunsigned("h", 40), F.lit(1 << 24)) * F.lit(slices) / F.lit(1 << 24)
    placed = placed.withColumn("slice", F.floor(part).cast("int"))
    order = F.struct("slice", F.shiftrightunsigned("h", 1), F.col("h").bitwiseAND(1))
    hist = placed.groupBy(*on, "slice").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy(*on).orderBy("slice"))
    at = hist.withColumn("upto", upto).filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest"))).select(*on, "slice", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
    near = placed.join(at, [*on, "slice"]).groupBy(*on, "h", "slice").agg(F.max("tokens").alias("most"), F.sum("tokens").alias("n"), F.first("left").alias("left"))
    w = Window.partitionBy(*on).orderBy(order)
    cut = near.withColumn("upto", F.sum("n").over(w)).filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
    cut = cut.select(*on, "slice", F.col("h").alias("cut"), F.least("most", F.col("left") - F.col("upto") + F.col("n")).alias("cut_tokens"))
    return materialise(leaves.join(cut, on, "left"), "mixing-plan")


def taken(rows: DataFrame, leaves: DataFrame, seed: int = SEED) -> DataFrame:
    """rows with `epochs` (whole times) and `prefix_tokens` (of one more time)."""
    part = leaves.select(*LEVELS, F.col("epochs"), F.col("cut"), F.col("cut_tokens"), F.col("slice").alias("cut_slice"))
    x = rows.join(part, list(LEVELS))
    h = order_hash(F.col("epochs"), F.col("doc_id"), seed)
    place = lambda v: F.struct(F.shiftrightunsigned(v, 1), v.bitwiseAND(1))  # noqa: E731  the unsigned order
    got = F.when(F.col("cut").isNull(), 0).when(h == F.col("cut"), F.least("tokens", "cut_tokens")).when(place(h) < place(F.col("cut")), F.col("tokens")).otherwise(0)
    return x.withColumn("prefix_tokens", got.cast("long")).drop("cut", "cut_tokens", "cut_slice")


def narrow(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, tokens) of documents, written once: texts are read a single time."""
    return materialise(docs.select(F.col("doc_id"), *leaves_of(docs, domain).values(), n_tokens(docs["text"].cast("string")).alias("tokens")), "mixing-rows")


def report(docs: DataFrame, seed: int = SEED, domain: Column | None = None, **kw) -> DataFrame:
    """A row per document: doc_id, its leaf, tokens, epochs, prefix_tokens, taken_tokens."""
    rows = narrow(docs, domain)
    x = taken(rows, plan(rows, seed, **kw), seed)
    return x.select("doc_id", *LEVELS, "tokens", "epochs", "prefix_tokens", (F.col("epochs") * F.col("tokens") + F.col("prefix_tokens")).alias("taken_tokens"))


def mix(docs: DataFrame, seed: int = SEED, domain: Column | None = None, **kw) -> DataFrame:
    """The documents as often as they are taken, with their own columns; one that a prefix cuts stays whole."""
    names = docs.columns
    leaves = plan(narrow(docs, domain), seed, **kw)
    keyed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: F.col(f"c{i}") for i, n in enumerate(names)}
    k = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keyed = keyed.withColumns({"domain": k(domain if domain is not None else domain_of(at["source"].cast("string"))), "lang": k(at["lang"]), "source": k(at["source"]), "doc_id": at["doc_id"], "tokens": n_tokens(at["text"].cast("string"))})
    times = F.col("epochs") + (F.col("prefix_tokens") > 0).cast("int")
    x = taken(keyed, leaves, seed).filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return x.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
