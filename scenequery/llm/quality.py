"""Quality score: a generalised additive model with pairwise interactions.

Every feature of a text falls into one of at most MAX_BINS quantile bins.  The
model is a lookup table per feature plus one per chosen feature pair; all are
learnt by cyclic boosting: round after round, each table in turn adds a small
multiple of a shallow tree (at most four leaves) fitted to the current
gradients.  Pairs follow once the single features are done, and the pairs with
the largest gain are taken.  A score is the logistic of a sum of table entries,
looked up for a whole batch at a time.

Features come from whole texts (byte classes, word and line statistics); label,
language, source and id are no inputs.  The fit takes at most `max_rows`
labelled rows, those with the smallest hash of doc_id; that bound is a
parameter, everything else covers all rows.

Defined results: a null text scores as an empty one; label rows without a
document, with a null label, or held out don't take part; repeated label rows
count each; with no usable labels, or labels of one class, every score is the
smoothed share of label 1 (0.5 with none); a null doc_id is scored and, as it
has no remainder, counts as not held out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequery.llm.common import crc_mod, spare_name

MAX_ROWS, MAX_BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, RIDGE = 20_000, 32, 120, 8, 60, 0.15, 2.0
FOLDS, THRESHOLD = 5, 0.3

FEATURES = ["log_bytes", "log_words", "word_bytes", "distinct_words", "log_lines", "line_words", "repeated_lines", "upper", "digits", "symbols", "bars", "stops", "commas", "other_marks", "beyond_ascii", "blanks", "top_byte"]

_SYMBOLS, _OTHER = list(b"#$%&*@=+<>~^_\\"), list(b"!?;:'\"()[]{}/-`")


def features_of(text: bytes | None) -> list[float]:
    text = text or b""
    n = len(text)
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    w, m = max(1, len(words)), max(1, n)
    blanks = int(h[32] + h[9:14].sum())
    return [
        np.log1p(n), np.log1p(len(words)), (n - blanks) / w, len(set(words)) / w, np.log1p(len(lines)), len(words) / len(lines),
        1 - len(set(lines)) / len(lines), h[65:91].sum() / m, h[48:58].sum() / m, h[_SYMBOLS].sum() / w, h[124] / w, h[46] / w, h[44] / w,
        h[_OTHER].sum() / w, h[128:].sum() / m, blanks / m, h[97:].max() / m,
    ]


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, z = self.bins(x), np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for i, j, t in self.pairs:
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> int:
    """Where to split ordered bins in two; 0: nowhere."""
    if len(g) < 2:
        return 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(a, b) + _gain(g.sum() - a, h.sum() - b)
    k = int(np.argmax(gain))
    return k + 1 if gain[k] > _gain(g.sum(), h.sum()) + 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a depth-two tree over the bins."""
    out, k = np.zeros(len(g)), _cut(g, h)
    cuts = sorted({0, len(g), k, _cut(g[:k], h[:k]), k + _cut(g[k:], h[k:])})
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best four-leaf tree with one cut on either axis, and its gain."""
    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    cg, ch = (x.cumsum(0).cumsum(1) for x in (g, h))
    corner = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    parts = list(zip(corner(cg), corner(ch)))
    gain = sum(_gain(a, b) for a, b in parts)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [a[i, j] / (b[i, j] + RIDGE) for a, b in parts]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j])


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Model:
    n, pos = len(y), float(y.sum())
    model = Model(float(np.log((pos + 1) / (n - pos + 1))))
    if pos in (0, n):
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, MAX_BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    z = np.full(n, model.base)

    def steps(index, size):
        p = 1 / (1 + np.exp(-z))
        return np.bincount(index, y - p, size), np.bincount(index, p * (1 - p), size)

    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            step = RATE * _tree(*steps(b[:, j], sizes[j]))
            t += step
            z += step[b[:, j]]
    both = lambda i, j: b[:, i] * sizes[j] + b[:, j]
    grids = lambda i, j: (a.reshape(sizes[i], sizes[j]) for a in steps(both(i, j), sizes[i] * sizes[j]))
    gains = sorted(((_quadrants(*grids(i, j))[1], i, j) for i, j in combinations(range(len(sizes)), 2)), reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in gains]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            step = RATE * _quadrants(*grids(i, j))[0]
            t += step
            z += step[b[:, i], b[:, j]]
    return model


def _features(batches):
    for batch in batches:
        rows = [features_of(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Learn from labels whose crc32(doc_id) mod FOLDS is not 0."""
    seen = labels.select("doc_id", F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != 0))
    some = F.broadcast(seen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows))  # at most max_rows rows
    rows = docs.select("doc_id", "text").join(some, "doc_id").select("y", "text").mapInArrow(_features, "y double, x array<double>").orderBy(F.xxhash64("x"), "x", "y").limit(max_rows).collect()
    if not rows:
        return Model(0.0)
    order = sorted(range(len(rows)), key=lambda i: (rows[i].x, rows[i].y))  # the same sums, however rows arrive
    return fit_arrays(np.array([rows[i].x for i in order]), np.array([rows[i].y for i in order]))


def _scored(model: Model, at: int, name: str):
    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            score = model.score(np.array([features_of(t) for t in texts]).reshape(len(texts), len(FEATURES)))
            yield pa.record_batch([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return run


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs and the score of each text; the name must be free."""
    schema = docs.withColumn(name, F.lit(0.0)).schema
    return docs.mapInArrow(_scored(model, docs.columns.index("text"), name), schema)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model accepts, with their own columns."""
    name = spare_name(docs.columns, "score")
    return with_score(docs, fit(docs, labels), name).filter(F.col(name) >= threshold).select(*docs.columns)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    x = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return x.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
