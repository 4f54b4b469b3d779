"""Quality classifier: a generalised additive model with pairwise interactions.

The model is a table of log-odds per feature, indexed by the feature's bin, and a table per
chosen pair of features, indexed by both bins.  Training is cyclic boosting: round after
round each feature in turn gets a shallow tree on its bins, fitted to the current residual
(a Newton step, a small learning rate), whose values are added to the feature's table; then
the pairs with the largest remaining gain are boosted in the same way.  A score is the sum
of table entries, looked up for whole batches at once.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents, filter_texts
from .rules import repeated_words, words_of

#: Bound of the labelled rows that a model is fitted on; where there are more, those with the smallest hash of doc_id.
SAMPLE = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 5, 120, 60, 0.15

FEATURES = ("log_words", "word_length", "upper", "symbols", "digits", "punctuation", "pipes", "exclamations", "distinct", "repeated", "top_word", "word_runs", "line_words", "duplicate_lines")
_UPPER, _SYMBOLS, _DIGITS, _PUNCTUATION = (bytes(x, "ascii") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#*$%&<>~^\\{}[]=+_@", "0123456789", ".,;:?'\"()-"))


def features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES; all finite, also for an empty text."""
    text = text or ""
    data, words = text.encode("utf-8", "surrogatepass"), words_of(text)
    n, size = max(1, len(words)), max(1, len(data))
    share = lambda delete: (len(data) - len(data.translate(None, delete))) / size
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    runs = sum(map(str.__eq__, words, words[1:])) / n
    return [math.log1p(len(words)), sum(map(len, words)) / n, share(_UPPER), share(_SYMBOLS), share(_DIGITS), share(_PUNCTUATION), data.count(b"|") / n, data.count(b"!") / n, len(counts) / n, repeated_words(words) / n, max(counts.values(), default=0) / n, runs, len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines))]


class Model:
    """Edges of the bins and tables of log-odds; ``score`` gives probabilities."""

    def __init__(self, edges, base, tables, pairs):
        self.edges, self.base, self.tables, self.pairs = edges, base, tables, pairs

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[b[:, k]]
        for i, j, low, high, table in self.pairs:
            total += table[low[b[:, i]], high[b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """Values per bin of a tree that splits the ordered bins into up to ``leaves`` ranges, the best split first."""
    ranges, value = [(0, len(g))], lambda a, b: g[a:b].sum() / (h[a:b].sum() + ridge)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ridge)
    while len(ranges) < leaves:
        best = max(((gain(a, c) + gain(c, b) - gain(a, b), a, c, b) for a, b in ranges for c in range(a + 1, b)), default=None)
        if best is None or best[0] <= 1e-9:
            break
        _, a, c, b = best
        ranges.remove((a, b))
        ranges += [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in ranges:
        out[a:b] = value(a, b)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Values of the best tree that cuts a grid once along either axis, then each half along the other; and its gain."""
    best = (np.zeros_like(g), 0.0)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        cg, ch = gg.cumsum(0).cumsum(1), hh.cumsum(0).cumsum(1)
        for c in range(1, len(gg)):
            out, total = np.zeros_like(gg), 0.0
            for rows, sg, sh in ((slice(0, c), cg[c - 1], ch[c - 1]), (slice(c, None), cg[-1] - cg[c - 1], ch[-1] - ch[c - 1])):
                gains = sg[:-1] ** 2 / (sh[:-1] + ridge) + (sg[-1] - sg[:-1]) ** 2 / (sh[-1] - sh[:-1] + ridge)
                d = int(gains.argmax()) + 1
                total += gains[d - 1]
                out[rows, :d] = sg[d - 1] / (sh[d - 1] + ridge)
                out[rows, d:] = (sg[-1] - sg[d - 1]) / (sh[-1] - sh[d - 1] + ridge)
            total -= g.sum() ** 2 / (h.sum() + ridge)
            if total > best[1]:
                best = (out.T if flip else out, total)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS, rate: float = RATE, leaves: int = 4) -> Model:
    """A model for labels y (0 or 1).  Without rows of both labels its scores are the smoothed share of label 1."""
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for k in range(len(FEATURES))]
    model = Model(edges, base, [np.zeros(len(e) + 1) for e in edges], [])
    if not 0 < y.sum() < len(y):
        return model
    b, total = model.bins(x), np.full(len(y), base)

    def residual():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = (np.bincount(b[:, k], w, len(table)) for w in residual())
            step = rate * _tree(g, h, leaves)
            table += step
            total += step[b[:, k]]
    coarse = [np.minimum(np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1), PAIR_BINS - 1) for e in edges]
    cell = lambda i, j: coarse[i][b[:, i]] * PAIR_BINS + coarse[j][b[:, j]]
    grid = lambda c, w: np.bincount(c, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = residual()
    every = [(i, j) for i in range(len(edges)) for j in range(i)]
    ranked = sorted(every, key=lambda p: -_grid_tree(grid(cell(*p), g), grid(cell(*p), h))[1])
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((PAIR_BINS, PAIR_BINS))) for i, j in ranked[:pairs]]
    for _ in range(pair_rounds):
        for i, j, _low, _high, table in model.pairs:
            c, (g, h) = cell(i, j), residual()
            step = rate * _grid_tree(grid(c, g), grid(c, h))[0]
            table += step
            total += step.ravel()[c]
    return model


def held_out() -> F.Column:
    """crc32 of doc_id as text leaves 0 modulo 5: such rows' labels are not learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


_SCHEMA = ", ".join(["doc_id long", *(f"{x} double" for x in FEATURES)])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the features of each row of docs."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.copy()) for c in x.T)], ["doc_id", *FEATURES])

    return arrow_map(documents(docs), f, _SCHEMA)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels.quality over the texts of docs, from at most ``sample`` labelled rows that are not held out.

    Labels other than 0 and 1 (null too) and labels without a doc_id are skipped.  A doc_id with
    several labels counts with the smallest, one with several texts with the smallest text
    (nulls last).  Without any label every score is a half.  The labels sent to the executors and the features sent back are
    bounded by ``sample``.
    """
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out())
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    wanted = documents(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = measured(wanted).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toPandas()
    return fit(rows[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), rows["quality"].to_numpy(float))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text, ...).

    A null text counts as empty and gets a score too.  Rows that repeat are each returned; so
    are rows without doc_id, whose held_out is false; other columns are ignored; an empty table
    gives no rows.
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = arrow_map(documents(docs), f, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_by_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text the classifier takes for label 1, with their columns; each row is judged by its own text.

    A null text is judged as an empty one.  Rows that repeat all stay or go, doc_id and other
    columns don't matter for the verdict, an empty table gives no rows.
    """
    model = train(docs, labels)
    verdicts = lambda texts: model.score(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))) >= threshold
    return filter_texts(docs, lambda: verdicts)
