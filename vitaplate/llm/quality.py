"""Quality classifier: a generalised additive model with pairwise interactions.

Whole texts become a few shape features.  Each feature is cut into bins; the
model adds one learned number per bin, and one per cell of the best pairs of
features.  The tables are learned by cyclic boosting: round after round, each
feature in turn gets a shallow tree (at most ``LEAVES`` leaves) fitted to the
gradients of the log loss on its histogram, and its steps are added to the
feature's table; then the pairs that reduce the remaining loss most are boosted
the same way.  Scoring is a table lookup and a sum.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.llm import common as C

FEATURES = (
    "log_words", "mean_word", "distinct_share", "bigram_share", "top_word_share", "repeat_next_share", "distinct_line_share",
    "upper_share", "digit_share", "symbol_share", "exclaim_per_word", "symbol_word_share", "one_char_share", "ends_share",
    "words_per_line", "letter_entropy", "long_word_share", "odd_share",
)

#: At most so many labelled rows are gathered for fitting (the lowest by a hash of their id).
FIT_ROWS = 40_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
RATE = 0.15
LEAVES = 3
SHRINK = 4.0
#: A document at or above it is good.
KEEP = 0.7

_WORD = re.compile(r"\S+")


def features(text: str | None) -> list[float]:
    """The shape of a whole text, as FEATURES; null is the empty text, whose features are 0."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    if n == 0:
        return [0.0] * len(FEATURES)
    chars = len(text)
    counts = Counter(words)
    letters = sum(map(str.isalpha, text)) if not text.isascii() else sum(len(x) for x in re.findall("[A-Za-z]+", text))
    upper = sum(len(x) for x in re.findall(r"[A-ZÀ-ÖØ-Þ]+", text))
    digits = sum(len(x) for x in re.findall("[0-9]+", text))
    spaces = chars - sum(map(len, words))
    symbols = sum(len(x) for x in re.findall(r"[#$%&*|<>{}\[\]\\^~=@_/+]+", text))
    odd = len(re.findall("[�\x00-\x08\x0e-\x1f]", text)) + max(0, chars - letters - digits - spaces - symbols - sum(map(text.count, ".,;:!?'\"()-\n")))
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    first = Counter(text.replace(" ", "").replace("\n", ""))
    total = sum(first.values()) or 1
    entropy = -sum(c / total * math.log2(c / total) for c in first.values())
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log1p(n),
        (chars - spaces) / n,
        len(counts) / n,
        pairs / max(1, n - 1),
        max(counts.values()) / n,
        same / max(1, n - 1),
        len(set(lines)) / max(1, len(lines)),
        upper / max(1, letters),
        digits / chars,
        symbols / chars,
        text.count("!") / n,
        sum(c for w, c in counts.items() if not any(map(str.isalnum, w))) / n,
        sum(c for w, c in counts.items() if len(w) == 1) / n,
        sum(text.count(x) for x in ".?") / n,
        n / max(1, len(lines)),
        entropy,
        sum(c for w, c in counts.items() if len(w) > 15) / n,
        odd / chars,
    ]


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; the score is the logistic of their sum."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        """Bin numbers of all features, by column."""
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: one addition per table."""
        z = np.full(len(x), self.base)
        for j, b in enumerate(self.bins(x, self.edges).T):
            z += self.tables[j][b]
        if self.pairs:
            b = self.bins(x, self.pair_edges)
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges at quantiles of the distinct-enough values."""
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))
    return cuts


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Steps of a shallow tree on a histogram: the best cuts one after another, Newton steps in its leaves."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])

    def gain(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + SHRINK)

    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            cut = np.arange(a + 1, b)
            if len(cut):
                got = gain(a, cut) + gain(cut, b) - gain(a, b)
                k = int(np.argmax(got))
                best = max(best, (float(got[k]), (a, b), int(cut[k])), key=lambda v: v[0])
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(gradient))
    for a, b in parts:
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + SHRINK)
    return step


def _cell_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Steps of the best two-cut tree on a two-way histogram: one cut of each feature, four leaves."""
    g, h = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (gradient, weight))
    n, m = gradient.shape
    if n < 2 or m < 2:
        return np.zeros_like(gradient)
    i, j = np.arange(1, n)[:, None], np.arange(1, m)[None, :]

    def quarters(s):
        return s[i, j], s[i, m] - s[i, j], s[n, j] - s[i, j], s[n, m] - s[i, m] - s[n, j] + s[i, j]

    gain = sum(a**2 / (b + SHRINK) for a, b in zip(quarters(g), quarters(h), strict=True))
    ci, cj = np.unravel_index(int(np.argmax(gain)), gain.shape)
    ci, cj = ci + 1, cj + 1
    step = np.zeros_like(gradient)
    for rows in (slice(0, ci), slice(ci, n)):
        for cols in (slice(0, cj), slice(cj, m)):
            step[rows, cols] = gradient[rows, cols].sum() / (weight[rows, cols].sum() + SHRINK)
    return step


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS) -> AdditiveModel:
    """Cyclic boosting of one table per feature, then of tables of the best pairs.

    Without rows the model scores 0.5; with one label only, near that label.
    """
    k = x.shape[1]
    mean = (y.sum() + 1) / (len(y) + 2)
    edges = [_edges(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(k)]
    model = AdditiveModel(edges, float(np.log(mean / (1 - mean))), [np.zeros(len(e) + 1) for e in edges])
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x, edges)
    z = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            r, w = slopes()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(b[:, j], r, size), np.bincount(b[:, j], w, size), LEAVES)
            model.tables[j] += step
            z += step[b[:, j]]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    b = model.bins(x, model.pair_edges)
    sizes = [len(e) + 1 for e in model.pair_edges]

    def cells(i, j):
        r, w = slopes()
        at = b[:, i] * sizes[j] + b[:, j]
        n = sizes[i] * sizes[j]
        return np.bincount(at, r, n).reshape(sizes[i], sizes[j]), np.bincount(at, w, n).reshape(sizes[i], sizes[j])

    gains = []
    for i in range(k):
        for j in range(i + 1, k):
            g, h = cells(i, j)
            step = _cell_tree(g, h)
            gains.append((float((step * g).sum()), i, j))
    model.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for t, (i, j) in enumerate(model.pairs):
            step = RATE * _cell_tree(*cells(i, j))
            model.pair_tables[t] += step
            z += step[b[:, i], b[:, j]]
    return model


def _texts(step: C.TextStep) -> list[str]:
    return [step.doc_bytes(i).tobytes().decode() for i in range(step.n)]


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, limit: int) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents outside the held-out fold, the lowest by a hash of their id.

    The chosen ids are at most ``limit`` rows of two numbers, hence broadcast.
    Null ids and null labels are left out; an id with two labels is used with the lower.
    """
    fold = C.crc_mod("doc_id", modulus)
    known = labels.select("doc_id", F.col(label).alias("y")).where((fold != held) & F.col("y").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> AdditiveModel:
    """The model of ``labels.quality``, from labelled rows whose crc32(doc_id) mod 4 is not 2.

    Features are computed in tasks; the driver gathers at most ``limit`` rows of
    numbers.  Rows of equal text are used once, so copies do not weigh.
    """
    rows = learning_rows(docs, labels, "quality", 4, 2, limit)
    fields = [T.StructField("x", T.ArrayType(T.DoubleType()))]

    def step(texts: C.TextStep) -> list[pa.Array]:
        return [pa.array([features(t) for t in _texts(texts)], pa.list_(pa.float64()))]

    keyed = rows.withColumn("same", F.xxhash64(F.coalesce("text", F.lit(""))))
    got = C.add_columns(keyed, fields, "text", step).select("doc_id", "same", "y", "x").collect()
    kept = {}
    for r in sorted(got, key=lambda r: (r.same, r.doc_id)):
        kept.setdefault(r.same, r)
    x = np.array([r.x for r in kept.values()], float).reshape(-1, len(FEATURES))
    return fit_additive(x, np.array([r.y for r in kept.values()], float))


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from KEEP on); a column of these names is replaced.

    Every row is scored from its whole text alone; null and empty texts score as the empty text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers, whatever the input

    def step(texts: C.TextStep) -> list[pa.Array]:
        x = np.array([features(t) for t in _texts(texts)], float).reshape(-1, len(FEATURES))
        s = sent.value.score(x)
        return [pa.array(s, pa.float64()), pa.array((s >= KEEP).astype(np.int32), pa.int32())]

    return C.add_columns(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], "text", step)


def keep_good(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with the columns of ``docs``."""
    return C.filtered(docs, ["score", "predicted"], lambda d: score_quality(d, model).where("predicted = 1"))


def digest(scored: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scored.select("doc_id", (C.crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
