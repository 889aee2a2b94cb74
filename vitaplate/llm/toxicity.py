"""Toxicity: a counterfactual-regularised classifier.

A logistic model over the distinct words of a text, learned forward: the words
with the strongest evidence, beyond what chance would give, get weights, all of
which are fitted together before the next enter.  Every learning text that
mentions an identity term gets counterfactual twins, the term swapped for the
others of its kind; the loss adds a penalty on the squared change of the logit
between twins.  So a term earns no weight of its own, and neutral mentions of a
group do not raise the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.llm import common as C
from vitaplate.llm.decontaminate import VALUES, WORD
from vitaplate.llm.quality import learning_rows

#: Identity terms; those of one line are swapped for each other (fixed values).
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "arab"),
    ("immigrants", "citizens"), ("refugees", "residents"), ("disabled", "blind", "deaf"), ("elderly", "young"),
    ("frauen", "männer"), ("juden", "christen", "muslime"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"), ("immigrés", "citoyens"),
    ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"), ("inmigrantes", "ciudadanos"),
)

#: At most so many labelled rows are gathered for fitting (the lowest by a hash of their id).
FIT_ROWS = 20_000
#: Word hashes keep so many bits; one weight each (8 MB).
BITS = 20
#: A word needs so many learning texts.
LEAST_TEXTS = 4
#: Score statistic (squared slope over curvature) that a word needs to get a weight.
ENTER = 16.0
RIDGE = 0.1
SWAP_PENALTY = 1.0
#: Words that enter between two fits, and fits at most (a bound of the model's size).
AT_ONCE = 10
ROUNDS = 40


def word_sets(step: C.TextStep) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each text, one after another, and where each text's begin (n + 1 entries)."""
    words, first = C.word_hashes(step, WORD, VALUES)
    doc = np.repeat(np.arange(step.n, dtype=np.int64), np.diff(first))
    both = np.unique((doc << BITS) | (words & np.uint64((1 << BITS) - 1)).astype(np.int64))
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(step.n + 1))


def _term_hashes() -> list[list[int]]:
    return [[int(word_sets(C.TextStep(pa.array([t])))[0][0]) for t in kind] for kind in IDENTITY_TERMS]


@dataclass
class WordModel:
    """One weight per hashed word."""

    bias: float
    weights: np.ndarray

    def score(self, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text's words."""
        total = np.concatenate([[0.0], np.cumsum(self.weights[words])])
        return 1 / (1 + np.exp(-(self.bias + total[begin[1:]] - total[begin[:-1]])))


def fit_words(sets: list[np.ndarray], y: np.ndarray, swap_penalty: float = SWAP_PENALTY, least: int = LEAST_TEXTS) -> WordModel:
    """Forward selection, with Newton steps on log loss, ridge and the penalty on twins' logit changes.

    Without rows, or with one label only, the model is its prior.
    """
    weights = np.zeros(1 << BITS)
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if len(y) == 0 or y.min() == y.max():
        return WordModel(bias, weights)
    often = np.bincount(np.concatenate(sets), minlength=1 << BITS)
    kinds = _term_hashes()
    terms = sorted({t for kind in kinds for t in kind})
    used = np.union1d(np.flatnonzero(often >= least), np.array(terms, np.int64))
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    col = place[np.concatenate(sets)]
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    row, col = row[col >= 0], col[col >= 0]

    # a twin swaps every term of one kind; only the words that change matter
    twin, away, to = [], [], []
    n = 0
    for s in sets:
        have = set(s.tolist())
        for kind in kinds:
            held = [k for k, t in enumerate(kind) if t in have]
            for shift in range(1, len(kind)) if held else ():
                for k in held:
                    twin.append(n)
                    away.append(place[kind[k]])
                    to.append(place[kind[(k + shift) % len(kind)]])
                n += 1
    twin, away, to = (np.array(x, np.int64) for x in (twin, away, to))

    rows = len(sets)
    chosen: list[int] = []
    w = np.zeros(0)
    p = np.full(rows, prior)
    for _ in range(ROUNDS):
        rest = np.bincount(col, (y - p)[row], len(used))
        curve = np.bincount(col, (p * (1 - p))[row], len(used)) + RIDGE
        if n:  # a lone step of a term changes all its twins
            curve += 2 * swap_penalty * (np.bincount(to, minlength=len(used)) + np.bincount(away, minlength=len(used)))
        evidence = rest * rest / curve
        evidence[chosen] = 0
        new = np.argsort(-evidence, kind="stable")[:AT_ONCE]
        new = new[evidence[new] >= ENTER]
        if not len(new):
            break
        chosen += new.tolist()
        w = np.concatenate([w, np.zeros(len(new))])
        at = np.full(len(used), -1, np.int64)
        at[chosen] = np.arange(len(chosen))
        x = np.zeros((rows, len(chosen) + 1), np.float64)
        x[:, -1] = 1
        mine = at[col] >= 0
        x[row[mine], at[col[mine]]] = 1
        d = np.zeros((n, len(chosen) + 1))
        for side, sign in ((to, 1.0), (away, -1.0)):
            mine = at[side] >= 0 if n else np.zeros(0, bool)
            np.add.at(d, (twin[mine], at[side[mine]]), sign)
        penalty = 2 * swap_penalty * (d.T @ d) + RIDGE * np.diag([1.0] * len(chosen) + [0.0])
        full = np.append(w, bias)
        for _ in range(12):
            p = 1 / (1 + np.exp(-(x @ full)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(len(full)), x.T @ (y - p) - penalty @ full)
            full = full + np.clip(step, -2, 2)
        w, bias = full[:-1], float(full[-1])
        p = 1 / (1 + np.exp(-(x @ full)))
    if chosen:
        weights[used[chosen]] = w
    return WordModel(float(bias), weights)


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> WordModel:
    """The model of ``labels.toxic``, from labelled rows whose crc32(doc_id) mod 5 is not 0.

    Tasks turn texts into hashed words; the driver gathers those of at most
    ``limit`` rows.  Rows of equal text are used once, so copies do not weigh.
    """
    rows = learning_rows(docs, labels, "toxic", 5, 0, limit)
    keyed = rows.withColumn("same", F.xxhash64(F.coalesce("text", F.lit(""))))

    def step(texts: C.TextStep) -> list[pa.Array]:
        words, begin = word_sets(texts)
        return [pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(words.astype(np.int32)))]

    got = C.add_columns(keyed, [T.StructField("words", T.ArrayType(T.IntegerType()))], "text", step)
    kept = {}
    for r in sorted(got.select("doc_id", "same", "y", "words").collect(), key=lambda r: (r.same, r.doc_id)):
        kept.setdefault(r.same, (np.array(r.words, np.int64), r.y))
    return fit_words([k[0] for k in kept.values()], np.array([k[1] for k in kept.values()], float))


def score_toxicity(docs: DataFrame, model: WordModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); a column of these names is replaced.

    Every row is scored from its whole text alone; null and empty texts score the bias.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB, whatever the input

    def step(texts: C.TextStep) -> list[pa.Array]:
        s = sent.value.score(*word_sets(texts))
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

    return C.add_columns(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], "text", step)


def digest(scored: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scored.select("doc_id", (C.crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
