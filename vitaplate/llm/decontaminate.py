"""Benchmark decontamination with training suffix arrays.

Every task cuts its documents into shards of bounded size and builds a suffix
array over each shard's words.  Every suffix of every test item is then found
in the shard by binary search; the range of equal suffixes gives the verbatim
matches and their locations.  Nothing is shuffled: documents stay where they
were read, and the test items come to them in blocks of bounded size.

Words are compared by 64-bit hashes.  The suffix array is sparse: a suffix
enters it only when it starts with as many words of the test vocabulary as the
shortest window has, as no other suffix can hold a match.  Suffixes are ordered
by their first ``window`` words, which settles every search; longer matches are
runs of matching windows on one diagonal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.llm import common as C

#: Word bytes once A-Z is lower-cased: everything but 00-2F, 3A-60 and 7B-7F.
WORD = np.ones(256, bool)
WORD[0x00:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False
WORD[65:91] = True
VALUES = C.lowered_table(WORD)

WINDOW = 13
#: Bytes of test text that one broadcast block holds.
BLOCK_BYTES = 16 << 20
#: As many blocks stay in a worker's memory; of more, one at a time is there.
HELD_BLOCKS = 4

RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("longest_match", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def _column(texts: list[str | None]) -> pa.Array:
    return pa.array(texts, pa.large_string())


def _pack(tokens: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of small integers as a few 64-bit keys in the same order."""
    per = 63 // bits
    keys = []
    for a in range(0, tokens.shape[1], per):
        part = tokens[:, a : a + per]
        key = np.zeros(len(tokens), np.int64)
        for j in range(per):
            key <<= bits
            if j < part.shape[1]:
                key |= part[:, j]
        keys.append(key)
    return keys


class TestItems:
    """The windows of one block of test items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        self.ids = [str(i) for i in ids]
        step = C.TextStep(_column(texts))
        words, first = C.word_hashes(step, WORD, VALUES)
        self.vocabulary = np.unique(words)
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        tokens = np.searchsorted(self.vocabulary, words).astype(np.int64) + 1
        sizes = np.diff(first)
        item, start, length = [], [], []
        for i, n in enumerate(sizes.tolist()):
            if n == 0:
                continue
            size = min(window, n)
            begin = np.arange(first[i], first[i] + n - size + 1)
            item.append(np.full(len(begin), i))
            start.append(begin)
            length.append(np.full(len(begin), size))
        self.empty = not item
        if self.empty:
            return
        item, start, length = (np.concatenate(x) for x in (item, start, length))
        self.shortest = int(length.min())
        padded = np.concatenate([tokens, np.zeros(window, np.int64)])
        rows = padded[start[:, None] + np.arange(window)]
        rows[np.arange(window) >= length[:, None]] = 0
        rows, which = np.unique(rows, axis=0, return_inverse=True)
        which = which.reshape(-1)
        order = np.argsort(which, kind="stable")
        self.length = np.zeros(len(rows), np.int64)
        self.length[which] = length
        self.holders = item[order], (start - first[item])[order]
        self.holder_at = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(rows)))])
        top = rows.copy()
        top[np.arange(window) >= self.length[:, None]] = (1 << self.bits) - 1
        self.low, self.high = _pack(rows, self.bits), _pack(top, self.bits)


def _bound(keys: list[np.ndarray], sought: list[np.ndarray], after: bool) -> np.ndarray:
    """For each sought key the first place in the suffix array at (or after) it, by binary search of all at once."""
    n, m = len(keys[0]), len(sought[0])
    low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = np.minimum((low + high) >> 1, n - 1)
        less = np.zeros(m, bool)
        equal = np.ones(m, bool)
        for key, want in zip(keys, sought, strict=True):
            have = key[mid]
            less |= equal & (have < want)
            equal &= have == want
        if after:
            less |= equal
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)


class Shard:
    """The words of some documents and their suffix array for one block of test items."""

    def __init__(self, step: C.TextStep, window: int):
        self.words, self.first = C.word_hashes(step, WORD, VALUES)
        self.window = window
        self.sizes = np.diff(self.first)
        self.doc = np.repeat(np.arange(step.n), self.sizes)

    def search(self, tests: TestItems) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window number) of every occurrence of a test window."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n, window = len(self.words), self.window
        if n == 0 or tests.empty:
            return none
        at = np.minimum(np.searchsorted(tests.vocabulary, self.words), len(tests.vocabulary) - 1)
        tokens = np.where(tests.vocabulary[at] == self.words, at + 1, 0)
        # words of the test vocabulary in a row from each place on, within its document
        stop = (tokens == 0).copy()
        places = np.arange(n)
        ends = self.first[1:][self.doc]
        next_stop = np.minimum.accumulate(np.where(stop, places, n)[::-1])[::-1]
        run = np.minimum(next_stop, ends) - places
        suffixes = places[run >= tests.shortest]
        if not len(suffixes):
            return none
        padded = np.concatenate([tokens, np.zeros(window, np.int64)])
        rows = padded[suffixes[:, None] + np.arange(window)]
        rows[np.arange(window) >= np.minimum(run[suffixes], window)[:, None]] = 0
        keys = _pack(rows, tests.bits)
        order = np.lexsort(keys[::-1])
        suffixes, keys = suffixes[order], [k[order] for k in keys]
        low = _bound(keys, tests.low, after=False)
        high = _bound(keys, tests.high, after=True)
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return suffixes[np.repeat(low, count) + offset], which


def _loaded(block, keep: bool) -> TestItems:
    """A broadcast block's value; unless ``keep``, the worker forgets it and reads it from its file the next time."""
    value = block.value
    if not keep:
        block.__dict__.pop("_value", None)
    return value


def _matches(shard: Shard, blocks):
    """Per document: hit words, item ids, longest match; and the hit mask over the shard's words."""
    n, docs = len(shard.words), len(shard.sizes)
    change = np.zeros(n + 1, np.int64)
    items: list[set] = [set() for _ in range(docs)]
    longest = np.zeros(docs, np.int64)
    for tests in blocks:
        place, which = shard.search(tests)
        if not len(place):
            continue
        length = tests.length[which]
        np.add.at(change, place, 1)
        np.add.at(change, place + length, -1)
        # each occurrence once for every item that holds the window
        held = tests.holder_at[which + 1] - tests.holder_at[which]
        k = np.repeat(tests.holder_at[which], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        item, inside = tests.holders[0][k], tests.holders[1][k]
        at, size = np.repeat(place, held), np.repeat(length, held)
        doc = shard.doc[at]
        for d, i in set(zip(doc.tolist(), item.tolist(), strict=True)):
            items[d].add(tests.ids[i])
        # a longer match is a run of windows that move on together
        order = np.lexsort((at, at - inside, item, doc))
        doc, item, diagonal, at, size = doc[order], item[order], (at - inside)[order], at[order], size[order]
        joined = np.zeros(len(at), bool)
        joined[1:] = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (diagonal[1:] == diagonal[:-1]) & (at[1:] == at[:-1] + 1)
        begin = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
        np.maximum.at(longest, doc, np.arange(len(at)) - begin + size)
    hit = np.cumsum(change[:-1]) > 0
    return hit, items, longest


def _spans(hit: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        part = hit[a:b]
        if not part.any():
            out.append([])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], part.astype(np.int8), [0]])))
        out.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
    return out


def test_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """The test items as broadcast blocks, each of about ``block_bytes`` at most.

    The number of blocks follows the measured size of the test set, so no
    broadcast grows with it; each block passes through the driver on its own.
    """
    spark = items.sparkSession
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        got = sorted(((r.i, r.t) for r in part.collect()), key=lambda r: (str(r[0]), r[1]))
        out.append(spark.sparkContext.broadcast(TestItems([g[0] for g in got], [g[1] for g in got], window)))
    return out


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the verbatim matches of every test window.

    Adds ``n_words``, ``n_hit`` (words inside any match), ``n_items`` and
    ``item_ids`` (items with a matching window, sorted as text), ``longest_match``
    (words) and ``hit_spans`` (word ranges).  Null and empty texts have no words;
    repeated rows, ids and null ids each give their own row; an empty test set
    hits nothing; items with equal text all count; a null item id reads "None".
    Columns of the same names are replaced, all others kept.
    """
    blocks = test_blocks(items, id_col, item_text_col, window, block_bytes)

    def step(texts: C.TextStep) -> list[pa.Array]:
        shard = Shard(texts, window)
        hit, found, longest = _matches(shard, (_loaded(b, keep=len(blocks) <= HELD_BLOCKS) for b in blocks))
        total = np.concatenate([[0], np.cumsum(hit)])
        counts = total[shard.first[1:]] - total[shard.first[:-1]]
        span = T.ArrayType(RESULT[-1].dataType.elementType)
        from pyspark.sql.pandas.types import to_arrow_type

        return [
            pa.array(shard.sizes, pa.int64()),
            pa.array(counts, pa.int64()),
            pa.array([len(f) for f in found], pa.int64()),
            pa.array([sorted(f) for f in found], pa.list_(pa.string())),
            pa.array(longest, pa.int64()),
            pa.array(_spans(hit, shard.first), to_arrow_type(span)),
        ]

    return C.add_columns(docs, RESULT, text_col, step)


def contaminated():
    """The contract's rule: at least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones; the columns of ``docs``."""
    return C.filtered(docs, [f.name for f in RESULT], lambda d: find_contamination(d, items, **options).where(~contaminated()))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_contamination``'s rows."""
    joined = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(joined.cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"), "longest_match")


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract read literally, for tests: (doc_id, n_words, n_hit, n_items, sha256, contaminated)."""
    import re

    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}

    def words(text):
        return pattern.findall((text or "").translate(lower))

    sought = []
    for i, text in items:
        w = words(text)
        size = min(window, len(w))
        sought += [(str(i), w[a : a + size]) for a in range(len(w) - size + 1 if size else 0)]
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, part in sought:
            for a in range(len(w) - len(part) + 1):
                if w[a : a + len(part)] == part:
                    hit.update(range(a, a + len(part)))
                    names.add(name)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out
