"""Ranked lexical search by an Aho-Corasick scan of the texts.

The terms of all items stand in one automaton, each between two boundary marks.
A text is read through it with its other characters turned into marks, so an
output is a whole term and its occurrences are counted straight from the text:
there is no index of the documents.

1. The items are cut into blocks of bounded text; a block's automaton is broadcast.
2. A first scan counts documents, terms and, for each term of the block, the
   documents that hold it: each task sends one row for each of them.
3. A second scan scores every document for all items of the block.  The
   automaton's outputs map to items by a table of postings, and each task keeps
   the best of each item only.
4. The tasks' best meet in two steps, first salted, then by item.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vitaplate.llm import common as C

#: Results of an item.
TOP = 10
#: Bytes of items' texts whose terms stand in one automaton; a longer item is a block of its own.
BLOCK_BYTES = 2 << 20
#: Scores that a task holds at once.
CELLS = 2_000_000
#: Groups of tasks whose best rows meet first.
SALTS = 64

#: Term bytes: 0-9, A-Z, a-z, everything outside ASCII; the rest are marks.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MARKED = np.where(TERM, np.arange(256), 0x20).astype(np.uint8)
_MARKED[65:91] += 32
_LOWER = {c: c + 32 for c in range(65, 91)}
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text: str | None) -> list[str]:
    return re.findall(_TERMS, (text or "").translate(_LOWER))


_ITEMS = T.StructType(
    [
        T.StructField("item", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("repeats", T.ArrayType(T.LongType())),
    ]
)


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, block, terms, repeats): neighbours share a block until its texts pass ``block_bytes``; a block is named by its first item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, 0
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len((text or "").encode())
                if block is None or held + size > block_bytes:
                    block, held = item, 0
                held += size
                counts = Counter(_terms(text))
                rows.append((item, block, list(counts), list(counts.values())))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=_ITEMS.names)

    return items.select("item", "text").mapInArrow(run, _ITEMS)


class Postings:
    """The terms of a block and, for each, the items that hold it with their repeats."""

    def __init__(self, rows: list):
        self.items = [r.item for r in rows]
        number: dict[str, int] = {}
        pairs = [(number.setdefault(t, len(number)), i, n) for i, r in enumerate(rows) for t, n in zip(r.terms, r.repeats, strict=True)]
        self.terms = list(number)
        table = np.array(pairs, np.int64).reshape(-1, 3)
        table = table[np.argsort(table[:, 0], kind="stable")]
        self.first = np.searchsorted(table[:, 0], np.arange(len(number) + 1))
        self.item, self.repeats = table[:, 1].copy(), table[:, 2].copy()


_AUTOMATON: dict[str, object] = {}


def _automaton(label: str, terms: list[str]):
    """The automaton of a block's terms, built once in a worker; the last block's alone is kept."""
    if label not in _AUTOMATON:
        import ahocorasick

        _AUTOMATON.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(terms):
            made.add_word(f" {term} ", i)
        made.make_automaton()
        _AUTOMATON[label] = made
    return _AUTOMATON[label]


def _scan(step: C.TextStep, automaton) -> tuple[np.ndarray, list[Counter]]:
    """Each text's number of terms, and the counts of the automaton's outputs in it."""
    data = _MARKED[step.data]
    inside = TERM[step.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = step.offsets[:-1][step.offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    counts = np.concatenate([np.zeros(1, np.int64), np.cumsum(begins)])
    n = counts[step.offsets[1:]] - counts[step.offsets[:-1]]
    raw, ends = data.tobytes(), step.offsets.tolist()
    found = []
    for i in range(step.n):
        text = f" {raw[ends[i]:ends[i + 1]].decode()} "
        found.append(Counter(map(itemgetter(1), automaton.iter(text))) if n[i] else Counter())
    return n, found


_STATS = T.StructType([T.StructField("term", T.LongType()), T.StructField("n", T.LongType())])
DOCUMENTS, ALL_TERMS = -1, -2


def term_statistics(texts: DataFrame, shared, label: str) -> dict[int, int]:
    """Documents that hold each term of the block; under DOCUMENTS those with terms, under ALL_TERMS their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(label, shared.value.terms)
        total = np.zeros(len(shared.value.terms), np.int64)
        documents = terms = 0
        for batch in batches:
            for part in C.slices(batch, 0):
                n, found = _scan(C.TextStep(part.column(0)), automaton)
                documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
                held = np.fromiter(chain.from_iterable(found), np.int64)
                total += np.bincount(held, minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*held.tolist(), DOCUMENTS, ALL_TERMS], pa.int64()), pa.array([*total[held].tolist(), documents, terms], pa.int64())], names=_STATS.names)

    sums = texts.select("text").mapInArrow(run, _STATS).groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in sums.collect()}


class _Best:
    """The best documents of each item so far: higher scores first, then smaller ids, missing ids last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.rows = np.zeros((0, 4), np.int64)  # item, -score, missing, id

    def add(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        new = np.stack([item, -scores[doc, item], missing[doc], ids[doc]], axis=1)
        rows = np.concatenate([self.rows, new])
        rows = rows[np.lexsort(rows.T[::-1])]
        first = np.searchsorted(rows[:, 0], rows[:, 0], "left")
        place = np.arange(len(rows)) - first
        self.rows = rows[place < self.top]
        full = rows[place == self.top - 1]
        self.least[full[:, 0]] = -full[:, 1]


_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("item", "doc_id", "score")])


def _scores(step: C.TextStep, automaton, postings: Postings, weights: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """[document, item] scores of a step, in 64-bit integers."""
    n, found = _scan(step, automaton)
    lengths = np.array([25 + (75 * x * n_docs) // all_terms for x in n.tolist()], np.int64)
    many = np.array(list(map(len, found)), np.int64)
    term = np.fromiter(chain.from_iterable(found), np.int64)
    tf = np.fromiter(chain.from_iterable(f.values() for f in found), np.int64)
    doc = np.repeat(np.arange(step.n), many)
    part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * lengths[doc]))
    first = postings.first[term]
    spread = postings.first[term + 1] - first
    at = np.arange(int(spread.sum())) + np.repeat(first - np.concatenate([np.zeros(1, np.int64), np.cumsum(spread)[:-1]]), spread) if len(term) else np.zeros(0, np.int64)
    out = np.zeros(step.n * len(postings.items), np.int64)
    np.add.at(out, np.repeat(doc, spread) * len(postings.items) + postings.item[at], np.repeat(part, spread) * postings.repeats[at])
    return out.reshape(step.n, len(postings.items))


def _search_block(texts: DataFrame, rows: list, top: int) -> DataFrame:
    """(item, doc_id, score): the best of each task for each item of a block."""
    spark = texts.sparkSession.sparkContext
    shared, label = spark.broadcast(Postings(rows)), uuid.uuid4().hex
    stats = term_statistics(texts, shared, label)
    n_docs, all_terms = stats.get(DOCUMENTS, 0), max(stats.get(ALL_TERMS, 0), 1)
    weigh = lambda df: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    weights = spark.broadcast(np.array([weigh(stats.get(i, 0)) for i in range(len(shared.value.terms))], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = shared.value
        automaton = _automaton(label, postings.terms)
        best = _Best(len(postings.items), top)
        rows_at_once = max(1, CELLS // len(postings.items))
        for batch in batches:
            for cut in C.slices(batch, 1):
                for k in range(0, cut.num_rows, rows_at_once):
                    part = cut.slice(k, rows_at_once)
                    scores = _scores(C.TextStep(part.column(1)), automaton, postings, weights.value, n_docs, all_terms)
                    ids = part.column(0)
                    best.add(scores, ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy())
        item, minus, missing, ids = best.rows.T
        yield pa.RecordBatch.from_arrays([pa.array(np.array(postings.items, np.int64)[item]), pa.array(ids, mask=missing > 0), pa.array(-minus)], names=_FOUND.names)

    return texts.mapInArrow(run, _FOUND)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    Equal scores go by ascending id, missing ids last.  Every row of ``items`` is
    an item of its own, also where ids repeat or are null; every row of ``docs``
    is a document of its own.  Null and empty texts hold no terms: such items
    find nothing, such documents are not found.  Either table may be empty.
    Other columns are left out.  The whole of ``docs`` is scanned twice for each
    block of items, and the driver sees one block at a time.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    asked = C.materialise(asked.repartition(int(size // block_bytes) + 1).withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = C.materialise(item_blocks(asked, block_bytes), "item-terms")
    found = None
    for label in sorted(r.block for r in blocks.where(F.size("terms") > 0).select("block").distinct().collect()):
        rows = blocks.where((F.col("block") == label) & (F.size("terms") > 0)).drop("block").orderBy("item").collect()
        best = C.materialise(_search_block(texts, rows, top), "found")
        found = best if found is None else found.union(best)
    if found is None:
        found = docs.sparkSession.createDataFrame([], _FOUND)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.spark_partition_id() % SALTS)
    salted = salted.withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
with documents_terms as (
  select row_number() over () as r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) as terms
  from documents),
totals as (select count(*) filter (len(terms) > 0) as n_docs, sum(len(terms))::bigint as all_terms from documents_terms),
occurrences as (select r, term, count(*) as tf from (select r, unnest(terms) as term from documents_terms) group by all),
item_terms as (
  select item, item_id, term, count(*) as repeats
  from (select row_number() over () as item, item_id,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from benchmark)
  group by all),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from occurrences, totals where term in (select term from item_terms) group by term, n_docs),
lengths as (select r, doc_id, 25 + (75 * len(terms)::bigint * n_docs) // all_terms as m from documents_terms, totals where len(terms) > 0),
parts as (
  select o.r, o.term, w.w * ((1000000000 * o.tf) // (1000 * o.tf + 8 * l.m)) as part
  from occurrences o join weights w using (term) join lengths l using (r)),
scored as (select item, item_id, r, sum(repeats * part)::bigint as score from item_terms join parts using (term) group by all),
ranked as (
  select item_id, row_number() over (partition by item order by score desc, doc_id nulls last)::int as rank, doc_id, score
  from scored join lengths using (r) where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""


def brute_force(docs: list[tuple], items: list[tuple], top: int = TOP) -> list[tuple]:
    """The contract read literally, for tests: (item_id, rank, doc_id, score)."""
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    all_terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(chain.from_iterable(c for _, c in counted))
    out = []
    for item_id, text in items:
        asked = Counter(_terms(text))
        rows = []
        for i, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // max(all_terms, 1)
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item_id, n, None if missing else i, -minus) for n, (minus, missing, i) in enumerate(sorted(rows)[:top], 1)]
    return out
