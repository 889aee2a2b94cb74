"""Importance resampling towards a target distribution, by distributed quickselect.

1. Features (runs of one and two words) fall into hash buckets; both corpora are
   counted per bucket, each task adding up one array of bucket counts.
2. A bucket's gain is the scaled log ratio of its share in the target to its share
   in the documents.  A second reading scores every text from the array of gains;
   seeded Gumbel noise makes the highest scores a draw without replacement.
3. The k-th composite key (score downwards, then doc_id) is found by quickselect:
   a round draws random pivot keys among the rows still in question, counts the
   keys below and equal to each in one aggregate, and narrows to the gap that
   holds the k-th.  Nothing is sorted; a round reads three narrow columns.
4. The winners alone are sorted, by range partitions, and numbered.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.functions.ranking import sequence_index
from vitaplate.llm import common as C

BUCKETS = 10_000
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
#: Percent of the eligible documents that are drawn.
PERCENT = 25
SEED = 7
#: Pivot keys of a round of the quickselect.
PIVOTS = 24
#: Words up to so many bytes are hashed side by side, longer ones by themselves.
SHORT = 32

#: Word bytes: 0-9, a-z after lower-casing A-Z, everything outside ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.uint32(zlib.crc32(b" "))
_BYTE = np.uint32(255)
_EIGHT = np.uint32(8)


@cache
def _byte_step() -> np.ndarray:
    """What one zero byte makes of each low byte of a crc32 register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1)).astype(np.uint32)
    return t


@cache
def _shifts() -> np.ndarray:
    """[n, k, b]: byte b at place k of a crc, moved on by n zero bytes; the crc of a joined text is the moved crc of its first part xor that of the second."""
    step = _byte_step()
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(SHORT):
        out[n + 1] = step[out[n] & _BYTE] ^ (out[n] >> _EIGHT)
    return out


def word_crcs(step: C.TextStep) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word lengths, crc32 of each word) of the step's texts."""
    data = _LOWER[step.data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(0, np.uint32)
    inside = WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = step.offsets[:-1][step.offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    stops = inside.copy()  # the last byte of a word: a word begins or none goes on behind it
    stops[:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(stops) + 1 - starts
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths, sorted_starts = lengths[order], starts[order]
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    table = _byte_step()
    long = int(np.searchsorted(-sorted_lengths, -SHORT, "left"))
    for p in range(min(SHORT, int(sorted_lengths[0]) if len(starts) else 0)):
        n = int(np.searchsorted(-sorted_lengths, -p, "left"))
        now = crc[long:n]
        crc[long:n] = table[(now ^ data[sorted_starts[long:n] + p]) & _BYTE] ^ (now >> _EIGHT)
    crc = ~crc
    for i in range(long):
        a = sorted_starts[i]
        crc[i] = zlib.crc32(data[a : a + sorted_lengths[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return data, starts, lengths, out


def feature_buckets(step: C.TextStep, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, single, pairs, paired): each text's first word number, the words' buckets, those of the runs that start at each word but the last, and whether such a run stays in one text."""
    data, starts, lengths, crc = word_crcs(step)
    first = np.searchsorted(starts, step.offsets).astype(np.int64)
    single = (crc % np.uint32(buckets)).astype(np.int64)
    if len(starts) < 2:
        return first, single, np.zeros(0, np.int64), np.zeros(0, bool)
    head, tail, size = crc[:-1], crc[1:], lengths[1:]
    spaced = _byte_step()[head & _BYTE] ^ (head >> _EIGHT) ^ _SPACE
    moved, n = _shifts(), np.minimum(size, SHORT)
    joined = tail.copy()
    for k in range(4):
        joined ^= moved[n, k, (spaced >> np.uint32(8 * k)) & _BYTE]
    for i in np.flatnonzero(size > SHORT).tolist():
        a = starts[i + 1]
        joined[i] = zlib.crc32(b" " + data[a : a + size[i]].tobytes(), int(head[i]))
    paired = np.ones(len(starts) - 1, bool)
    last = first[1:-1] - 1
    paired[last[(last >= 0) & (last < len(paired))]] = False
    return first, single, (joined % np.uint32(buckets)).astype(np.int64), paired


_COUNTS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
#: Stands for the number of documents that may be drawn, beside the buckets.
ELIGIBLE = -1


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS) -> dict[int, int]:
    """Features of all texts per bucket, and under ELIGIBLE the texts of at least ``least_words`` words: ``buckets`` + 1 numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, eligible = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for part in C.slices(batch, 0):
                first, single, pairs, paired = feature_buckets(C.TextStep(part.column(0)), buckets)
                total += np.bincount(single, minlength=buckets)
                total += np.bincount(pairs[paired], minlength=buckets)
                eligible += int((np.diff(first) >= least_words).sum())
        held = np.flatnonzero(total)
        names = [*held.tolist(), ELIGIBLE]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([*total[held].tolist(), eligible], pa.int64())], names=_COUNTS.names)

    sums = texts.select(text_col).mapInArrow(run, _COUNTS).groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r.bucket: r.n for r in sums.collect()}


def bucket_gains(documents: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    all_s = sum(n for b, n in documents.items() if b != ELIGIBLE)
    all_t = sum(n for b, n in target.items() if b != ELIGIBLE)
    gain = lambda b: math.floor(1000 * math.log(float((target.get(b, 0) + 1) * (all_s + buckets)) / float((documents.get(b, 0) + 1) * (all_t + buckets))))
    return np.array([gain(b) for b in range(buckets)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Scaled Gumbel noise of an id; a missing id counts as the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_features", "weight", "score")])


def score_documents(docs: DataFrame, gains: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score) of every row, from the array of gains."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, 1):
                first, single, pairs, paired = feature_buckets(C.TextStep(part.column(1)), buckets)
                gain = shared.value[single]
                gain[:-1] += np.where(paired, shared.value[pairs], 0)
                sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain)])
                words = np.diff(first)
                n = np.maximum(2 * words - 1, 0)
                weight = (sums[first[1:]] - sums[first[:-1]]) // np.maximum(n, 1)
                ids = part.column(0)
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(weight), pa.array(score)], names=_SCORED.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCORED)


def _key(parts: dict | None = None) -> Column:
    """The composite key of a row, or of a row of values: higher scores first, then smaller ids, missing ids last."""
    if parts is None:
        return F.struct((-F.col("score")).alias("minus"), F.col("doc_id").isNull().cast("int").alias("missing"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"))
    return F.struct(F.lit(parts["minus"]).cast("long").alias("minus"), F.lit(parts["missing"]).cast("int").alias("missing"), F.lit(parts["id"]).cast("long").alias("id"))


def quickselect(keyed: DataFrame, k: int, pivots: int = PIVOTS) -> dict | None:
    """The k-th smallest ``key`` of ``keyed`` (equal keys count as often as they occur); None if there are fewer.

    The driver sees ``pivots`` keys and their counts a round, whatever the size.
    """
    below, low, high = 0, None, None
    for turn in range(10_000):
        rest = keyed
        if low is not None:
            rest = rest.where(F.col("key") > _key(low))
        if high is not None:
            rest = rest.where(F.col("key") < _key(high))
        drawn = rest.orderBy(F.xxhash64("key.id", "key.minus", F.lit(turn)), "key").limit(pivots).collect()
        keys = sorted({tuple(r.key) for r in drawn})
        if not keys:
            return None
        tries = [dict(zip(("minus", "missing", "id"), x, strict=True)) for x in keys]
        # each row's gap between the pivots, and whether it is the pivot at the gap's upper end
        sought = F.array(*map(_key, tries))
        gap = rest.select(F.size(F.filter(sought, lambda p: p < F.col("key"))).alias("gap"), F.array_contains(sought, F.col("key")).alias("same"))
        counts = {(r.gap, r.same): r["count"] for r in gap.groupBy("gap", "same").count().collect()}
        for i, p in enumerate(tries):
            less = below + counts.get((i, False), 0)
            if less >= k:
                high = p
                break
            below = less + counts.get((i, True), 0)
            if below >= k:
                return p
            low = p
    raise RuntimeError("quickselect did not end")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    floor(percent * N / 100) of the N rows of at least ``least_words`` words are
    drawn, those of the highest scores; ``rank`` numbers them from 1, ties by
    ascending id, missing ids last, and is null for the rest.  Rows that repeat an
    id are rows of their own; of those alike in score and id as many are drawn as
    fit.  Null and empty texts have no features, weight 0, and are never drawn.
    Without documents there are no rows, without target texts every bucket has
    its smoothed share alone.  Other columns are left out.
    """
    seen = bucket_counts(docs, text_col, buckets, least_words)
    gains = bucket_gains(seen, bucket_counts(target, text_col, buckets, least_words), buckets)
    scored = C.materialise(score_documents(docs, gains, seed, id_col, text_col), "scored")
    k = percent * seen.get(ELIGIBLE, 0) // 100
    eligible = F.col("n_features") >= 2 * least_words - 1
    no_rank = F.lit(None).cast("long").alias("rank")
    last = quickselect(scored.where(eligible).select(_key().alias("key")), k) if k else None
    if last is None:
        return scored.select("*", no_rank)
    up_to = eligible & (_key() <= _key(last))
    # numbered by columns without nulls, which the numbering's pandas pass would make floats
    winners = scored.where(up_to).select("n_features", "weight", "score", _key().alias("key")).select("n_features", "weight", "score", "key.*")
    ranked = sequence_index(winners, ["minus", "missing", "id", "n_features"], name="place")
    place = F.when(F.col("place") < k, F.col("place") + 1).alias("rank")
    doc_id = F.when(F.col("missing") == 0, F.col("id")).alias("doc_id")
    return ranked.select(doc_id, "n_features", "weight", "score", place).union(scored.where(~up_to).select("*", no_rank))


ORACLE = r"""
with crc_table as (
  select list(v order by i) as t
  from (select i, list_reduce([i::ubigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a % 2 = 1 then xor(a // 2, 3988292384::ubigint) else a // 2 end) as v
        from range(256) as r(i))),
texts as (
  select 'd' as kind, row_number() over () as r, doc_id, text from documents
  union all select 'b', row_number() over (), null, text from benchmark),
worded as (
  select kind, r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as words
  from texts),
features as (
  select kind, r, unnest(words) as feature from worded
  union all
  select kind, r, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) from worded),
counted as (select kind, r, feature, count(*) as n from features group by all),
distinct_features as (select distinct feature from counted),
bucketed as (
  select feature,
         (xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(strlen(feature)), lambda i: ('0x' || substr(hex(encode(feature)), (2 * i + 1)::int, 2))::ubigint)),
                          lambda a, b: xor(a // 256, t[(xor(a, b) % 256 + 1)::bigint])), 4294967295::ubigint) % 10000)::int as bucket
  from distinct_features, crc_table),
totals as (
  select bucket, coalesce(sum(n) filter (kind = 'd'), 0)::bigint as s, coalesce(sum(n) filter (kind = 'b'), 0)::bigint as t
  from counted join bucketed using (feature) group by bucket),
sums as (select sum(s)::bigint as all_s, sum(t)::bigint as all_t from totals),
gains as (
  select bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::double / ((s + 1) * (all_t + 10000))::double))::bigint as gain
  from totals, sums),
weights as (
  select r, sum(n * gain)::bigint as gained, sum(n)::bigint as n_features
  from counted join bucketed using (feature) join gains using (bucket) where kind = 'd' group by r),
hashed as (
  select w.doc_id, coalesce(n_features, 0) as n_features, coalesce(floor(gained / n_features), 0)::bigint as weight,
         ('0x' || substr(sha256('7:' || coalesce(w.doc_id::varchar, '')), 1, 8))::bigint as h
  from worded w left join weights using (r) where w.kind = 'd'),
scored as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from hashed),
ranked as (select *, row_number() over (order by n_features >= 39 desc, score desc, doc_id nulls last, n_features) as place from scored)
select doc_id, n_features, weight, score,
       case when n_features >= 39 and place <= (select 25 * count(*) // 100 from scored where n_features >= 39) then place end as rank
from ranked
"""


def brute_force(docs: list[tuple], target: list[str | None], percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> list[tuple]:
    """The contract read literally, for tests: (doc_id, n_features, weight, score, rank)."""
    import re

    def features(text: str | None) -> list[int]:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return [zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    held = [features(t) for _, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for x in held:
        for b in x:
            s[b] += 1
    for text in target:
        for b in features(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (sum(s) + buckets)) / ((s[b] + 1) * (sum(t) + buckets)))) for b in set().union(*held)] if docs else []
    gain = dict(zip(set().union(*held), gain, strict=True)) if docs else {}
    rows = [[i, len(x), sum(gain[b] for b in x) // len(x) if x else 0] for (i, _), x in zip(docs, held, strict=True)]
    for row in rows:
        row.append(row[2] + noise(row[0], seed))
    able = sorted((r for r in rows if r[1] >= 2 * least_words - 1), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = {id(r): n for n, r in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r, drawn.get(id(r))) for r in rows]
