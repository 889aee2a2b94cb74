"""Document fingerprints: quartile bucket digests.

Byte triplets within five-byte windows are hashed into 256 buckets.  Each
bucket's count becomes two bits, by the quartile of all counts it lies in; the
length is coded on a logarithmic scale.  Two digests compare by a bounded
difference: the distance of their bucket codes plus that of their lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.llm import common as C

BUCKETS = 256
#: Offsets of a triplet's bytes from its window's first byte.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
#: Share of the largest possible difference that unlike texts reach; likeness is 0 there.
UNLIKE = 0.45
#: Weight of a step of the length code (an eighth of a doubling) against a step of a bucket's code.
LENGTH_WEIGHT = 2

_MIX = np.random.default_rng(7).permutation(256).astype(np.uint8)


def _counts(data: np.ndarray) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for salt, (a, b, c) in enumerate(TRIPLETS):
        n = len(data) - c
        if n <= 0:
            continue
        x = _MIX[data[a : a + n] ^ np.uint8(salt * 59)]
        x = _MIX[x ^ data[b : b + n]]
        x = _MIX[x ^ data[c : c + n]]
        counts += np.bincount(x, minlength=BUCKETS)
    return counts


def _length_code(n: int) -> int:
    """Eighths of doublings of the length, at most 255 (2^31 bytes)."""
    return min(255, round(8 * np.log2(n + 1)))


def fingerprint(data: bytes) -> str:
    """The digest of UTF-8 bytes: 2 hex digits of length code, 128 of bucket codes (2 bits each).

    A text of fewer than three bytes has no triplet; its bucket codes are zeros.
    Equal texts have equal digests.
    """
    counts = _counts(np.frombuffer(data, np.uint8))
    ordered = np.sort(counts)
    quartiles = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    body = codes[:, 0] | (codes[:, 1] << 2) | (codes[:, 2] << 4) | (codes[:, 3] << 6)
    return f"{_length_code(len(data)):02x}{body.astype(np.uint8).tobytes().hex()}"


_DISTANCE = np.zeros((256, 256), np.uint8)
for _shift in (0, 2, 4, 6):
    _code = (np.arange(256) >> _shift) & 3
    _DISTANCE += np.abs(_code[:, None] - _code[None, :]).astype(np.uint8)


def likeness(a: str | None, b: str | None) -> float | None:
    """1 for equal digests, 0 for unlike ones; null with a null."""
    if a is None or b is None:
        return None
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    difference = int(_DISTANCE[x[1:], y[1:]].sum()) + LENGTH_WEIGHT * abs(int(x[0]) - int(y[0]))
    return max(0.0, 1.0 - difference / (UNLIKE * 3 * BUCKETS))


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the digest of every whole text (null: of the empty text); a column of that name is replaced."""

    def step(texts: C.TextStep) -> list[pa.Array]:
        return [pa.array([fingerprint(texts.doc_bytes(i).tobytes()) for i in range(texts.n)], pa.string())]

    return C.add_columns(docs, [T.StructField(name, T.StringType())], text_col, step)


def with_successor(docs: DataFrame, columns: list[str], run, schema: T.StructType, shards: int | None = None) -> DataFrame:
    """Apply ``run(rows)`` to runs of rows in ascending (doc_id, text) order, each run followed by its successor row.

    ``rows`` iterates over (values, is_guard) in order; the one guard row at a
    run's end is the first row of the next run (after the last run: the first
    of all), and it belongs to that one.  Cut points are doc_ids of the table,
    so a run's first row is known from its id alone: one shuffle, and a run is
    read as a stream.  A null id orders first.
    """
    spark = docs.sparkSession
    shards = shards or 4 * C.parallelism(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("i"))
    steps = [k / shards for k in range(1, shards)]
    row = ids.agg(F.percentile_approx("i", F.array(*map(F.lit, steps)), F.lit(20 * shards)).alias("cuts"), F.min("i").alias("low"), F.max(F.col("i").isNull()).alias("nulls")).first()
    # the first run starts with the lowest id; nulls come before all
    cuts = sorted({c for c in row.cuts or [] if c != row.low})
    first = None if row.nulls else row.low
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    number = F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    own = F.coalesce(F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(number), F.lit(0))
    places = [F.struct(own.alias("shard"), F.lit(0).alias("guard"))]
    if cuts:
        opens = F.col("doc_id").isin(cuts)
        places.append(F.when(opens, F.struct((own - 1).alias("shard"), F.lit(1).alias("guard"))))
    places.append(F.when(F.col("doc_id").eqNullSafe(F.lit(first).cast("long")), F.struct(F.lit(len(cuts)).alias("shard"), F.lit(2).alias("guard"))))
    dealt = docs.select(*columns, F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("p")).select(*columns, "p.shard", "p.guard")
    ordered = dealt.repartition(C.parallelism(spark), "shard").sortWithinPartitions("shard", "guard", "doc_id", *[c for c in columns if c != "doc_id"])
    return ordered.mapInArrow(run, schema)


EDITED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def _edited_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, shard, guard) in order to rows of EDITED."""
    out: list[tuple] = []
    held = None  # the row that waits for its successor

    def made(row, successor):
        doc_id, text, print_ = row
        _, following, next_print = successor
        n = len(text)
        k = n // 4
        changed = (text[: n - k] + following[:k]).encode()
        edited = fingerprint(changed)
        return doc_id, n, hashlib.sha256(changed).hexdigest(), print_, edited, likeness(print_, edited), likeness(print_, next_print)

    def flushed():
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()), strict=True)], names=EDITED.names)

    for batch in batches:
        for part in C.slices(batch, 1):
            for doc_id, text, shard, guard in zip(*(c.to_pylist() for c in part.columns[:4]), strict=True):
                if guard and held is None:
                    continue  # a repeat of the guard's id: the run's last row has its successor
                text = text or ""
                row = doc_id, text, fingerprint(text.encode())
                if held is not None:
                    out.append(made(held, row))
                held = None if guard else row
            if len(out) >= 512:
                yield flushed()
                out = []
    if out:
        yield flushed()


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness (the contract of op1).

    The edited text replaces the last quarter of the code points by the first
    of the next document's.  Null ids come first, equal ids go by their text;
    a lone document is its own successor; an empty table gives no rows.
    """
    return with_successor(docs.select("doc_id", "text"), ["doc_id", "text"], _edited_rows, EDITED)
