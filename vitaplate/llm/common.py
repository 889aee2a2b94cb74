"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.functions.ranking import _WRITTEN
from vitaplate.session import ensure_checkpoint_dir

#: Bytes of text that one step of a task holds as numpy arrays (a longer document is a step of its own).
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared checkpoint folder (not created)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    It cuts the lineage (nothing dies with an executor) and a table that is
    read more than once is computed once.  ``release_materialised`` deletes it with the others of the session.
    """
    path = scratch_path(df.sparkSession, label)
    _WRITTEN.setdefault(id(df.sparkSession), []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add (its results replace them)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def filtered(docs: DataFrame, names: list[str], keep) -> DataFrame:
    """The rows of ``docs`` that ``keep`` leaves, with the columns of ``docs``.

    ``keep`` adds columns called ``names`` and drops rows; columns of ``docs`` with such names are put aside meanwhile.
    """
    taken = {n.lower() for n in names}
    aside = {c: f"_aside_{i}_" for i, c in enumerate(docs.columns) if c.lower() in taken}
    kept = keep(docs.withColumnsRenamed(aside))
    return kept.select(*[kept[aside.get(c, c)].alias(c) for c in docs.columns])


def crc_mod(doc_id: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def add_columns(df: DataFrame, fields: list[T.StructField], text_col: str, step) -> DataFrame:
    """Append ``fields``, computed from ``text_col`` by Arrow steps of bounded size.

    ``step(texts, batch)`` gets a numpy view of the texts (see ``TextStep``) and
    returns one Arrow array per field.  Columns of the same names are replaced.
    """
    base = without(df, [f.name for f in fields])
    schema = T.StructType([*base.schema.fields, *fields])
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                new = step(TextStep(part.column(at)))
                arrays = [*part.columns, *new]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return base.mapInArrow(run, schema)


class TextStep:
    """UTF-8 bytes and offsets of an Arrow string column; null texts are empty."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = column.fill_null("")
        self.n = len(column)
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + self.n + 1]
        self.data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and self.n else np.zeros(0, np.uint8)
        self.offsets = (off - off[0]).astype(np.int64)

    def doc_bytes(self, i: int) -> np.ndarray:
        """The bytes of text ``i``."""
        return self.data[self.offsets[i] : self.offsets[i + 1]]


def slices(batch: pa.RecordBatch, at: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the text column ``at`` passes ``limit`` bytes."""
    if batch.num_rows == 0:
        return
    column = batch.column(at)
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + batch.num_rows + 1].astype(np.int64)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


_RNG = np.random.default_rng(20240613)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, STEP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, np.uint64(base))
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered_table(word: np.ndarray) -> np.ndarray:
    """Per byte value a random 64-bit number: 0 for non-word bytes, A-Z as a-z."""
    t = _BYTE.copy()
    t[65:91] = t[97:123]
    t[~word] = 0
    return t


def word_hashes(step: TextStep, word: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the step's texts, and each text's first word number (n + 1 entries).

    ``word`` marks the byte values of words *after* lower-casing A-Z; ``values`` is ``lowered_table``.
    """
    data, offsets = step.data, step.offsets
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(step.n + 1, np.int64)
    inside = word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    up, down = _powers(len(data))
    sums = np.add.reduceat(values[data] * up, starts)
    return mix64(sums * down[starts]), first
