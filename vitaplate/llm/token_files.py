"""Token-ID output: ORC files with integer run lengths, row indexes and Bloom filters.

Documents are dealt to shards by ranges of doc_id, each task encodes its sorted
documents and writes one ORC folder ``shard=k`` per range.  ORC stores the ids
as integer run lengths; row indexes and the Bloom filter on ``doc_id`` let a
lookup skip stripes and row groups, and stripes are read in parallel.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vitaplate.llm import common as C

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Parts whose ids a worker remembers in each of two generations.
REMEMBERED = 250_000
REMEMBERED_LENGTH = 40
#: Rows between two entries of the row index.
INDEX_STRIDE = 1000
STRIPE_BYTES = 64 << 20

FILE_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("shard", T.IntegerType())])


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary (fixed values): visible Latin-1 characters for themselves, the rest from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in seen]
    return {b: chr(b) if b in seen else chr(256 + others.index(b)) for b in range(256)}


class _Letters(dict):
    """The letters of each character's bytes, made when it is first met."""

    def __missing__(self, char: str) -> str:
        self[char] = out = "".join(map(_BYTE_LETTERS.__getitem__, char.encode()))
        return out


_BYTE_LETTERS = _byte_letters()
#: What the pre-tokeniser makes of a part without its exceptions: letters, digits or marks, with the space before them, and line ends.
_TOKEN = re.compile(r" ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w\s]|_)+|\n")
#: Its exceptions: clippings after an apostrophe, white space in runs or of other kinds.
_EXCEPTION = re.compile(r"'|\s\s|[^\S \n]")
#: Several line ends in a row.
_LINE_ENDS = re.compile(r"(\n\n+)")


def _kinds() -> bytes:
    """A kind for each byte: a for letters, digits and parts of other characters, s for spaces, n for line ends, p for full stops and commas, m for marks, w for the rest."""
    out = bytearray(b"w" * 32 + b"m" * 96 + b"a" * 128)
    for c in range(128):
        if chr(c).isalnum():
            out[c] = ord("a")
    out[0x20], out[0x0A], out[0x2E], out[0x2C], out[0x7F] = b"snppw"
    return bytes(out)


_KINDS = _kinds()
#: Neighbours that the pre-tokeniser could join or treat apart.
_MEETINGS = (b"w", b"ss", b"sn", b"ns", b"nn", b"mp", b"pp", b"pm", b"sp")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class _Remembered(dict):
    """Ids of parts, learnt when they are first met; parts that were not met for a generation are forgotten."""

    def __init__(self, learn):
        self.learn = learn
        self.before: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            ids = self.learn(part)
        if len(part) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Encoder:
    """Whole texts to token ids, with the ids of frequent parts remembered.

    The vocabulary's pre-tokeniser always cuts before a space that a visible
    character follows, around a line end that stands alone, and before a full
    stop or comma that no other mark touches.  A text is cut at all of these
    places if such marks and spaces always stand alone in it, else before spaces;
    a text where white space follows a space is encoded whole.  The parts are
    encoded on their own: a new part without exceptions is cut further as the
    pre-tokeniser does, and each new piece goes straight to the vocabulary's
    merges.  Parts and pieces are remembered alike.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merges = self.tokenizer.model.tokenize
        self.letters = _Letters()
        self.known = _Remembered(self._part)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _token(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # all but the space stand for themselves
            spelt = piece.replace(" ", _BYTE_LETTERS[0x20])
        else:
            spelt = "".join(map(self.letters.__getitem__, piece))
        ids = [t.id for t in self.merges(spelt)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        if not part:
            return b""
        if part[1:].isalpha() and (part[0] == " " or part[0].isalpha()):
            return self._token(part)
        pieces: list[str] = []
        for lines in _LINE_ENDS.split(part):
            if lines[:2] == "\n\n":
                pieces.append(lines)
            elif lines:
                found = [] if _EXCEPTION.search(lines) else _TOKEN.findall(lines)
                # digits of other scripts and numerals that are no letters are left to the library
                if sum(map(len, found)) != len(lines) or not all(map(_plain, found)):
                    return self._whole(part)
                if pieces:  # the last of several line ends before a visible character stands alone
                    pieces[-1:] = [pieces[-1][1:], "\n"]
                pieces += found
        if len(pieces) == 1:
            return self._token(part)
        return b"".join([self.known[p] for p in pieces])

    @staticmethod
    def cut(text: str) -> list[str]:
        """Parts of the text that can be encoded on their own (some may be empty)."""
        kinds = text.encode().translate(_KINDS)
        alone = not any(m in kinds for m in _MEETINGS)
        if alone and (text.isascii() or all(c.isalpha() for c in set(text) if c > "\x7f")):
            return text.replace(" ", "\0 ").replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n\0").split("\0")
        first, *rest = text.split(" ")
        if any(not p or p[0].isspace() for p in rest):
            return [text]
        return [first, *[" " + p for p in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian 32-bit integers, END_ID after its last."""
        end = END_ID.to_bytes(4, "little")
        ids = self.known.__getitem__
        return [b"".join(map(ids, self.cut(t))) + end for t in texts]


def _plain(piece: str) -> bool:
    """Whether a piece is of one kind for the pre-tokeniser as well."""
    return not piece[-1].isalnum() or piece.isascii() or piece.lstrip(" ").isalpha()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_shards(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` with ``shard``: ascending ranges of doc_id, by cut points from an id-only scan (null ids first)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("i"))
    steps = [k / shards for k in range(1, shards)]
    cuts = ids.agg(F.percentile_approx("i", F.array(*map(F.lit, steps)), F.lit(20 * shards))).first()[0] if steps else None
    cuts = sorted(set(cuts or []))
    if not cuts:
        return docs.withColumn("shard", F.lit(0))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    number = F.size(F.filter(bounds, lambda c: c <= F.col("doc_id")))
    return docs.withColumn("shard", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(number).cast("int"))


def write_token_files(docs: DataFrame, path: str, text_col: str = "text", shards: int | None = None, vocabulary: str = VOCABULARY) -> None:
    """Encode every whole text and write ``path/shard=k/*.orc`` in ascending doc_id order.

    Columns: ``doc_id``, ``ids`` (token ids, END_ID last).  Null and empty texts
    hold END_ID alone.  Repeated ids stay as rows of their own, ordered by their
    token ids.  An empty table writes no shard.  Other columns are left out.
    """
    spark = docs.sparkSession
    n = shards or 2 * C.parallelism(spark)
    rows = id_shards(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary_path(vocabulary))
        for batch in batches:
            for part in C.slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                coded = encoder.encode(texts)
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values), part.column(2)], names=FILE_SCHEMA.names)

    # the writer needs rows by shard, which this order gives it: no other sort follows
    ordered = rows.repartitionById(n, "shard").mapInArrow(run, FILE_SCHEMA).sortWithinPartitions("shard", "doc_id", "ids")
    writer = ordered.write.partitionBy("shard").mode("errorifexists")
    writer.options(**{
        "compression": "zstd",
        "orc.create.index": "true",
        "orc.row.index.stride": str(INDEX_STRIDE),
        "orc.stripe.size": str(STRIPE_BYTES),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, ids, shard) of written token files; stripes are read in parallel and filters on doc_id prune them."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents; row indexes and Bloom filters prune the rest."""
    return read_token_files(spark, path).where(F.col("doc_id").isin([int(i) for i in ids]))


_DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    ``start`` counts the ids of all documents before it: a running sum within
    its shard, on top of the totals of earlier shards (one row per shard).
    """
    rows = read_token_files(spark, path)
    schema = T.StructType([FILE_SCHEMA["doc_id"], FILE_SCHEMA["shard"], *_DIGEST])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    each = C.materialise(rows.mapInArrow(run, schema), "token-digest")
    # one row per shard: its total, then the totals before it
    totals = each.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    inside = Window.partitionBy("shard").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    started = each.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return started.join(before, "shard").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_files(docs: DataFrame, label: str = "token-files") -> DataFrame:
    """Write the token files to a new shared folder and return their digest (the contract of op6)."""
    path = C.scratch_path(docs.sparkSession, label)
    write_token_files(docs, path)
    return token_digest(docs.sparkSession, path)
