"""MinHash near duplicates by a multi-index Hamming join.

Sets of word shingles link when their Jaccard similarity reaches a percentage.
Equal sets are one class from the start; the join runs over classes.

1. A class's signature has 60 symbols of 8 bits, the low bits of 60 minima.  Sets
   of similarity J agree in each symbol with a probability of J, and a little more.
2. Multi-index: the signature is cut into 10 chunks of 6 symbols.  Signatures that
   differ in at most 19 symbols have, by the pigeonhole, a chunk that differs in
   one symbol at most.  Each chunk enumerates that error: once without each of its
   symbols, and classes that agree in the other five share a slot.  All pairs up
   to that distance meet, whatever the errors.  A pair at 80 percent misses all
   slots with a chance of 0.345^10, two in 100,000.
3. Each slot ties its members to its least class.  Ties whose sizes and signatures
   are near enough (FAR) are confirmed on the full sets, and contracted.
4. What a slot still holds of different components is compared in cells: members
   of its main component against the others, and the others among each other, in
   blocks of bounded size.  Classes stand in bins of bounded size with others that
   are tied to the same class; a class that finds near enough signatures asks
   for their bins, not for each of them.
5. A bin and the classes that ask for it count all their intersections on the
   full sets by matrix products, and send one link for each component met.  So
   pairs within a component are never formed, and pairs that do not link are
   never sent.
6. Components of all confirmed links.

Shingles and classes are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.llm import common as C
from vitaplate.llm.graph import HUBS, components, join_split

#: Word bytes: everything but the space and 09-0D.
WORD = np.ones(256, bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
VALUES = C.lowered_table(WORD)
SHINGLE = 2
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
CHUNKS = 10
CHUNK = 6
SYMBOLS = CHUNKS * CHUNK
#: Signatures that differ in more symbols are no candidates: at 80 percent a pair differs in more than 32 of 60 once in 10^9.
FAR = 32
#: Members of a bin, and of a group that asks for a bin (on average; they are dealt by hash).
BLOCK = 256
#: Members of a block of a slot: a cell holds two blocks of the slots of its slice, 60 / SLICES of them where a family shares all.
SLOT_BLOCK = 1024
SLICES = 6
#: Shingles of all sets of a bin.
BIN_SHINGLES = 400_000
#: Columns of one step of the intersection product.
PRODUCT_WIDTH = 4096
#: Bits of the prefilter for the second reading of the texts (2 MB, whatever the input).
FILTER_BITS = 24

_RNG = np.random.default_rng(1997)
_XOR, _TIMES = (_RNG.integers(0, 2**63, SYMBOLS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_sets(step: C.TextStep, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle make one, no words make none."""
    words, first = C.word_hashes(step, WORD, VALUES)
    grams = C.mix64(words)
    parts = grams
    for k in range(1, shingle):
        grams = C.mix64(grams[:-1] * np.uint64(3) + parts[k:]) if len(grams) > 1 else grams[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in parts[a:b]:
                whole = C.mix64(whole * np.uint64(5) + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[set, symbol] signatures of sets that are not empty."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SYMBOLS), np.uint8)
    for j in range(SYMBOLS):
        out[:, j] = np.minimum.reduceat((flat ^ _XOR[j]) * _TIMES[j], first) >> np.uint64(24)
    return out


def slots(signature: np.ndarray) -> np.ndarray:
    """[set, slot] 64-bit keys: each chunk without each of its symbols."""
    wide = signature.astype(np.uint64).reshape(-1, CHUNKS, CHUNK)
    places = np.uint64(8) * np.arange(CHUNK, dtype=np.uint64)
    whole = (wide << places).sum(axis=2, dtype=np.uint64)
    rest = whole[:, :, None] - (wide << places)
    name = (np.arange(CHUNKS * CHUNK, dtype=np.uint64).reshape(CHUNKS, CHUNK) + np.uint64(1)) << np.uint64(48)
    return C.mix64(rest + name).reshape(len(signature), CHUNKS * CHUNK)


def _class_keys(sets: list[np.ndarray]) -> list[int | None]:
    """One 64-bit key for equal sets; none for the empty set."""
    return [int(C.mix64(np.array([C.mix64(s).sum() + np.uint64(len(s))]))[0].astype(np.int64)) if len(s) else None for s in sets]


_DESCRIBED = [T.StructField("n", T.LongType()), T.StructField("key", T.LongType()), T.StructField("sig", T.BinaryType())]


def _describe(step: C.TextStep, shingle: int) -> list[pa.Array]:
    sets = shingle_sets(step, shingle)
    held = [s for s in sets if len(s)]
    sigs = iter(signatures(held) if held else ())
    return [
        pa.array([len(s) for s in sets], pa.int64()),
        pa.array(_class_keys(sets), pa.int64()),
        pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary()),
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SYMBOLS)


_SLOTS = T.StructType([T.StructField("slot", T.LongType()), T.StructField("key", T.LongType())])


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sig) to (slot, key)."""
    for batch in batches:
        keys = np.repeat(batch.column(0).to_numpy(), CHUNKS * CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(slots(_matrix(batch.column(1))).ravel().view(np.int64)), pa.array(keys)], names=_SLOTS.names)


_PAIRS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _near(n, m, distance, percent: int):
    """Whether sets of n and m shingles and so many different symbols can link."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (distance <= FAR)


def _near_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sizes and signatures are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n, m, a, b = batch.columns
            distance = (_matrix(a) != _matrix(b)).sum(axis=1)
            keep = pa.array(_near(n.to_numpy(), m.to_numpy(), distance, percent))
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], names=_PAIRS.names)

    a = classes.select(F.col("key").alias("u"), F.col("n").alias("un"), F.col("sig").alias("us"))
    b = classes.select(F.col("key").alias("v"), F.col("n").alias("vn"), F.col("sig").alias("vs"))
    sized = 100 * F.least("un", "vn") >= percent * F.greatest("un", "vn")
    return pairs.join(a, "u").join(b, "v").where(sized).select("u", "v", "un", "vn", "us", "vs").mapInArrow(run, _PAIRS)


def _by_groups(names: tuple[str, ...], work):
    """Rows sorted by ``names`` to what ``work`` yields for each group of them; a group that a batch cuts is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if carried is None else pa.concat_tables([carried, rows])
            ids = np.stack([rows[c].to_numpy() for c in names])
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist()]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                yield from work(rows.slice(x, y - x).combine_chunks())
            carried = rows.slice(edges[-1])
        if carried is not None:
            yield from work(carried.combine_chunks())

    return run


_CELL = ("main", "kind", "a", "b", "slice")
_ASKED = T.StructType([T.StructField("key", T.LongType()), T.StructField("bin", T.LongType())])


def _ask(percent: int):
    """A cell's two blocks, slot by slot, to (key, bin): classes of side 0 and the bins where near enough ones of other components stand (side 1, or later ones of side 0)."""

    def work(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        slot, side, key, comp, n, bins = (cell[c].to_numpy() for c in ("slot", "side", "key", "comp", "n", "bin"))
        sig = _matrix(cell["sig"])
        out = set()
        edges = [0, *(np.flatnonzero(slot[1:] != slot[:-1]) + 1).tolist(), len(slot)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            left = x + np.flatnonzero(side[x:y] == 0)
            right = x + np.flatnonzero(side[x:y] == 1)
            right = right if len(right) else left
            step = max(1, 60_000 // max(len(right), 1))
            for k in range(0, len(left), step):
                some = left[k : k + step]
                far = (sig[some][:, None, :] != sig[right][None, :, :]).sum(axis=2)
                near = _near(n[some][:, None], n[right][None, :], far, percent) & (comp[some][:, None] != comp[right][None, :])
                near &= (side[right] == 1)[None, :] | (right[None, :] > some[:, None])
                i, j = np.nonzero(near)
                out.update(zip(key[some[i]].tolist(), bins[right[j]].tolist(), strict=True))
        if out:
            asked = np.array(sorted(out), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(asked[:, 0]), pa.array(asked[:, 1])], names=_ASKED.names)

    return work


def _profiles(classes: DataFrame, roots: DataFrame, ties: DataFrame) -> DataFrame:
    """(key, n, sig, comp, bin): classes with their component so far, in bins with those tied to the same class."""
    home = ties.groupBy("u").agg(F.min("v").alias("home"))
    named = classes.select("key", "n", "sig").join(roots, F.col("key") == F.col("node"), "left").join(home, F.col("key") == F.col("u"), "left")
    named = C.materialise(named.select("key", "n", "sig", F.coalesce("root", "key").alias("comp"), F.coalesce("home", "key").alias("home")), "homes")
    many = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BIN_SHINGLES)))
    sizes = named.groupBy("home").agg(many.alias("bins"), F.count(F.lit(1)).alias("members"))
    sized = join_split(named, sizes, "home", "members", max(1, named.count() // HUBS)).drop("members")
    return C.materialise(sized.withColumn("bin", F.xxhash64("home", F.pmod(F.xxhash64("key", F.lit(5)), F.col("bins")))).drop("home", "bins"), "profiles")


def _requests(shared: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """(key, bin): classes, and the bins that hold near enough classes of other components that share a slot with them."""
    named = C.materialise(shared.select("slot", "key").join(profiles.select("key", "comp", "bin"), "key"), "slot-members")
    each = named.groupBy("slot", "comp").agg(F.count(F.lit(1)).alias("members"))
    main = F.max(F.struct("members", "comp")).alias("main")
    mixed = each.groupBy("slot").agg(main, F.sum("members").alias("members"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    mixed = C.materialise(mixed.select("slot", F.col("main.comp").alias("main"), F.col("main.members").alias("mains"), (F.col("members") - F.col("main.members")).alias("others")), "mixed-slots")
    # all slots of a main component are cut into the same blocks, and a bin is never cut, so that a cell sees an asking class and a bin in all slots of a slice
    blocks = lambda n: F.ceil(F.max(n) / F.lit(SLOT_BLOCK)).cast("int")
    sizes = mixed.groupBy("main").agg(blocks("mains").alias("main_blocks"), blocks("others").alias("other_blocks"))
    rows = named.join(mixed.select("slot", "main").join(sizes, "main"), "slot")
    is_main = F.col("comp") == F.col("main")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("bin"), F.when(is_main, F.col("main_blocks")).otherwise(F.col("other_blocks"))).cast("int"))
    me = F.col("own")

    def cell(kind: int, a, b, side: int):
        return F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"))

    def numbered(n):
        return F.sequence(F.lit(0), n - 1)

    # the others ask (side 0) for bins of the main component (side 1), and among each other
    to_others = F.transform(numbered(F.col("other_blocks")), lambda k: cell(0, k, me, 1))
    to_main = F.transform(numbered(F.col("main_blocks")), lambda k: cell(0, me, k, 0))
    among = F.transform(numbered(F.col("other_blocks")), lambda k: F.when(k < me, cell(1, k, me, 1)).otherwise(cell(1, me, k, 0)))
    dealt = rows.select("slot", "main", "key", F.explode(F.when(is_main, to_others).otherwise(F.concat(to_main, among))).alias("cell")).select("slot", "main", "key", "cell.*")
    dealt = dealt.join(profiles, "key").withColumn("slice", F.pmod("slot", F.lit(SLICES)).cast("int")).select(*_CELL, "slot", "side", "key", "comp", "n", "sig", "bin")
    return dealt.repartition(*_CELL).sortWithinPartitions(*_CELL, "slot").mapInArrow(_by_groups(_CELL, _ask(percent)), _ASKED).distinct()


_OPENED = ("bin", "part")


def _open(percent: int):
    """A bin (side 1) and the classes that ask for it (side 0) to links (u, v): one of each asking class for each other component."""

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        side, key, comp = (group[c].to_numpy() for c in ("side", "key", "comp"))
        lists = group["shingles"].combine_chunks()
        ends = lists.offsets.to_numpy()
        n = np.diff(ends)
        row = np.repeat(np.arange(len(key)), n)
        tokens, column, often = np.unique(lists.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True, return_counts=True)
        use = often[column] > 1
        row, column = row[use], np.unique(column[use], return_inverse=True)[1]
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        asking, held = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        both = np.zeros((len(asking), len(held)), np.int64)
        width = int(column[-1]) + 1 if len(column) else 0
        for a in range(0, width, PRODUCT_WIDTH):
            i, j = np.searchsorted(column, [a, a + PRODUCT_WIDTH])
            m = np.zeros((len(key), min(PRODUCT_WIDTH, width - a)), np.float32)
            m[row[i:j], column[i:j] - a] = 1
            both += np.rint(m[asking] @ m[held].T).astype(np.int64)
        linked = 100 * both >= percent * (n[asking][:, None] + n[held][None, :] - both)
        i, j = np.nonzero(linked & (comp[asking][:, None] != comp[held][None, :]))
        first = {(u, c): v for u, c, v in zip(key[asking[i]].tolist(), comp[held[j]].tolist(), key[held[j]].tolist(), strict=True)}
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in first], pa.int64()), pa.array(list(first.values()), pa.int64())], names=_PAIRS.names)

    return work


def _bin_links(requests: DataFrame, profiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the asking classes and the bins' members, on the full sets."""
    parts = requests.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("parts"))
    parts = C.materialise(parts, "asked-bins")
    asking = requests.join(parts, "bin").select("bin", F.pmod(F.xxhash64("key", F.lit(11)), F.col("parts")).cast("int").alias("part"), "key", F.lit(0).alias("side"))
    held = profiles.select("key", "bin").join(parts, "bin").select("bin", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", F.lit(1).alias("side"))
    rows = asking.union(held).join(sets.join(profiles.select("key", "comp"), "key"), "key").select(*_OPENED, "side", "key", "comp", "shingles")
    return rows.repartition(*_OPENED).sortWithinPartitions(*_OPENED).mapInArrow(_by_groups(_OPENED, _open(percent)), _PAIRS)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the low FILTER_BITS of ``key`` that occurs: 2 MB at most on the driver."""
    low = F.col("key").bitwiseAND((1 << FILTER_BITS) - 1)
    words = keys.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63L as int))")).alias("b"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for w, b in words.toLocalIterator():
        out[w] = b
    return out.view(np.uint64)


def _sets_of(texts: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """(key, shingles) of the classes ``keys``, each once, from a second reading of the texts.

    A bitmap of fixed size drops most other texts inside the reading task; the join then settles membership.
    """
    bits = texts.sparkSession.sparkContext.broadcast(_bitmap(keys))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # copies of one task go once
        for batch in batches:
            for part in C.slices(batch, 0):
                sets = shingle_sets(C.TextStep(part.column(0)), shingle)
                names, held = [], []
                for key, s in zip(_class_keys(sets), sets, strict=True):
                    low = 0 if key is None else key & ((1 << FILTER_BITS) - 1)
                    if key is not None and key not in sent and (int(bits.value[low >> 6]) >> (low & 63)) & 1:
                        if len(sent) > 100_000:
                            sent.clear()
                        sent.add(key)
                        names.append(key)
                        held.append(s.view(np.int64))
                ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                flat = np.concatenate(held) if held else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=schema.names)

    once = texts.select("text").mapInArrow(run, schema).groupBy("key").agg(F.first("shingles").alias("shingles"))
    return once.join(keys, "key", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by their full sets."""
    a = sets.select(F.col("key").alias("u"), F.col("shingles").alias("us"))
    b = sets.select(F.col("key").alias("v"), F.col("shingles").alias("vs"))
    both = F.size(F.array_intersect("us", "vs"))
    linked = 100 * both >= percent * (F.size("us") + F.size("vs") - both)
    return pairs.join(a, "u").join(b, "v").where(linked).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Sets of ``shingle`` words link from ``percent`` percent of their union on;
    chunks and FAR are laid out for 80 percent and more.

    ``component_id`` is the smallest id that links reach, itself included, and
    ``kept`` whether it is the row's own.  Texts without words (null, empty, white
    space) are linked with nothing and are their own component.  Rows of equal
    text, repeated ids and null ids are rows of their own; null ids do not count
    as smallest unless a component has no other.  An empty table gives no rows.
    Other columns are left out.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = C.materialise(C.add_columns(texts, _DESCRIBED, "text", lambda step: _describe(step, shingle)).drop("text"), "signatures")
    worded = rows.where("key is not null")
    each = worded.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = C.materialise(each, "classes")

    # slots of several classes: each member is tied to the least one
    members = classes.select("key", "sig").mapInArrow(_slot_rows, _SLOTS)
    least = members.groupBy("slot").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("slot", "least")
    shared = C.materialise(members.join(C.materialise(least, "shared-slots"), "slot"), "shared-members")
    ties = shared.where("key <> least").select(F.col("key").alias("u"), F.col("least").alias("v")).distinct()
    ties = C.materialise(_near_pairs(ties, classes, percent), "near-ties")
    sets = C.materialise(_sets_of(texts, shared.select("key").distinct(), shingle), "sets")
    links = C.materialise(_confirmed(ties, sets, percent), "links")

    # what slots still hold of different components
    profiles = _profiles(classes, components(links), ties)
    requests = C.materialise(_requests(shared, profiles, percent), "requests")
    found = components(links.union(_bin_links(requests, profiles, sets, percent)))

    # the least id of each component, and back to the rows
    named = classes.select("key", "class_id").join(found, F.col("key") == F.col("node"), "left").select("key", "class_id", F.coalesce("root", "key").alias("root"))
    named = C.materialise(named, "named-classes")
    roots = named.join(named.groupBy("root").agg(F.min("class_id").alias("component_id")), "root").select("key", "component_id")
    done = worded.select("doc_id", F.col("n").alias("n_shingles"), "key").join(roots, "key").drop("key")
    wordless = rows.where("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return done.select(wordless.columns).union(wordless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
with recursive texts as (
  select row_number() over () as r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as words
  from documents),
shingled as (
  select r, doc_id, list_distinct(case when len(words) >= 2 then list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) else words end) as shingles
  from texts),
sized as (select r, doc_id, len(shingles)::bigint as n, list_sort(shingles) as shingles from shingled),
classes as (select min(r) as c, any_value(n) as n, shingles from sized where n > 0 group by shingles),
tokens as (select c, n, unnest(shingles) as token from classes),
often as (select token, count(*) as many from tokens group by token),
ordered as (select c, n, token, row_number() over (partition by c order by many, token) as place from tokens join often using (token)),
prefixes as (select c, n, token from ordered where place <= n - (80 * n + 99) // 100 + 1),
candidates as (
  select distinct a.c as a, b.c as b from prefixes a join prefixes b on a.token = b.token and a.c < b.c
  where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
counted as (
  select a, b, x.n as n, y.n as m, len(list_intersect(x.shingles, y.shingles)) as held
  from candidates join classes x on x.c = a join classes y on y.c = b),
links as (select a, b from counted where 100 * held >= 80 * (n + m - held)),
edges as (select a, b from links union select b, a from links),
reach as (select c as a, c as b from classes union select reach.a, edges.b from reach join edges on edges.a = reach.b),
member as (select s.r, s.doc_id, c.c from sized s join classes c on s.shingles = c.shingles),
least as (select reach.a as c, min(member.doc_id) as component_id from reach join member on member.c = reach.b group by 1)
select s.doc_id, s.n as n_shingles, case when s.n = 0 then s.doc_id else least.component_id end as component_id,
       s.doc_id is not distinct from case when s.n = 0 then s.doc_id else least.component_id end as kept
from sized s left join member using (r) left join least on least.c = member.c
"""
