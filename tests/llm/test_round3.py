"""Resampling, lexical search and the multi-index Hamming join against brute force and on awkward tables."""

from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm import edge
from vitaplate.llm import common as C
from vitaplate.llm import graph, hamming_join, jaccard, lexical, queries, resample


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=key)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", ["op11_quickselect_resampling", "op12_aho_corasick_search", "op13_hamming_near_duplicates"])
def test_query_matches_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF_SMALL)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.select(columns)) == sorted(want.fetchall(), key=key)


ITEMS = [(1, "one two words"), (2, None), (3, ""), (None, "ünïcode 你好 W5 w5"), (3, "mail, word1 word2; word3"), (7, "!!")]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


# --- resampling -----------------------------------------------------------------------------------

def test_word_crcs_of_long_and_joined_words():
    texts = ["Ab", "x" * 100 + " y " + "é" * 50, "", "a b", "1-2", "z" * 32 + " " + "q" * 33 + " " + "q" * 32]
    step = C.TextStep(pa.array(texts))
    first, single, pairs, paired = resample.feature_buckets(step)
    import re

    at = 0
    for i, t in enumerate(texts):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
        assert first[i + 1] - first[i] == len(w)
        assert [zlib.crc32(x.encode()) % 10000 for x in w] == single[at : at + len(w)].tolist()
        joined = [zlib.crc32(f"{a} {b}".encode()) % 10000 for a, b in zip(w, w[1:], strict=False)]
        assert joined == [b for b, ok in zip(pairs[at : at + len(w)], paired[at : at + len(w)], strict=True) if ok]
        at += len(w)


@pytest.mark.parametrize("percent, least", [(25, 20), (100, 1), (50, 2), (0, 1)])
def test_resampling_awkward_rows(spark, percent, least):
    got = rows_of(resample.resample(edge.frame(spark), items(spark), percent=percent, least_words=least))
    want = resample.brute_force([(r[0], r[1]) for r in edge.rows()], [t for _, t in ITEMS], percent=percent, least_words=least)
    assert got == sorted(want, key=key)


def test_resampling_ties_at_the_boundary(spark):
    docs = [(5, "same words here")] * 7 + [(None, "same words here")] * 4 + [(i, "other words here") for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = rows_of(resample.resample(df, items(spark), percent=40, least_words=1))
    assert got == sorted(resample.brute_force(docs, [t for _, t in ITEMS], percent=40, least_words=1), key=key)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 9))


def test_resampling_empty_tables(spark):
    assert resample.resample(edge.empty(spark), items(spark)).count() == 0
    got = resample.resample(edge.frame(spark), items(spark, []), least_words=1)
    assert got.count() == len(edge.TEXTS) and got.where("rank is not null").count() == 2


def test_quickselect_finds_every_rank(spark):
    rnd = random.Random(4)
    values = [(rnd.randint(-5, 5), rnd.randint(0, 3) or None) for _ in range(120)]
    keyed = spark.createDataFrame(values, "score long, doc_id long").select(resample._key().alias("key")).cache()
    want = sorted((-s, int(i is None), i or 0) for s, i in values)
    for k in (1, 2, 37, 60, 119, 120):
        assert tuple(resample.quickselect(keyed, k, pivots=5).values()) == want[k - 1]
    assert resample.quickselect(keyed, 121, pivots=5) is None
    keyed.unpersist()


# --- lexical search -------------------------------------------------------------------------------

@pytest.mark.parametrize("block_bytes", [1 << 20, 10])
def test_search_awkward_rows(spark, block_bytes):
    got = rows_of(lexical.search(edge.frame(spark), items(spark), top=3, block_bytes=block_bytes).select("item_id", "rank", "doc_id", "score"))
    want = lexical.brute_force([(r[0], r[1]) for r in edge.rows()], ITEMS, top=3)
    assert got == sorted(want, key=key)


def test_search_ties_and_repeated_rows(spark):
    docs = [(9, "a b"), (3, "a b"), (None, "a b"), (3, "a b"), (4, "b"), (5, "c")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = rows_of(lexical.search(df, items(spark, [(1, "a A a."), (2, "b")])).select("item_id", "rank", "doc_id", "score"))
    assert got == sorted(lexical.brute_force(docs, [(1, "a A a."), (2, "b")]), key=key)


def test_search_terms_are_whole(spark):
    """Terms that hold other terms, and neighbours that share a boundary."""
    docs = [(1, "she he her hers"), (2, "usher"), (3, "he-he_he"), (4, "HE HE")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(lexical.search(df, items(spark, [(1, "he"), (2, "she hers us")])).select("item_id", "rank", "doc_id", "score"))
    assert got == sorted(lexical.brute_force(docs, [(1, "he"), (2, "she hers us")]), key=key)
    assert {r[2] for r in got if r[0] == 1} == {1, 3, 4}


def test_search_empty_tables(spark):
    assert lexical.search(edge.empty(spark), items(spark)).count() == 0
    assert lexical.search(edge.frame(spark), items(spark, [])).count() == 0
    assert lexical.search(edge.frame(spark), items(spark, [(1, None), (2, "...")])).count() == 0


# --- multi-index Hamming join ---------------------------------------------------------------------

def test_near_duplicates_awkward_rows(spark):
    got = rows_of(hamming_join.near_duplicates(edge.frame(spark)))
    base = [(r[0], r[1]) for r in edge.rows()]
    ids = [(i if i is not None else 10**9, t) for i, t in base]
    want = [(None if i == 10**9 else i, n, None if c == 10**9 else c) for i, n, c in jaccard.brute_force(ids, 2, 80)]
    assert [r[:3] for r in got] == sorted(want, key=key)
    assert all(r[3] == (r[0] == r[2]) for r in got)
    assert hamming_join.near_duplicates(edge.empty(spark)).count() == 0


def near_texts(n, edits, words=60, seed=0):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randrange(edits)):
            t[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("block", [256, 7])
def test_near_duplicates_of_spread_groups(spark, monkeypatch, block):
    """Groups whose members link in chains, beside members that link with none, in blocks of several sizes."""
    monkeypatch.setattr(hamming_join, "BLOCK", block)
    monkeypatch.setattr(hamming_join, "SLOT_BLOCK", 2 * block)
    texts = near_texts(70, 12) + near_texts(40, 9, words=25, seed=1) + near_texts(30, 4, words=200, seed=2) + ["a b c", "a b c d", "c b a"]
    docs = list(enumerate(texts))
    random.Random(3).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = rows_of(hamming_join.near_duplicates(df))
    assert [r[:3] for r in got] == sorted(jaccard.brute_force(docs, 2, 80))


def test_all_pairs_within_the_signature_distance_share_a_slot():
    rng = np.random.default_rng(0)
    reach = 2 * hamming_join.CHUNKS - 1
    base = rng.integers(0, 256, (400, hamming_join.SYMBOLS), dtype=np.uint8)
    other = base.copy()
    for row in other:
        at = rng.choice(hamming_join.SYMBOLS, reach, replace=False)
        row[at] = row[at] + rng.integers(1, 256, reach, dtype=np.uint8)
    assert (hamming_join.slots(base) == hamming_join.slots(other)).any(axis=1).all()


def test_chance_of_missing_a_link_at_the_threshold():
    """Pairs at 80 percent that no slot holds: far below one in a thousand, over 2,000 pairs."""
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(2000):
        x = rng.integers(0, 2**63, 110, dtype=np.int64).astype(np.uint64)
        a, b = hamming_join.signatures([np.sort(x[:100]), np.sort(x[10:])])  # 90 of 110 in common: 82 percent
        missed += not (hamming_join.slots(a[None]) == hamming_join.slots(b[None])).any()
    assert missed <= 2


@pytest.mark.parametrize("hubs, few", [(1000, 0), (2, 0), (1000, 100_000)])
def test_components_with_hubs(spark, monkeypatch, hubs, few):
    monkeypatch.setattr(graph, "HUBS", hubs)
    monkeypatch.setattr(graph, "FEW", few)
    rnd = random.Random(6)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(200):
        for u, v in edges:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    assert got == root
    none = spark.createDataFrame([], "u long, v long")
    assert graph.components(none).count() == 0


def test_new_queries_keep_extra_columns_out(spark):
    docs = edge.frame(spark).withColumn("rank", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    assert resample.resample(docs, items(spark)).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert hamming_join.near_duplicates(docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_materialised_tables_are_released(spark):
    from pathlib import Path

    from vitaplate.functions.ranking import release_materialised
    from vitaplate.llm import common

    written = common.materialise(spark.range(3), "release").inputFiles()[0]
    folder = Path("/" + written.split(":", 1)[1].lstrip("/")).parent
    assert folder.name.startswith("llm-release-") and folder.exists()
    assert release_materialised(spark) >= 1
    assert not folder.exists()
