from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import edge
from vitaplate.llm import common as C
from vitaplate.llm import decontaminate, fingerprint, html_text, jaccard, mixing, pii, quality, token_files, toxicity


def sample(n, seed=1, vocabulary=40, low=0, high=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefgh") + str(rng.randrange(vocabulary)) for _ in range(rng.randint(low, high))) for _ in range(n)]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(4)


# op1 -----------------------------------------------------------------------

def test_digest_properties():
    a = fingerprint.fingerprint(edge.BASE.encode())
    assert a == fingerprint.fingerprint(edge.BASE.encode()) and len(a) == 130
    near = fingerprint.fingerprint((edge.BASE + " tail").encode())
    far = fingerprint.fingerprint(b"an entirely different sentence about nothing in particular, really")
    assert fingerprint.likeness(a, a) == 1.0
    assert 1 > fingerprint.likeness(a, near) > fingerprint.likeness(a, far) >= 0
    assert fingerprint.likeness(a, None) is None
    assert fingerprint.fingerprint(b"") == "00" * 65


def test_edited_neighbours_match_a_loop(spark):
    texts = sample(150) + edge.TEXTS
    rng = random.Random(3)
    ids = rng.sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in fingerprint.edited_neighbours(df).collect()}
    ordered = sorted(zip(ids, texts, strict=True))
    assert len(got) == len(ordered)
    for (i, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, nxt = t or "", nxt or ""
        k = len(t) // 4
        changed = (t[: len(t) - k] + nxt[:k]).encode()
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(changed).hexdigest()
        assert r.fingerprint == fingerprint.fingerprint(t.encode())
        assert r.edited_fingerprint == fingerprint.fingerprint(changed)
        assert r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.fingerprint(nxt.encode()))
        assert 0 <= r.near_edited <= 1


def test_edited_neighbours_edges(spark):
    assert fingerprint.edited_neighbours(edge.empty(spark)).collect() == []
    got = fingerprint.edited_neighbours(edge.frame(spark)).collect()
    assert len(got) == len(edge.TEXTS)  # repeated and null ids keep their rows
    lone = fingerprint.edited_neighbours(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert lone[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and lone[0].near_next == 1.0
    again = fingerprint.with_fingerprint(edge.frame(spark), name="key")
    assert again.columns[-1] == "key" and again.columns.count("key") == 1 and again.count() == len(edge.TEXTS)


# op2 -----------------------------------------------------------------------

def planted(seed=5):
    items = [(i, t) for i, t in enumerate(sample(12, seed, vocabulary=300, low=8, high=40))] + [(90, None), (91, ""), (92, "short one"), (93, "b1")]
    items.append((94, items[0][1]))  # two items of equal text
    rng = random.Random(seed)
    texts = sample(60, seed + 1, vocabulary=300)
    for k in range(0, 60, 3):
        words = (items[rng.randrange(12)][1] or "").split()
        a = rng.randrange(max(1, len(words)))
        texts[k] = texts[k] + " " + " ".join(words[a : a + 20]).upper() + ", " + texts[k]
    return items, texts + [None, "", "SHORT, one", "b1"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_contamination_matches_brute_force(spark, block_bytes):
    items, texts = planted()
    df = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.find_contamination(df.select("doc_id", "text"), bench, block_bytes=block_bytes)).collect()
    want = decontaminate.brute_force(list(enumerate(texts)), items)
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)
    assert any(r.contaminated for r in got)


def test_longest_match_and_spans(spark):
    words = [f"t{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    df = documents(spark, ["x y " + " ".join(words[3:25]) + " z", " ".join(words[:12])])
    a, b = decontaminate.find_contamination(df, bench).orderBy("doc_id").collect()
    assert (a.longest_match, a.n_hit, [tuple(s) for s in a.hit_spans]) == (22, 22, [(2, 24)])
    assert (b.longest_match, b.n_hit, b.hit_spans) == (0, 0, [])


def test_contamination_edges(spark):
    bench = spark.createDataFrame([(1, edge.BASE)], "item_id long, text string")
    got = decontaminate.find_contamination(edge.frame(spark), bench)
    assert got.columns.count("n_words") == 1 and dict(got.dtypes)["n_words"] == "bigint"
    assert sum(r.n_hit > 0 for r in got.collect()) == 3
    assert decontaminate.find_contamination(edge.empty(spark), bench).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(edge.frame(spark), nothing).where("n_hit > 0").count() == 0
    kept = decontaminate.decontaminate(edge.frame(spark), bench)
    assert kept.columns == edge.frame(spark).columns and kept.count() == len(edge.TEXTS) - 3
    assert {r.n_words for r in kept.collect()} == {"clash"}


# op4 -----------------------------------------------------------------------

def word_rows(texts):
    words, begin = toxicity.word_sets(C.TextStep(pa.array(texts)))
    return [words[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]


def test_swap_penalty_protects_neutral_mentions():
    rng = random.Random(2)
    texts, y = [], []
    for i in range(900):
        t = sample(1, seed=i, low=10, high=25)[0]
        bad = rng.random() < 0.3
        if bad:
            t += " " + rng.choice(["idiot", "scum", "moron"])
        if rng.random() < (0.75 if bad else 0.08):  # the term goes with the label in the learning rows
            t += " " + rng.choice(["muslim", "muslim", "christian"])
        texts.append(t)
        y.append(float(bad))
    sets, y = word_rows(texts), np.array(y)
    plain = toxicity.fit_words(sets, y, swap_penalty=0.0)
    fair = toxicity.fit_words(sets, y, swap_penalty=50.0)

    def score(model, text):
        s = word_rows([text])[0]
        return model.score(s, np.array([0, len(s)]))[0]

    neutral, other = "the muslim neighbours met today", "the christian neighbours met today"
    gap = lambda m: abs(score(m, neutral) - score(m, other))
    assert gap(fair) < 0.05 and gap(fair) <= gap(plain) + 1e-9
    assert score(fair, "what an idiot he is") > 0.5 > score(fair, neutral)


def labelled(spark, n=400):
    texts, rows = [], []
    for i in range(n):
        t = sample(1, seed=i, low=15, high=40)[0]
        toxic = int(i % 4 == 0)
        good = int(i % 3 != 0)
        if toxic:
            t += " you stupid clown"
        if not good:
            t = " ".join([t.split()[0]] * 60)
            t += " you stupid clown" * toxic
        texts.append(t)
        rows.append((i, good, toxic))
    return documents(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    got = toxicity.digest(toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)))
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())


def test_toxicity_edges(spark):
    docs, labels = labelled(spark, 60)
    model = toxicity.fit_toxicity(edge.empty(spark), labels)
    scored = toxicity.score_toxicity(edge.frame(spark), model)
    assert scored.columns.count("score") == 1 and scored.count() == len(edge.TEXTS)
    assert all(0 <= r.score <= 1 for r in scored.collect())
    assert toxicity.score_toxicity(edge.empty(spark), model).count() == 0
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 0, 1)], labels.schema))
    assert toxicity.fit_toxicity(docs, odd).weights.shape == (1 << toxicity.BITS,)


# op5 -----------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy &amp; save</div>
<article><h1>Head  line</h1><p><b>First &lt;part&gt;
of&nbsp;it.<br><p>Short.</p><p>Second part, a &amp; b.</p><aside>Side note</aside><p>Third.</p>
<form><label>Name</label></form><div class="comments"><p>Reader says hello.</p></div></article>
<footer>&copy; host</footer></body></html>"""


def test_article_text():
    assert html_text.main_text(PAGE) == "Head line\nFirst <part> of it.\nShort.\nSecond part, a & b.\nThird."
    assert html_text.main_text(PAGE.replace("</body></html>", "").replace("</footer>", "")) == html_text.main_text(PAGE)


def test_surge_and_dive_without_a_named_article():
    long = "This sentence is long enough to count as running text on a page. " * 4
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div>Login</div><div></div><h2>Title</h2><p>{long}</p><p>Tiny.</p><p>{long}</p><div id='sidebar'><p>{long}</p></div><div class=footer>end</div>"
    assert html_text.main_text(page) == "\n".join(["Title", long.strip(), "Tiny.", long.strip()])
    assert "Home" not in html_text.main_text(page) and "end" not in html_text.main_text(page).split("\n")


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "a < b and c > d", "<p>x", "<!-- open", "<script>never closed", "</p></div>", "<a title='x>y'>z</a>", "<p class=\"ad>broken"])
def test_odd_pages(page):
    assert isinstance(html_text.main_text(page), str)


LONG = "<p>" + "A paragraph of the story that goes on for a good while. " * 4 + "</p>"
CLOSING = "<p>So it ended.</p>"


def test_sums_decide_with_and_without_a_named_article(monkeypatch):
    one = LONG[3:-4].strip()
    named = f"<body><article><p>Tiny.</p><p>Bits.</p><p>More.</p>{LONG}{CLOSING}</article><article><p>Teaser.</p></article></body>"
    assert html_text.main_text(named) == "\n".join(["Tiny.", "Bits.", "More.", one, "So it ended."])
    monkeypatch.setattr(html_text, "SURGE_CHARS", 1)
    assert html_text.main_text(named).endswith("So it ended.\nTeaser.")
    monkeypatch.setattr(html_text, "SURGE_CHARS", 60)
    plain = f"<body><p>Menu</p><div><h1>Head</h1><p>By me.</p>{LONG}{LONG}<h2>A</h2><p>b</p><p>c</p><p>d</p><div class=ad>Buy now and save a lot of money</div>{CLOSING}</div></body>"
    assert html_text.main_text(plain) == "\n".join(["Head", "By me.", one, one, "A", "b", "c", "d", "So it ended."])
    # a gap of other parents ends a region, one window longer than the gap does not
    far = f"<body><div>{LONG}{LONG}</div><nav>x</nav><div>{CLOSING}</div></body>"
    assert html_text.main_text(far) == f"{one}\n{one}"
    short = f"<body><div>{LONG}</div><nav>x</nav><div>{LONG}</div></body>"
    assert html_text.main_text(short) == f"{one}\n{one}"


def test_layout_wrappers_and_adverts_between_paragraphs():
    one = LONG[3:-4].strip()
    for wrapper in ("with-sidebar", "no-sidebar", "layout-has-ads", "sidebar"):
        assert html_text.main_text(f"<body><div class='{wrapper}'>{LONG}{LONG}</div></body>") == f"{one}\n{one}"
    page = f"<body><div>{LONG * 5}<div class='ad'>Buy!</div>{CLOSING}</div><div class='sidebar'>{LONG}</div></body>"
    assert html_text.main_text(page) == "\n".join([one] * 5 + ["So it ended."])
    nested = f"<article><div>{LONG}</div><form><input></form><div>{CLOSING}</div></article>"
    assert html_text.main_text(nested) == f"{one}\nSo it ended."


def test_every_given_page_gives_its_article():
    """A plain reference for these pages: the text of the blocks of the one article element."""
    import html
    import re

    for (page,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)
        if not inner or re.search(r"<(?!/?(?:p|h1|h2|h3|b|i|em|strong|br|a|ul|li|article)\b)", inner[1]):
            continue
        blocks = re.split(r"</?(?:p|h[1-3]|ul|li)\b[^>]*>", inner[1])
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", x)).split()) for x in blocks]
        assert html_text.main_text(page) == "\n".join(t for t in texts if t)


def test_extract_edges(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, None), (None, "u", "", "x"), (4, "u", "<p>" + "long text here " * 50_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.digest(html_text.extract(df)).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.where("false")).count() == 0
    assert max(r.n_chars for r in got) == len("long text here " * 50_000) - 1


# op6 -----------------------------------------------------------------------

TOKEN_TEXTS = ["a  b", "tab\t x", "it's  'quoted' 's", "end \n", " lead", "<|endoftext|> x", "naïve space 　wide", "a\n\nb c", "1234 5 67"]


def test_pieces_encode_like_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.vocabulary_path())
    whole.encode_special_tokens = True
    own = token_files.Encoder(token_files.vocabulary_path())
    texts = [t or "" for t in edge.TEXTS[:-2]] + TOKEN_TEXTS + sample(50)
    for _ in range(2):  # the second time from what it remembers
        for t, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids + [0]


def test_token_files_round_trip(spark, tmp_path):
    texts = sample(80) + TOKEN_TEXTS + [None, ""]
    df = documents(spark, texts)
    path = str(tmp_path / "tokens")
    token_files.write_token_files(df, path, shards=5)
    rows = {r.doc_id: r.ids for r in token_files.read_token_files(spark, path).collect()}
    own = token_files.Encoder(token_files.vocabulary_path())
    want = [np.frombuffer(x, "<u4").tolist() for x in own.encode([t or "" for t in texts])]
    assert rows == dict(enumerate(want))
    assert {r.doc_id for r in token_files.lookup(spark, path, [3, 70]).collect()} == {3, 70}
    start = 0
    for r in sorted(token_files.token_digest(spark, path).collect()):
        ids = np.array(want[r.doc_id], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    files = sorted(tmp_path.glob("tokens/shard=*/*.orc"))
    assert len(files) == 5 and b"ORC" in files[0].read_bytes()[:4]


def test_token_edges(spark):
    got = token_files.encode_to_files(edge.frame(spark)).collect()
    assert len(got) == len(edge.TEXTS) and min(r.n_tokens for r in got) == 1
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered][1:] == [r.start + r.n_tokens for r in ordered][:-1]
    assert token_files.encode_to_files(edge.empty(spark)).count() == 0


# op7 -----------------------------------------------------------------------

def near_copies(seed=9, groups=12, each=14, size=60):
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(rng.randint(4, size))]
        for _ in range(each):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                t = t[rng.randint(0, 2) :]
            texts.append(" ".join(t) if rng.random() < 0.7 else "  ".join(t).upper())
    return texts + ["", None, "one", "ONE", "one two", "one  TWO", " \n"]


def test_jaccard_matches_brute_force(spark, monkeypatch):
    texts = near_copies()
    want = sorted(jaccard.brute_force(list(enumerate(texts))))
    got = sorted(tuple(r) for r in jaccard.jaccard_classes(documents(spark, texts)).collect())
    assert got == want
    assert len({w[2] for w in want}) < len(want)


def test_jaccard_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    texts = near_copies(seed=4, groups=3, each=40)
    want = sorted(jaccard.brute_force(list(enumerate(texts))))
    assert sorted(tuple(r) for r in jaccard.jaccard_classes(documents(spark, texts)).collect()) == want


def test_jaccard_counts_support_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", 40)
    texts = near_copies(seed=5, groups=4, each=12) * 2
    want = sorted(jaccard.brute_force(list(enumerate(texts)), 2, 80))
    assert sorted(tuple(r) for r in jaccard.jaccard_classes(documents(spark, texts), shingle=2, percent=80).collect()) == want


@pytest.mark.parametrize(("shingle", "percent"), [(3, 90), (5, 80)])  # op7's and the pipeline's
def test_jaccard_support_makes_no_row_for_each_class_and_bucket(spark, monkeypatch, shingle, percent):
    """Eight times the buckets: as many rows come back, and the same classes are supported."""
    texts = near_copies(seed=7, groups=6, each=12) * 2
    docs = documents(spark, texts).repartition(3)
    sets = jaccard.C.add_columns(docs, jaccard._SETS, "text", lambda step: jaccard._describe(step, shingle, percent)).where("key is not null")
    classes = sets.groupBy("key").agg(F.max("level").alias("level"), F.max("n").alias("n"))
    total = sets.agg(F.sum("n")).first()[0]
    made, found = spark.sparkContext.accumulator(0), []

    def counted(work):
        def run(rows):
            out = work(rows)
            made.add(out.num_rows)
            return out

        return run

    monkeypatch.setattr(jaccard, "_shared", counted(jaccard._shared))
    for buckets in (2, 16):
        monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", total // buckets + 1)
        before = made.value
        found.append((sorted(map(tuple, jaccard._supported(docs, classes, total, shingle, percent).collect())), made.value - before))
    assert found[0][0] and found[0][0] == found[1][0]
    # three slices in 2 and in 16 buckets; there are some 70 classes
    assert found[1][1] <= 3 * 16


def test_jaccard_keeps_nothing_of_sets_that_cannot_link(spark, monkeypatch):
    """Texts that share a passage of a third of their words are not cut into parts, nor sent to blocks."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([f"w{rng.randrange(10**9)}" for _ in range(80)] + passage) for _ in range(60)]
    texts += texts[:5] + [texts[7] + " more"]
    listed = {}

    def spy(df, label):
        out = materialise(df, label)
        listed[label] = sum(out.select(F.coalesce(F.sum(F.size(c)), F.lit(0))).first()[0] for c, t in out.dtypes if t.startswith("array"))
        return out

    materialise = jaccard.C.materialise
    monkeypatch.setattr(jaccard.C, "materialise", spy)
    got = sorted(tuple(r) for r in jaccard.jaccard_classes(documents(spark, texts), shingle=5, percent=80).collect())
    assert got == sorted(jaccard.brute_force(list(enumerate(texts)), 5, 80))
    assert sum(listed.values()) < 1000  # two sets of 116 and 117 shingles and their parts


def test_parts_lose_no_link():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.choice([1, 5, 10, 19, 20, 21, 40, 100, 333])
        a = {rng.getrandbits(63) for _ in range(n)}
        b = set(a)
        for x in rng.sample(sorted(a), rng.randint(0, n // 9)):
            b.discard(x)
        for _ in range(rng.randint(0, n // 9)):
            b.add(rng.getrandbits(63))
        both = len(a & b)
        if 100 * both >= 90 * len(a | b):
            parts = [set(jaccard.signatures(np.array(sorted(s), np.uint64), jaccard.size_level(len(s))).tolist()) for s in (a, b)]
            assert parts[0] & parts[1]


@pytest.mark.parametrize(("shingle", "percent"), [(5, 80), (1, 50)])
def test_jaccard_takes_shingle_and_percent(spark, shingle, percent):
    texts = near_copies(seed=6, groups=4, each=12)
    want = sorted(jaccard.brute_force(list(enumerate(texts)), shingle, percent))
    got = jaccard.jaccard_classes(documents(spark, texts), shingle=shingle, percent=percent)
    assert sorted(map(tuple, got.collect())) == want
    assert {w[2] for w in want} != {w[2] for w in jaccard.brute_force(list(enumerate(texts)))}
    kept = jaccard.one_of_each(documents(spark, texts), shingle=shingle, percent=percent)
    assert sorted(r.doc_id for r in kept.collect()) == [w[0] for w in want if w[0] == w[2]]


def test_parts_lose_no_link_at_80_percent():
    rng = random.Random(8)
    links = 0
    for _ in range(600):
        n = rng.choice([1, 5, 9, 10, 19, 40, 100, 333])
        a = {rng.getrandbits(63) for _ in range(n)}
        b = set(a) - set(rng.sample(sorted(a), rng.randint(0, n // 6)))
        b |= {rng.getrandbits(63) for _ in range(rng.randint(0, n // 6))}
        if b and 100 * len(a & b) >= 80 * len(a | b):
            links += 1
            parts = [set(jaccard.signatures(np.array(sorted(s), np.uint64), jaccard.size_level(len(s), 80), 80).tolist()) for s in (a, b)]
            assert parts[0] & parts[1]
    assert links > 200


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(map(tuple, jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_jaccard_edges(spark):
    got = jaccard.jaccard_classes(edge.frame(spark)).collect()
    assert len(got) == len(edge.TEXTS)
    assert {r.component_id for r in got if r.doc_id in (0, 5, 10)} == {0}
    assert jaccard.jaccard_classes(edge.empty(spark)).count() == 0
    kept = jaccard.one_of_each(edge.frame(spark))
    assert kept.columns == edge.frame(spark).columns
    stayed = kept.collect()
    assert {r.doc_id for r in stayed} >= {0, 15, 20, 25} and not {5, 10} & {r.doc_id for r in stayed}
    # "one" has no id, "ONE" (the same set) has: the first goes
    assert not [r for r in stayed if r.text == "one"] and [r for r in stayed if r.text == "ONE"]
    lone = spark.createDataFrame([(None, "a b c d"), (1, "x y z")], "doc_id long, text string")
    assert jaccard.one_of_each(lone).count() == 2


# op8 -----------------------------------------------------------------------

PII_TEXTS = [
    "a@b.c@d.e a@b.c_d@e.f x.y+z@mail-1.example.com. @no no@ a@b a@b..c ._%+-@q.r",
    "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 0001.002.3.4 256.1.1.1 10.0.0.300 1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 1234567812345678 411111111111111111111 5 5",
    "+1 (310) 555-4510 +12 +1-2 +49 30 901820 ++1 222 333 4444 +1234567890123456 +1 2 3 4 5 6 7 8).",
    "Ünï 😀 a@ü.de b@x.de 😀 +1 (310) 555-4510 😀 10.20.30.40 4111111111111111 😀",
    "tel (310) 555-4510 and mail: jo (at) host (dot) org or jo [at] host.com",
]


def test_base_spans_match_re(spark):
    texts = PII_TEXTS + edge.TEXTS
    df = documents(spark, texts)
    for r in pii.digest(pii.find_pii(df)).collect():
        want = pii.brute_force(texts[r.doc_id])
        named = ",".join(f"{k}:{a}:{e}" for k in pii.KINDS for a, e in want[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert set(filter(None, named.split(","))) <= set(r.spans.split(","))


def test_classifier_adds_spans(spark):
    texts = [f"mail: someone{i}@host.com, phone: +1 (310) 555-{1000 + i}" for i in range(60)] + [f"phone: (310) 555-{1000 + i}" for i in range(30)] + [f"build 310-555-{1000 + i}" for i in range(5)]
    got = pii.find_pii(documents(spark, texts)).collect()
    added = [r for r in got if r.added]
    assert added and all(60 <= r.doc_id < 90 for r in added)
    model_rows = [((1, 1, 1), 50), ((1, 1, 0), 20), ((-1, -1, 0), 40), ((-1, 1, -1), 5)]
    rates, posterior = pii._em(model_rows)
    assert posterior[1, 1, 1] > 0.9 > 0.1 > posterior[-1, -1, 0]
    assert rates[0, 1][0] > rates[0, 1][1]


def test_reliabilities_turn_a_majority():
    # two labelers of three say yes, the check says no: the data's other patterns show that the check is right
    rows = [((1, -1, 0, -1), 96), ((1, 1, 0, -1), 62), ((1, 1, 0, 1), 161), ((1, -1, 0, 1), 12)]
    rates, posterior = pii._em(rows)
    assert posterior[1, 1, 0, -1] < 0.5 < posterior[1, -1, 0, 1]
    assert rates[3, -1][0] < rates[1, -1][0]
    assert rates[2, 0] == (1.0, 1.0)


def test_secrets_and_failed_matches(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(80)]
    texts = [f'token = "{h}" and more' for h in hexes[:50]] + [f"{('commit', 'and')[i % 2]} {h} went in" for i, h in enumerate(hexes[50:])] + [f"no. 12345678{i:08d} of" for i in range(20)] + ["card 4111111111111111."] * 15
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(documents(spark, texts))).collect()}
    assert all(got[i].spans == "secret:9:49" and got[i].n_spans == 1 for i in range(50))
    assert all(got[i].n_spans == 0 for i in range(50, 80))
    numbers = [i for i in range(80, 100) if not pii.brute_force(texts[i])["card"]]
    assert len(numbers) > 10 and all(got[i].n_spans == 0 for i in numbers)
    assert all(got[i].spans == "card:5:21" and got[i].n_card == 1 for i in range(100, 115))


def test_running_sums_span_blocks(spark):
    # more matches than a block: the offsets and the overlap test go by blocks
    text = " ".join(f"10.0.{i % 400}.7 é" for i in range(2000))
    r = pii.digest(pii.find_pii(documents(spark, [text]))).first()
    want = pii.brute_force(text)
    assert r.n_ip == len(want["ip"]) > 1000
    assert {f"ip:{a}:{e}" for a, e in want["ip"]} <= set(r.spans.split(","))
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for k in pii.KINDS for a, e in want[k]).encode()).hexdigest()


def test_pii_plan_has_no_python(spark):
    plan = pii.candidates(edge.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_edges(spark):
    assert len(pii.find_pii(edge.frame(spark)).collect()) == len(edge.TEXTS)
    assert pii.find_pii(edge.empty(spark)).count() == 0
    many = documents(spark, [" ".join(f"10.0.{i % 250}.{i % 199}" for i in range(3000)), "9" * 100_000, "a" * 100_000 + "@", "1." * 50_000])
    r = pii.digest(pii.find_pii(many)).where("doc_id = 0").first()
    assert r.n_ip == 3000


# op9 -----------------------------------------------------------------------

def test_targets_are_water_filled(spark):
    rng = random.Random(6)
    sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 500, 4000]) for i in range(12)} | {None: 300}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    names = sorted(k for k in sizes if k is not None) + [None]
    weight = {n: (3.0, 1.0, 2.0)[i % 3] for i, n in enumerate(names)}
    left, open_, want = 1.5 * sum(sizes.values()), set(names), {}
    while open_:  # the excess is reshared until none is above
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total >= 2 * sizes[n]]
        if not over:
            want.update({n: left * weight[n] / total for n in open_})
            break
        for n in over:
            want[n] = 2.0 * sizes[n]
            open_.discard(n)
        left -= sum(want[n] for n in over)
    assert got == pytest.approx(want)


def test_mix_meets_its_targets(spark):
    docs = documents(spark, sample(300, low=0, high=60))
    rows = mixing.curriculum(docs).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert sum(r.size for r in own) == own[0].source_size
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    at = [r.first_position for r in rows if r.first_position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert sorted(map(tuple, mixing.curriculum(docs.repartition(9), sort=False).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_fading_sources_move(spark):
    docs = documents(spark, ["w " * 30] * 600)
    rows = mixing.curriculum(docs, sort=False).where("first_position is not null").collect()
    mean = {s: np.mean([r.first_position for r in rows if r.source == s]) for s in ("s0", "s1", "s2")}
    share = {r.source: r.target / r.source_size for r in rows}
    # sources that go round once can be compared: s0 fades out, s2 in
    assert mean["s0"] / min(1, 1 / share["s0"]) < mean["s2"] / min(1, 1 / share["s2"])


def test_mix_edges(spark):
    got = mixing.digest(mixing.curriculum(edge.frame(spark))).collect()
    assert len(got) == len(edge.TEXTS)
    assert mixing.curriculum(edge.empty(spark)).count() == 0
    nothing = documents(spark, [None, "", " "])
    assert [(r.size, r.taken, r.target) for r in mixing.curriculum(nothing).collect()] == [(0, 0, 0.0)] * 3
    mixed = mixing.mixed(documents(spark, sample(90, low=1)))
    assert mixed.columns == ["doc_id", "text", "lang", "source"]
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


# op10 ----------------------------------------------------------------------

def test_features_of_odd_texts():
    for t in edge.TEXTS:
        assert len(quality.features(t)) == len(quality.FEATURES) and all(map(np.isfinite, quality.features(t)))


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone = quality.fit_additive(x, y, rounds=30, pairs=0)
    paired = quality.fit_additive(x, y, rounds=30, pairs=2, pair_rounds=80)
    assert ((paired.score(x) > 0.5) == y).mean() > 0.85 > 0.65 > ((alone.score(x) > 0.5) == y).mean()
    assert (0, 1) in paired.pairs


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    got = quality.digest(quality.score_quality(docs, quality.fit_quality(docs, labels)))
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.97
    kept = quality.keep_good(docs, quality.fit_quality(docs, labels))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_quality_edges(spark):
    _, labels = labelled(spark, 40)
    model = quality.fit_quality(edge.empty(spark), labels)
    scored = quality.score_quality(edge.frame(spark), model)
    assert scored.columns.count("score") == 1 and {r.score for r in scored.collect()} == {0.5}
    assert quality.score_quality(edge.empty(spark), model).count() == 0
