"""PII by weak supervision, in DataFrame functions only.

Every text yields candidate spans: matches of the base patterns, which stay if
they are valid and are doubtful candidates if they fail narrowly, and looser
ones, secrets among them.  Four labelers vote on each candidate (yes, no or
abstain): a strict pattern, a gazetteer of prefixes and endings, the words
before it, and a check of its digits.  Expectation-maximisation estimates each
labeler's reliability from how often the vote patterns occur; its posteriors are
the soft labels on which a logistic span classifier (votes, shape and
surroundings) is trained, and candidates that it accepts are added.  Both fits
see counts of patterns only, a table whose size is fixed by the number of
labelers and features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaplate.llm import common as C

#: Kinds with a base pattern.
KINDS = ("email", "ip", "card", "phone")
#: All kinds; passwords, keys and tokens come from candidates only.
ALL_KINDS = (*KINDS, "secret")

# A match may begin at a run's start or where the last one ended: the same leftmost
# matches as without that condition, but a long run is scanned once.
#: Base patterns (fixed values), by kind.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns of candidates that the method may add.
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]\x20?(?:at|AT|@)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT|\.)\x20?[\])]\x20?)[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?:(?:[0-9A-Fa-f]{32,128}+|(?:sk|pk|ghp|xoxb|xoxp|AKIA)[A-Za-z0-9_-]{16,128}+)(?![A-Za-z0-9_-])|(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{24,128}+(?![A-Za-z0-9_-]))",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": ("@", "(?i)[\\[(]\\x20?(?:at|@)\\x20?[\\])]"), "ip": (".", "[0-9A-Fa-f]:[0-9A-Fa-f]"), "card": (None, "[0-9]{4}[\\x20-][0-9]{6}"), "phone": ("+", "[0-9]{3}[).]?[\\x20.-]?[0-9]{3}[.-][0-9]{4}"), "secret": (None, "(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{18}")}
#: Gazetteers (fixed values): a value that fits is likelier meant.
GAZETTEER = {
    "email": r"(?i)\b(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|be|us)$",
    "ip": r"^(?!(?:0|10|127|22[4-9]|2[3-5][0-9])\.)",
    "card": r"^[3456]",
    "phone": r"^\+?\(?(?:1|33|34|44|49|[2-9][0-9]{2}\)?[\x20.-]?[2-9])",
    "secret": r"^(?:sk|pk|ghp|xoxb|xoxp|AKIA)[A-Za-z0-9_-]",
}
#: Words before a value that speak for its kind (fixed values), in four languages.
CUES = {
    "email": r"(?i)(?:e-?mail|mailto|courriel|correo|contact|kontakt|write|schreib)\W{0,12}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|adresse|direcci.n)\W{0,12}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|carte|tarjeta|karte|kredit)\W{0,12}$",
    "phone": r"(?i)(?:phone|tel|call|fon|fax|mobile|handy|portable|m.vil|llame|appelez|ruf)\W{0,12}$",
    "secret": r"(?i)(?:token|secret|password|passwd|pwd|key|bearer|credentials?)\W{0,6}$",
}
#: Words before a value that speak against personal data.
AGAINST = r"(?i)(?:version|isbn|order|token|sha|hash|build|release|ref|serial|\bid)\W{0,4}$"
#: The same for secrets: values that are public by purpose.
AGAINST_SECRET = r"(?i)(?:sha-?[0-9]{0,3}|md5|hash|commit|checksum|digest|etag|revision|build|release|isbn|uuid)\W{0,4}$"

#: Shape and surroundings: names of the classifier's features beside the votes.
SHAPE = ("base", "clean_left", "clean_right", "separated", "long")
#: Characters of context before a span that the labelers see.
CONTEXT = 24
EM_ROUNDS = 50
FIT_ROUNDS = 200


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _valid_base(kind: str, v: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == "ip":
        return ~v.rlike(r"(?:^|\.)0*+(?:[1-9][0-9]{3,}|25[6-9]|2[6-9][0-9]|[3-9][0-9][0-9])(?:\.|$)")
    if kind == "card":
        digits = _digits(v)
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(v)).between(8, 15)
    return F.lit(True)


def _doubtful(kind: str, v: Column) -> Column:
    """Whether a match of the base pattern that does not count is a candidate: an address with a part above 255, a number of about the right length."""
    if kind == "ip":
        return F.lit(True)
    if kind == "card":
        return F.length(_digits(v)).between(13, 19)
    if kind == "phone":
        return F.length(_digits(v)).between(7, 17)
    return F.lit(False)


def _check(kind: str, v: Column) -> Column:
    """The labeler of digits: whether a checksum, the range of an address or the length of a number holds."""
    if kind == "ip":
        return F.when(v.contains(":"), 0).when(_valid_base(kind, v), 1).otherwise(-1)
    if kind == "card":
        return F.when(F.call_function("luhn_check", _digits(v)), 1).otherwise(-1)
    if kind == "phone":
        return F.when(_valid_base(kind, v), 1).otherwise(-1)
    return F.lit(0)


def _strict(kind: str, v: Column) -> Column:
    """The pattern labeler: yes, no, or abstain (0)."""
    if kind == "email":
        return F.when(v.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$"), 1).when(v.contains("@"), -1).otherwise(0)
    if kind == "ip":
        return F.when(v.rlike(r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$"), 1).when(v.contains("."), -1).otherwise(0)
    if kind == "card":
        return F.when(v.rlike(r"^(?:[0-9]{14,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5})$"), 1).otherwise(-1)
    if kind == "secret":  # a hash and a token look alike: digits alone say nothing
        return F.when(v.rlike(r"^(?:sk|pk|ghp|xoxb|xoxp|AKIA)[A-Za-z0-9_-]{16}"), 1).when(v.rlike("[g-zG-Z]{8}|-.*-"), -1).otherwise(0)
    return F.when(v.rlike(r"^\+[1-9][0-9]{0,2}[\x20.-]?\(?[0-9]"), 1).when(v.rlike(r"^\([0-9]{3}\)"), 0).otherwise(-1)


#: Matches in one step of the running sums and of the overlap test.
BLOCK = 256


def _blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK."""
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(items, j * BLOCK + 1, F.lit(BLOCK))))


def _running(sizes: Column) -> Column:
    """The sum before each entry, as struct (end, all)."""
    return F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("all")),
        lambda acc, x: F.struct((acc["end"] + x).alias("end"), F.concat(acc["all"], F.array(acc["end"])).alias("all")),
    )


def _with_starts(docs: DataFrame) -> DataFrame:
    """Add ``_starts``: where each match starts, in code points, from the lengths of the gaps and the matches before.

    Running sums within blocks of matches on top of the blocks' totals: the array
    that grows entry by entry is never longer than a block (or the number of blocks).
    """
    sizes = F.transform(F.sequence(F.lit(0), F.size("_found") - 1), lambda i: F.length(F.element_at("_gaps", i + 1)) + F.length(F.element_at("_found", i + 1)))
    docs = docs.withColumn("_sizes", F.when(F.size("_found") > 0, sizes))  # a column of its own: blocks are cut from it many times
    docs = docs.withColumn("_sums", F.when(F.size("_sizes") > 0, F.transform(_blocks(F.col("_sizes")), _running)))
    docs = docs.withColumn("_before", F.when(F.size("_sums") > 0, _running(F.transform("_sums", lambda b: b["end"]))["all"]))
    ends = F.flatten(F.transform("_sums", lambda b, j: F.transform(b["all"], lambda x: x + F.element_at("_before", j + 1))))
    return docs.withColumn("_ends", F.when(F.size("_before") > 0, ends)).drop("_sizes", "_sums", "_before")


def _kind_spans(docs: DataFrame, kind: str, base: bool) -> DataFrame:
    """Add the array column of one kind's candidates by one pattern."""
    pattern = (BASE if base else LOOSE)[kind]
    plain, loose = NEEDS[kind]
    t = F.col("text")
    may = (t.contains(plain) if plain else F.lit(True)) if base else t.rlike(loose)
    found = F.when(may, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    docs = docs.withColumn("_found", found)
    docs = docs.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(t, pattern, -1)))
    docs = _with_starts(docs)

    def span(i):
        v = F.element_at("_found", i + 1)
        before, after = F.element_at("_gaps", i + 1), F.element_at("_gaps", i + 2)
        left = F.substring(before, -CONTEXT, CONTEXT)
        start = F.element_at("_ends", i + 1) + F.length(before)
        against = AGAINST_SECRET if kind == "secret" else AGAINST
        cue = F.when(left.rlike(CUES[kind]), 1).when(left.rlike(against), -1)
        if kind == "secret":  # a random string that nothing names is not taken for one, unless its prefix names it
            cue = cue.when(~v.rlike(GAZETTEER[kind]), -1)
        cue = cue.otherwise(0)
        valid = _valid_base(kind, v) if base else F.lit(False)
        return F.struct(
            F.lit(ALL_KINDS.index(kind)).alias("kind"),
            start.alias("start"),
            (start + F.length(v)).alias("end"),
            valid.alias("base"),
            (valid | (_doubtful(kind, v) if base else F.lit(True))).alias("candidate"),
            _strict(kind, v).alias("pattern"),
            F.when(v.rlike(GAZETTEER[kind]), 1).otherwise(-1).alias("gazetteer"),
            cue.alias("context"),
            _check(kind, v).alias("check"),
            (~left.rlike(r"[\p{L}\p{N}]$")).alias("clean_left"),
            (~after.rlike(r"^[\p{L}\p{N}]")).alias("clean_right"),
            v.rlike(r"[\x20()-]").alias("separated"),
            (F.length(v) > 16).alias("long"),
        )

    spans = F.filter(F.transform(F.sequence(F.lit(0), F.size("_found") - 1), span), lambda s: s["candidate"])
    name = f"{kind}_{'base' if base else 'loose'}"
    return docs.withColumn(name, F.when(F.size("_found") > 0, spans)).drop("_found", "_gaps", "_ends")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base: valid base spans, loose: the other candidates that overlap no base span), from whole texts; a null text is empty."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for kind in KINDS:
        out = _kind_spans(_kind_spans(out, kind, True), kind, False)
    out = _kind_spans(out, "secret", False)
    none = F.array().cast(out.schema["email_base"].dataType)
    found = [f"{k}_base" for k in KINDS]
    loose = F.concat(*[F.coalesce(F.filter(F.col(c), lambda s: ~s["base"]), none) for c in [*found, *[f"{k}_loose" for k in ALL_KINDS]]])
    base = F.concat(*[F.coalesce(F.filter(F.col(c), lambda s: s["base"]), none) for c in found])

    def summary(b):
        return F.struct(F.array_min(F.transform(b, lambda x: x["start"])).alias("low"), F.array_max(F.transform(b, lambda x: x["end"])).alias("high"), b.alias("spans"))

    out = out.select("doc_id", base.alias("base"), loose.alias("loose"))
    both = (F.size("base") > 0) & (F.size("loose") > 0)
    out = out.withColumn("_blocks", F.when(both, F.transform(_blocks(F.col("base")), summary)))

    def met(s):
        return F.exists("_blocks", lambda b: (b["low"] < s["end"]) & (s["start"] < b["high"]) & F.exists(b["spans"], lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))

    free = F.filter("loose", lambda s: ~met(s))
    return out.withColumn("loose", F.when(F.size("_blocks") > 0, free).otherwise(F.col("loose"))).drop("_blocks")


VOTES = ("pattern", "gazetteer", "context", "check")
#: Log odds that a labeler's yes gives before any data: a failed checksum is nearly proof, words before a value say much, a fitting prefix little.
TRUST = (1.2, 0.5, 2.5, 3.0)


def _trusted(trust: float, vote: int) -> float:
    """P(vote | real, not abstaining) before any data."""
    return 1 / (1 + math.exp(-trust * vote))


@dataclass
class SpanModel:
    """Reliabilities of the labelers and weights of the span classifier, by kind."""

    reliability: dict
    weights: dict

    def logit(self, s: Column) -> Column:
        """The classifier's logit of a candidate struct."""
        out = F.lit(-20.0)
        for k, w in self.weights.items():
            z = F.lit(float(w[0]))
            for name, x in zip((*VOTES, *SHAPE), w[1:], strict=True):
                z = z + F.lit(float(x)) * s[name].cast("double")
            out = F.when(s["kind"] == k, z).otherwise(out)
        return out


def _em(rows: list[tuple[tuple[int, ...], float]]) -> tuple[dict, dict]:
    """Estimate P(vote | real) and P(vote | not) of each labeler from vote patterns and counts; returns them and each pattern's posterior.

    The trust in a labeler weighs as much as the candidates do, so votes that never
    differ in the data, or differ in one labeler alone, cannot turn its meaning.
    """
    total = sum(n for _, n in rows)
    posterior = {v: 1 / (1 + math.exp(-sum(t * x for t, x in zip(TRUST, v, strict=False)))) for v, _ in rows}
    rates: dict = {}
    for _ in range(EM_ROUNDS):
        for j in range(len(rows[0][0])):
            voted = [(v[j], n, n * posterior[v]) for v, n in rows if v[j]]
            weight, real = sum(n for _, n, _ in voted) + 1, sum(r for _, _, r in voted)
            rates[j, 0] = (1.0, 1.0)  # who abstains says nothing
            for vote in (-1, 1):
                yes, no = sum(r for x, _, r in voted if x == vote), sum(n - r for x, n, r in voted if x == vote)
                rates[j, vote] = (yes + weight * _trusted(TRUST[j], vote)) / (real + weight), (no + weight * _trusted(TRUST[j], -vote)) / (2 * weight - 1 - real)
        share = (sum(n * posterior[v] for v, n in rows) + total / 2) / (2 * total)
        for v, _ in rows:
            z = math.log(share / (1 - share)) + sum(math.log(rates[j, x][0] / rates[j, x][1]) for j, x in enumerate(v))
            posterior[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return rates, posterior


def _logistic(rows: list[tuple[list[float], float, float]]) -> list[float]:
    """Ridge-penalised logistic weights (bias first) of (features, soft label, count) rows, by gradient steps."""
    k = len(rows[0][0]) + 1
    w = [0.0] * k
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(FIT_ROUNDS):
        g = [-0.002 * x for x in w]
        for x, y, n in rows:
            z = w[0] + sum(a * b for a, b in zip(w[1:], x, strict=True))
            r = (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * n / total
            g[0] += r
            for j, v in enumerate(x):
                g[j + 1] += r * v
        w = [a + 0.8 * b for a, b in zip(w, g, strict=True)]
    return w


def fit_spans(found: DataFrame) -> SpanModel:
    """Reliabilities by expectation-maximisation, then the span classifier on their posteriors.

    The driver sees one count per kind, vote pattern and shape: at most
    5 * 81 * 32 rows, whatever the input.  A kind without candidates adds nothing.
    """
    each = found.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.*")
    counts = each.groupBy("kind", *VOTES, *SHAPE).count().collect()
    reliability, weights = {}, {}
    for k in sorted({r["kind"] for r in counts}):
        own = [r for r in counts if r["kind"] == k]
        by: dict = {}
        for r in own:
            v = tuple(r[x] for x in VOTES)
            by[v] = by.get(v, 0) + r["count"]
        reliability[k], posterior = _em(sorted(by.items()))
        rows = sorted(([float(r[x]) for x in (*VOTES, *SHAPE)], posterior[tuple(r[x] for x in VOTES)], float(r["count"])) for r in own)
        weights[k] = _logistic(rows)
    return SpanModel(reliability, weights)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): spans of personal data in every whole text, as arrays of structs.

    ``base`` holds the base patterns' valid spans, ``added`` the other candidates
    (doubtful, looser, secrets) that the trained classifier accepts and that overlap no base span; offsets
    count code points, the end is exclusive.  Null and empty texts have none; repeated
    rows, ids and null ids give rows of their own; other columns are left out.
    """
    found = C.materialise(candidates(docs, id_col, text_col), "pii-candidates")
    model = fit_spans(found)
    added = F.filter("loose", lambda s: model.logit(s) >= 0)
    return found.select("doc_id", "base", added.alias("added"))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, then n_spans; the counts by kind are those of the base spans, n_spans counts all."""
    def count(kind: int, name: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{name}")

    counts = [count(k, name) for k, name in enumerate(KINDS)]
    both = F.concat("base", "added")
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(both).alias("spans"), F.size(both).cast("long").alias("n_spans"))


def brute_force(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Base spans read literally from the contract, for tests."""
    import re

    text = text or ""

    def luhn(d):
        return sum((2 * x - 9 if x > 4 else 2 * x) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = {}
    for kind, p in patterns.items():
        spans = []
        for m in re.finditer(p, text):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in v.split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            spans.append(m.span())
        out[kind] = spans
    return out
