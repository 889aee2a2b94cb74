"""Header and feature-name rules.

Column names are plan-time metadata, so header rewrites (S5, P9, P20, P21) run
on ``df.columns`` in the driver and become a single ``select``/``toDF``; the
Column versions do the same rewrite when names are data (a long table's
``variable`` column).
"""

from __future__ import annotations

import re
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id-like features dropped before feature analysis (spaced headers; dotted ones have dots for spaces).
ID_LIKE_FEATURES = (
    "Object ID",
    "Object No in Organoids",
    "Object No in Organoids Selected",
    "Object No in Organoids Selected Selected",
)

# Feature columns are those whose name contains one of these words (case-sensitive).
FEATURE_NAME_PATTERN = "Region|Object"

_R_RESERVED = {
    "if", "else", "repeat", "while", "function", "for", "next", "break", "TRUE", "FALSE",
    "NULL", "Inf", "NaN", "NA", "NA_integer_", "NA_real_", "NA_character_", "in",
}


def strip_call_words(name: str) -> str:
    """Drop the Live/Dead word (with one optional space on each side) from a sheet header."""
    return re.sub(r" ?(?:Live|Dead) ?", "", name)


def strip_leading_dash(name: str) -> str:
    """Drop a leading "- " from a header."""
    return re.sub(r"^- ", "", name)


def syntactic_name(name: str) -> str:
    """R ``make.names``: invalid characters become dots, an "X" is prefixed when needed."""
    if name is None or name == "":
        return "X"
    out = re.sub(r"[^\w.]", ".", name)
    if not re.match(r"^([^\W\d_]|\.(?!\d))", out):
        out = "X" + out
    if out in _R_RESERVED:
        out = out + "."
    return out


def survey_header(name: str) -> str:
    """Syntactic name, then drop everything up to a double dot, "X." and a trailing dot."""
    return re.sub(r"^.*\.\.|X\.|\.$", "", syntactic_name(name))


def quoted(name: str) -> Column:
    """The column of that exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unique_names(names: Iterable[str]) -> list[str]:
    """R ``make.unique``: repeats of a header get .1, .2, ... (the first keeps its name)."""
    names = list(names)
    taken, seen, out = set(names), {}, []
    for n in names:
        if n not in seen:
            seen[n] = 0
            out.append(n)
            continue
        while True:
            seen[n] += 1
            new = f"{n}.{seen[n]}"
            if new not in taken:
                break
        taken.add(new)
        out.append(new)
    return out


def is_id_like(name: str) -> bool:
    """an id-like feature, in spaced or dotted header style."""
    return name.replace(".", " ") in ID_LIKE_FEATURES


def squish(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def clean_feature_label(name: str, dotted: bool = False) -> str:
    """Feature label cleanup, spaced headers (P20) or dotted headers."""
    if dotted:
        name = squish(name.replace(".", " "))
        name = name.replace(" 1 px", "").replace("1 2", "1.2").replace("2 2", "2.2")
    else:
        name = squish(name.replace(" 1 px", ""))
    # "Region." is a regex: "Region" followed by any one character.
    return re.sub(r"Region.", "", name)


def feature_columns(columns: Iterable[str], pattern: str = FEATURE_NAME_PATTERN) -> list[str]:
    """F3 at plan time: the columns whose name matches the feature pattern."""
    rx = re.compile(pattern)
    return [c for c in columns if rx.search(c)]
