"""Output shaping shared by the catalogue: stable types and rounding of doubles.

Doubles are rounded in two steps, identically on the Spark side and in the SQL
oracle: first onto a binary grid of 2^-20, then to six decimals.  Sums taken
in a different order differ in the last bits; decimal data (prices with two
decimals averaged over 2^k rows) often land *exactly* on a decimal rounding
tie, where such last-bit noise decides the direction.  A binary grid has no
ties for decimal data, so both engines snap to the same double, and the
second, decimal step then sees identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1_000_000.0
BINARY = 1_048_576.0  # 2^20


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to six decimals; other columns pass through."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            snapped = F.round(F.col(f"`{f.name}`").cast("double") * BINARY) / BINARY
            cols.append((F.round(snapped * SCALE) / SCALE).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def sql_rounded(sql: str, double_cols: list[str]) -> str:
    """Wrap oracle SQL so the listed double columns are rounded the same way."""
    if not double_cols:
        return sql
    rep = ", ".join(
        f'round(round("{c}" * 1048576.0) / 1048576.0 * 1000000.0) / 1000000.0 AS "{c}"' for c in double_cols
    )
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"
