"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 16


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Counts at most ``rows + 1`` rows, so the check itself stays cheap on any input."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    salt_from: list[str] | None = None,
    salts: int = SALTS,
    small: bool | None = None,
) -> DataFrame:
    """Join a large side to a lookup side.

    A lookup side of checked size is broadcast. A larger one is shuffled; since one key may own a
    third of the left rows, the left side is spread over ``salts`` sub-keys taken from
    ``salt_from`` and the lookup side is repeated once per salt. ``small`` hands in the outcome
    of a size check the caller has already made.
    """
    if is_small(right) if small is None else small:
        return left.join(F.broadcast(right), on, how)
    if not salt_from:
        return left.join(right, on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
