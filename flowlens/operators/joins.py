"""Joins whose keys are not evenly used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def spread_join(
    rows: DataFrame, table: DataFrame, keys: Sequence[str] | str, by: str, how: str = "inner"
) -> DataFrame:
    """rows joined with `table` on `keys`, of which one value may hold a large part of the rows.

    A key's rows are dealt into SALTS parts by a hash of column `by`. The table is joined with the distinct (keys,
    part) first, so the rows of a hot key meet its entries in many tasks, and a rare key's entries are not copied.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    parts = salted.select(*keys, "_salt").distinct()
    return salted.join(parts.join(table, keys), [*keys, "_salt"], how).drop("_salt")
