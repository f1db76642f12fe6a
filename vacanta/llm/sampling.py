"""A bounded sample that costs one pass and sends nothing but its own rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

_SPACE = 2**40


def bounded_sample(rows: DataFrame, key: Column, size: int) -> DataFrame:
    """About `size` rows: those whose hashed key is small enough for the number of rows; all, if there are fewer.

    The same rows come for the same table, however it is partitioned. Rows that share a key come or go
    together; should they be very many, four times `size` of them are taken at most.
    """
    n = rows.count()
    if n <= size:
        return rows
    return rows.where(F.pmod(F.xxhash64(key), F.lit(_SPACE)) < math.ceil(size / n * _SPACE)).limit(4 * size)
