"""Bitmaps of 64-bit numbers: a filter of fixed size for rows that cannot matter; what passes is joined exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bytes in which the bit of every key (the only column, BIGINT) is set; nulls are ignored.

    Made by an OR within tasks first, so at most ``bits`` / 32 numbers reach the driver. ``bits`` is a power of two.
    """
    place = F.col(keys.columns[0]).bitwiseAND(F.lit(bits - 1))
    words = keys.select(place.alias("p")).where("p is not null").groupBy(F.expr("cast(p div 32 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int)))").alias("v"))
    table = words.toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[table["w"].to_numpy()] = table["v"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have their bit set."""
    place = (keys.view(np.int64) & (len(bits) * 8 - 1)) if len(keys) else np.empty(0, np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def bit_of(shared):
    """A function that turns a BIGINT column into whether its bit is set in the broadcast bitmap."""

    @F.pandas_udf("boolean")
    def is_set(keys):
        import pandas as pd

        return pd.Series(marked(shared.value, keys.to_numpy(np.int64)))

    def apply(column: Column) -> Column:
        return is_set(column)

    return apply
