"""Checksums and digests of bytes and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 64-bit FNV-1a. Fixed values.
FNV_OFFSET, FNV_PRIME = 14_695_981_039_346_656_037, 1_099_511_628_211


def fnv1a(data: bytes, start: int = FNV_OFFSET) -> int:
    """64-bit FNV-1a of bytes in order, going on from ``start``."""
    value = start
    for byte in data:
        value = (value ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return value


def fnv1a_all(values: list[bytes], block: int = 1024) -> np.ndarray:
    """64-bit FNV-1a of many values: all values of a block go one byte on at a time, so the loop is as long as the longest."""
    out = np.full(len(values), FNV_OFFSET, np.uint64)
    order = np.argsort([-len(v) for v in values], kind="stable")
    for at in range(0, len(order), block):
        own = order[at : at + block]
        sizes = np.array([len(values[i]) for i in own])
        data = np.zeros((sizes[0], len(own)), np.uint64)
        for column, i in enumerate(own):
            data[: sizes[column], column] = np.frombuffer(values[i], np.uint8)
        state, live = out[own], np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        for row, count in zip(data, live.tolist(), strict=True):
            state[:count] = (state[:count] ^ row[:count]) * np.uint64(FNV_PRIME)
        out[own] = state
    return out


@F.pandas_udf(T.BinaryType())
def original_bits(values: pd.Series) -> pd.Series:
    """The vector's components as little-endian 32-bit floats: 0.0 and -0.0 differ; null for a null vector."""
    # a null component is a NaN; each vector arrives as one array
    return pd.Series([None if v is None else np.asarray(v, "<f4").tobytes() for v in values], dtype=object)


@F.pandas_udf(T.BinaryType())
def fnv1a_bytes(values: pd.Series) -> pd.Series:
    """64-bit FNV-1a of each binary value as 8 little-endian bytes; null for null."""
    hashes = fnv1a_all([b"" if v is None else bytes(v) for v in values]).astype("<u8")
    return pd.Series([None if v is None else h.tobytes() for v, h in zip(values, hashes, strict=True)], dtype=object)


def request_digest(values: str):
    """SHA-256 of a vector's original bits, lower-case hex."""
    return F.sha2(original_bits(values), 256)


def operation_key(epoch: str = "epoch", operation: str = "operation_id"):
    """The key of an operation as one binary value: 8 little-endian bytes of the epoch, then the id."""
    return F.concat(F.unhex(F.expr(f"concat_ws('', transform(sequence(0, 7), i -> lpad(hex(shiftrightunsigned({epoch}, i * 8) & 255L), 2, '0')))")), F.encode(operation, "UTF-8"))


def table_digest(columns: list[str]):
    """An aggregate that is the same for the same rows in any order: XOR and sum of row hashes, and the count."""
    row = F.xxhash64(*columns)
    return F.struct(F.bit_xor(row).alias("xor"), F.sum(F.shiftrightunsigned(row, 32)).alias("sum"), F.count("*").alias("rows"))
