"""Binary snapshot files of exact and graph indexes: read with full validation, and written.

Little-endian: magic, header, all ids, all vectors; graph files go on with levels and links, deletion marks
and the text of a random state. The engine's own store is Parquet; these files are for exchange.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.errors import InvalidArgument
from vecloom.functions.checksums import FNV_OFFSET, fnv1a
from vecloom.limits import ResourceLimits

#: Formats. Fixed values.
FLAT_MAGIC, FLAT_VERSION, FLAT_HEADER = b"FVINDEX\0", 1, 56
GRAPH_MAGIC, GRAPH_VERSIONS, GRAPH_HEADER = b"FVHNSW\0\0", (1, 2, 3), 112
ENDIAN_MARK, COSINE_FLAG, NO_ENTRY = 0x01020304, 1, (1 << 64) - 1
MAX_LEVEL, MAX_STATE, NORM_TOLERANCE = 63, 16 * 1024, 1e-3


#: Bytes that tell what a file is: magic and version.
HEAD = 12


def kind_of(head: bytes) -> tuple[str, int]:
    """Kind (empty if unknown) and version of a snapshot file by its first HEAD bytes."""
    magic, version = head[:8], int.from_bytes(head[8:HEAD], "little")
    return {FLAT_MAGIC: "flat", GRAPH_MAGIC: "hnsw"}.get(magic, "") if len(head) == HEAD else "", version


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise InvalidArgument(f"snapshot file: {message}")


@dataclass
class FlatFile:
    """Ids as unsigned 64-bit numbers and unit vectors as float32, row by row."""

    ids: np.ndarray
    vectors: np.ndarray

    def encode(self) -> bytes:
        payload = self.ids.astype("<u8").tobytes() + self.vectors.astype("<f4").tobytes()
        count, dimension = self.vectors.shape
        header = struct.pack("<4I4Q", FLAT_VERSION, FLAT_HEADER, ENDIAN_MARK, COSINE_FLAG, dimension, count, len(payload), fnv1a(payload))
        return FLAT_MAGIC + header + payload

    @staticmethod
    def decode(data: bytes, limits: ResourceLimits | None = None) -> FlatFile:
        _need(len(data) >= FLAT_HEADER and data[:8] == FLAT_MAGIC, "magic")
        version, header, endian, flags, dimension, count, size, checksum = struct.unpack_from("<4I4Q", data, 8)
        _need(version == FLAT_VERSION, "version")
        _need(header == FLAT_HEADER and endian == ENDIAN_MARK and flags == COSINE_FLAG, "header")
        _need(dimension > 0 and size == count * (8 + 4 * dimension) and len(data) == FLAT_HEADER + size, "size")
        (limits or ResourceLimits()).check_shape(dimension, count)
        out = FlatFile(np.frombuffer(data, "<u8", count, FLAT_HEADER), np.frombuffer(data, "<f4", count * dimension, FLAT_HEADER + 8 * count).reshape(count, dimension))
        _check_rows(out.ids, out.vectors)
        _need(fnv1a(data[FLAT_HEADER:]) == checksum, "checksum")
        return out


def _check_rows(ids: np.ndarray, vectors: np.ndarray) -> None:
    _need(len(np.unique(ids)) == len(ids), "duplicate id")
    _need(bool(np.isfinite(vectors).all()), "component that is not finite")
    wide = vectors.astype(np.float64)
    _need(bool((np.abs((wide * wide).sum(axis=1) - 1) <= NORM_TOLERANCE).all()), "vector that is not of length 1")


@dataclass
class GraphFile:
    """A graph index: links[node][layer] are node numbers, deleted marks nodes that are only walked through."""

    ids: np.ndarray
    vectors: np.ndarray
    links: list[list[list[int]]]
    deleted: np.ndarray
    entry: int = 0
    max_connections: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    seed: int = 42
    heuristic: bool = False
    state: bytes = field(default=b"0")

    def encode(self) -> bytes:
        _need(0 < len(self.state) <= MAX_STATE, "random state")
        count, dimension = self.vectors.shape
        parts = [self.ids.astype("<u8").tobytes(), self.vectors.astype("<f4").tobytes()]
        for layers in self.links:
            parts.append(struct.pack("<I", len(layers) - 1))
            parts += [struct.pack(f"<I{len(near)}I", len(near), *near) for near in layers]
        parts += [struct.pack("<Q", count - int(self.deleted.sum())), self.deleted.astype("u1").tobytes(), struct.pack("<I", len(self.state)), self.state]
        payload = b"".join(parts)
        top = max((len(layers) - 1 for layers in self.links), default=0)
        header = GRAPH_MAGIC + struct.pack("<4I6Q2I3Q", GRAPH_VERSIONS[-1], GRAPH_HEADER, ENDIAN_MARK, COSINE_FLAG, dimension, count, self.max_connections, self.ef_construction, self.ef_search, self.seed, int(self.heuristic), 0, top, self.entry if count else NO_ENTRY, len(payload))
        return header + struct.pack("<Q", fnv1a(payload, fnv1a(header))) + payload

    @staticmethod
    def decode(data: bytes, limits: ResourceLimits | None = None) -> GraphFile:
        """Versions 1 to 3: before 3 every node is live, before 2 there is no random state."""
        _need(len(data) >= GRAPH_HEADER and data[:8] == GRAPH_MAGIC, "magic")
        version, size, endian, flags, dimension, count, m, ef_c, ef_s, seed, policy, reserved, top, entry, payload, checksum = struct.unpack_from("<4I6Q2I4Q", data, 8)
        _need(version in GRAPH_VERSIONS, "version")
        _need(size == GRAPH_HEADER and endian == ENDIAN_MARK and flags == COSINE_FLAG and reserved == 0, "header")
        _need(dimension > 0 and 2 <= m <= ((1 << 32) - 1) // 2 and ef_c >= m and ef_s > 0 and policy <= 1 and count < 1 << 32 and top <= MAX_LEVEL, "configuration")
        _need(len(data) == GRAPH_HEADER + payload and payload >= count * (16 + 4 * dimension), "size")
        _need(entry < count if count else entry == NO_ENTRY and top == 0, "entry")
        (limits or ResourceLimits()).check_shape(dimension, count)
        ids = np.frombuffer(data, "<u8", count, GRAPH_HEADER)
        at = GRAPH_HEADER + 8 * count
        vectors = np.frombuffer(data, "<f4", count * dimension, at).reshape(count, dimension)
        _check_rows(ids, vectors)
        at += 4 * count * dimension
        links: list[list[list[int]]] = []
        for node in range(count):
            _need(at + 4 <= len(data), "truncated")
            (level,) = struct.unpack_from("<I", data, at)
            at += 4
            _need(level <= top, "level")
            layers = []
            for layer in range(level + 1):
                _need(at + 4 <= len(data), "truncated")
                (degree,) = struct.unpack_from("<I", data, at)
                _need(degree <= (2 * m if layer == 0 else m) and degree < count and at + 4 + 4 * degree <= len(data), "degree")
                near = list(struct.unpack_from(f"<{degree}I", data, at + 4))
                _need(all(n < count and n != node for n in near) and len(set(near)) == degree, "links")
                layers.append(near)
                at += 4 + 4 * degree
            links.append(layers)
        _need(not count or max(len(x) - 1 for x in links) == top == len(links[entry]) - 1, "top level")
        _need(all(len(links[n]) > layer for x in links for layer, near in enumerate(x) for n in near), "link to a node that is not on the layer")
        deleted, state = np.zeros(count, bool), b"0"
        if version >= 3:
            _need(at + 8 + count <= len(data), "truncated")
            (live,) = struct.unpack_from("<Q", data, at)
            marks = np.frombuffer(data, "u1", count, at + 8)
            _need(bool((marks <= 1).all()) and count - int(marks.sum()) == live, "deletion marks")
            deleted, at = marks.astype(bool), at + 8 + count
        if version >= 2:
            _need(at + 4 <= len(data), "truncated")
            (length,) = struct.unpack_from("<I", data, at)
            _need(0 < length <= MAX_STATE and at + 4 + length == len(data), "random state")
            state, at = data[at + 4 :], len(data)
        _need(at == len(data), "trailing data")
        _need(fnv1a(data[GRAPH_HEADER:], fnv1a(data[: GRAPH_HEADER - 8])) == checksum, "checksum")
        return GraphFile(ids, vectors, links, deleted, entry if count else 0, m, ef_c, ef_s, seed, policy == 1, state)


def read_flat(spark: SparkSession, path: str, limits: ResourceLimits | None = None) -> DataFrame:
    """``(vector_id DECIMAL(20,0), values ARRAY<FLOAT>)`` of one or many exact snapshot files; each is decoded by one task."""

    def rows(batches):
        import pyarrow as pa
        from decimal import Decimal

        for batch in batches:
            for content in batch.column(0).to_pylist():
                one = FlatFile.decode(content, limits)
                for i in range(0, len(one.ids), 8192):
                    part = slice(i, i + 8192)
                    yield pa.RecordBatch.from_arrays([pa.array([Decimal(int(x)) for x in one.ids[part]], pa.decimal128(20, 0)), pa.array(list(one.vectors[part]), pa.list_(pa.float32()))], names=["vector_id", "values"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "vector_id decimal(20,0), values array<float>")


def write_flat(vectors: DataFrame, path: str, limits: ResourceLimits | None = None) -> int:
    """One exact snapshot file from unit vectors (``vector_id, values``) in id order; returns their number.

    The format is one file made in one process, so the rows are bounded by the limits' number of vectors
    (1,000,000 by default) before they are collected.
    """
    limit = (limits or ResourceLimits()).vectors
    table = vectors.select(F.col("vector_id").cast("decimal(20,0)").alias("vector_id"), "values").limit(limit + 1).toArrow()
    _need(table.num_rows <= limit, "too many vectors")
    ids = np.array([int(x) for x in table["vector_id"].to_pylist()], np.uint64)
    order = np.argsort(ids)
    rows = np.array(table["values"].to_pylist(), np.float32).reshape(len(ids), -1)[order]
    _check_rows(ids[order], rows)
    with open(path, "wb") as file:
        file.write(FlatFile(ids[order], rows).encode())
    return len(ids)
