"""Arrow batches of vectors as NumPy matrices: validity, normalisation and exact scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def valid_matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable rows of a list<float> column, and their components as float32.

    A row is usable if it has exactly ``dimension`` components, all present and finite, not all zero.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dimension)
    if not len(rows):
        return rows, np.empty((0, dimension), np.float32)
    flat = column.take(pa.array(rows)).flatten()
    matrix = pc.cast(flat, pa.float32(), safe=False).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    usable = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
    if flat.null_count:
        usable &= flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dimension).all(axis=1)
    return rows[usable], np.ascontiguousarray(matrix[usable], dtype=np.float32)


def normalise(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1: squares summed in double precision in index order, result in float32."""
    wide = matrix.astype(np.float64)
    squares = np.zeros(len(wide))
    for j in range(wide.shape[1]):
        squares += wide[:, j] * wide[:, j]
    with np.errstate(divide="ignore"):
        return (wide * (1.0 / np.sqrt(squares))[:, None]).astype(np.float32)


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-wise dot products, accumulated in double precision in index order, cast to float32."""
    total = np.zeros(len(left))
    for j in range(left.shape[1]):
        total += left[:, j].astype(np.float64) * right[:, j].astype(np.float64)
    return total.astype(np.float32)


def pack(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column, one value per row."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def unpack(column: pa.Array | pa.ChunkedArray, dimension: int, dtype: type = np.float32) -> np.ndarray:
    """The inverse of :func:`pack` for a column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        parts = [unpack(chunk, dimension, dtype) for chunk in column.chunks]
        return np.concatenate(parts) if parts else np.empty((0, dimension), dtype)
    if not len(column):
        return np.empty((0, dimension), dtype)
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), dtype=dtype).reshape(len(column), dimension)


def best_rows(queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: np.ndarray | int, query_ids: np.ndarray | None = None, least: float | np.ndarray | None = None, block: int = 1024):
    """Yields (query index, id, float32 score) of the k best data rows of every query, grouped by query, best first.

    Ids of ``data`` are distinct and ascending; ``k`` and ``least``, the lowest score that counts, may differ by query. A query whose id is in ``ids``
    leaves itself out if ``query_ids`` is given. A first score in single precision keeps all rows that could
    still be among the k best; the exact scores of those decide, ties go to the smaller id.
    """
    slack = np.float32(1e-5)
    wanted = np.minimum(np.broadcast_to(np.asarray(k), len(queries)), len(data))
    least = None if least is None else np.broadcast_to(np.asarray(least, np.float32), len(queries))
    for i in range(0, len(queries), block):
        score = queries[i : i + block] @ data.T
        if query_ids is not None:
            place = np.searchsorted(ids, query_ids[i : i + block])
            own = (place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == query_ids[i : i + block])
            score[np.flatnonzero(own), place[own]] = -np.inf
        bound = np.full(len(score), -2, np.float32)
        for count in np.unique(wanted[i : i + block]):
            rows = np.flatnonzero(wanted[i : i + block] == count)
            if count == 0:
                bound[rows] = np.inf
            elif count < score.shape[1]:
                bound[rows] = np.maximum(-2, np.partition(score[rows], score.shape[1] - count, axis=1)[:, score.shape[1] - count] - slack)
        if least is not None:
            bound = np.maximum(bound, least[i : i + block] - slack)
        row, col = np.nonzero(score >= bound[:, None])
        if not len(row):
            continue
        exact = exact_scores(queries[i + row], data[col])
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < wanted[i + row]
        if least is not None:
            kept &= exact >= least[i + row]
        yield i + row[kept], ids[col[kept]], exact[kept]
