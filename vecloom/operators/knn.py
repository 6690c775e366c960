"""Exact cosine nearest neighbours: a set of queries against all rows of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.errors import InvalidArgument
from vecloom.functions import vector
from vecloom.functions.arrow_vectors import best_rows, normalise, valid_matrix
from vecloom.limits import ResourceLimits

#: Bytes of queries that are broadcast for one pass over the vectors: 262,144 queries of 64 components.
QUERY_BYTES = 64 << 20
RESULT = "query_id bigint, rank int, vector_id bigint, score float"


#: Names of score kernels and the engine that stands for each. Fixed names.
KERNELS = {"scalar": "expression", "auto": "arrow", "avx2": "arrow"}


def resolve_kernel(name: str) -> str:
    """The engine of a named kernel: Column expressions for the exact scalar one, blocked Arrow matrices for the others.

    Both give the same scores here, as Arrow candidates are scored again in double precision.
    """
    if name not in KERNELS:
        raise InvalidArgument(f"unknown kernel: {name}")
    return KERNELS[name]


def ranked(scored: DataFrame, k: Column | int, query: str = "query_id", vector_id: str = "vector_id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their ``rank`` from 0: score descending, then id ascending.

    Ids stored as BIGINT from unsigned 64-bit numbers are ordered as unsigned. Catalyst limits each task's
    rows to the best k before the shuffle.
    """
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(vector_id).bitwiseXOR(F.lit(-(1 << 63))).asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("int"))


def check_vectors(vectors: DataFrame, dimension: int, id_column: str = "vector_id", values: str = "values") -> None:
    """Raise if a row may not be in an index: checked by one aggregation before a plan is made.

    Null ids, wrong dimensions, duplicate ids, non-finite and zero vectors are errors, in that order.
    """
    broken = vectors.select(F.col(id_column).isNull().alias("null_id"), vector.vector_error(values, dimension).alias("error"))
    counts = broken.agg(F.count_if("null_id").alias("null_id"), *[F.count_if(F.col("error") == e).alias(e) for e in ("dimension", "not finite", "zero")]).first()
    repeated = vectors.groupBy(id_column).count().where("count > 1").limit(1).count() if not counts["null_id"] else 0
    for name, count in (("null_id", counts["null_id"]), ("dimension", counts["dimension"]), ("duplicate id", repeated), ("not finite", counts["not finite"]), ("zero", counts["zero"])):
        if count:
            raise InvalidArgument(f"vectors: {name} ({count})")


def held_blocks(batches: Iterator[pa.RecordBatch], dimension: int, hold: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and normalised valid vectors of a task's (id, values) rows, ``hold`` rows and more at a time."""
    ids, rows, held = [], [], 0
    for batch in batches:
        at, matrix = valid_matrix(batch.column(1), dimension)
        ids.append(batch.column(0).take(pa.array(at)).to_numpy())
        rows.append(normalise(matrix))
        held += len(at)
        if held >= hold:
            yield np.concatenate(ids), np.concatenate(rows)
            ids, rows, held = [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(rows)


def _partial(shared, dimension: int, exclude_self: bool):
    """Candidates of each task: of every block of vectors the k best of a query that are no worse than its k-th best so far."""

    def run(batches):
        query_ids, queries, k = shared.value
        least = np.full(len(queries), -np.inf, np.float32)
        for ids, data in held_blocks(batches, dimension):
            # an id repeated in a block counts once; across blocks the final rank sees to it
            ids, first = np.unique(ids, return_index=True)
            for q, near, score in best_rows(queries, ids, data[first], k, query_ids if exclude_self else None, least):
                last = np.flatnonzero(np.append(q[1:] != q[:-1], True))
                full = last[np.diff(np.append(-1, last)) == k[q[last]]]
                least[q[full]] = np.maximum(least[q[full]], score[full])
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(near), pa.array(score)], names=["query_id", "vector_id", "score"])

    return run


def query_blocks(queries: DataFrame, dimension: int, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Valid queries (``query_id, query, k``) as (ids, unit vectors, k), at most QUERY_BYTES (or ``block`` queries) at a time."""
    most = block or max(1, QUERY_BYTES // (4 * dimension))
    first = queries.limit(most + 1).toArrow()
    blocks = 1 if first.num_rows <= most else -(-queries.count() // max(1, most * 3 // 4))
    for b in range(blocks):
        table = first if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if table.num_rows:
            at, matrix = valid_matrix(table["query"], dimension)
            if len(at):
                yield table["query_id"].to_numpy()[at], normalise(matrix), table["k"].to_numpy()[at]


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    k: int | str,
    dimension: int,
    exclude_self: bool = False,
    query_block: int | None = None,
    limits: ResourceLimits | None = None,
) -> DataFrame:
    """``(query_id, rank, vector_id, score FLOAT)``: the exact k nearest rows of every query.

    ``queries`` has ``query_id, query``, ``vectors`` has ``vector_id, values``; other columns are ignored.
    ``k`` is a number or the name of a column of ``queries``. Up to QUERY_BYTES of queries (or ``query_block``
    rows) are broadcast for one pass over the vectors; every task only emits rows that may still be among a
    query's k best, and those are shuffled once, by query. ``k`` above the number of vectors gives
    them all; ``k`` 0, null or negative gives no row, whatever the query. Invalid vectors (null, another
    length, null or non-finite components, zero) and null ids never answer; rows repeated under one id count
    once (of different vectors the best one). A query that is invalid, with ``k`` over 0, gives no row; use
    :func:`check_queries` to make it an error. ``exclude_self`` leaves out the vector whose id is the query's.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query").alias("query"), (F.col(k) if isinstance(k, str) else F.lit(k)).cast("bigint").alias("k")).where("query_id is not null and k > 0")
    if limits is not None:
        limits.check_top_k(asked.agg(F.max("k")).first()[0] or 0)
    source = vectors.select(F.col("vector_id").cast("bigint").alias("vector_id"), "values").where("vector_id is not null")
    result = None
    for ids, unit, sizes in query_blocks(asked, dimension, query_block):
        shared = spark.sparkContext.broadcast((ids, unit, sizes))
        partial = source.mapInArrow(_partial(shared, dimension, exclude_self), "query_id bigint, vector_id bigint, score float")
        # one shuffle serves the maximum of repeated ids and the rank
        partial = partial.repartition("query_id").groupBy("query_id", "vector_id").agg(F.max("score").alias("score"))
        found = ranked(partial, int(sizes.max()))
        if len(set(sizes.tolist())) > 1:
            limit = F.broadcast(spark.createDataFrame(list(zip(ids.tolist(), sizes.tolist(), strict=True)), "query_id bigint, k bigint"))
            found = found.join(limit, "query_id").where(F.col("rank") < F.col("k"))
        found = found.select("query_id", "rank", "vector_id", "score")
        result = found if result is None else result.unionByName(found)
    return spark.createDataFrame([], RESULT) if result is None else result


def label_scores(queries: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """``(query_label, label, pairs, total DOUBLE, best FLOAT)``: scores of every labelled query to every labelled vector, summed per two labels.

    ``queries`` has ``query_id, query, label``, ``vectors`` has ``vector_id, values, label``. Scores are added up
    within each task, block by block, and no pair becomes a row. Invalid vectors and null labels say nothing;
    repeated rows count as often as they occur.
    """
    spark = vectors.sparkSession
    asked = queries.select("query_id", "query", F.col("label").cast("bigint").alias("k")).where("query_id is not null and k is not null")
    source = vectors.select(F.col("label").cast("bigint").alias("label"), "values").where("label is not null")
    parts = None
    for _, unit, labels in query_blocks(asked, dimension):
        shared = spark.sparkContext.broadcast((unit, labels))
        own = source.mapInArrow(_summed(shared, dimension), "query_label bigint, label bigint, pairs bigint, total double, best float")
        parts = own if parts is None else parts.unionByName(own)
    if parts is None:
        return spark.createDataFrame([], "query_label bigint, label bigint, pairs bigint, total double, best float")
    return parts.groupBy("query_label", "label").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"), F.max("best").alias("best"))


def _summed(shared, dimension: int, block: int = 256):
    def run(batches):
        queries, asked = shared.value
        asked_labels, of_query = np.unique(asked, return_inverse=True)
        for labels, data in held_blocks(batches, dimension, 8_192):
            own, of_row = np.unique(labels, return_inverse=True)
            order = np.argsort(of_row, kind="stable")
            starts = np.searchsorted(of_row[order], np.arange(len(own)))
            pairs = np.bincount(of_query, minlength=len(asked_labels))[:, None] * np.bincount(of_row)[None, :]
            total, best = np.zeros(pairs.shape), np.full(pairs.shape, -np.inf, np.float32)
            wide = data[order].astype(np.float64)
            for i in range(0, len(queries), block):
                score = (queries[i : i + block].astype(np.float64) @ wide.T).astype(np.float32)
                np.add.at(total, of_query[i : i + block], np.add.reduceat(score.astype(np.float64), starts, axis=1))
                np.maximum.at(best, of_query[i : i + block], np.maximum.reduceat(score, starts, axis=1))
            q, v = (x.ravel() for x in np.meshgrid(asked_labels, own, indexing="ij"))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(pairs.ravel()), pa.array(total.ravel()), pa.array(best.ravel())], names=["query_label", "label", "pairs", "total", "best"])

    return run


def check_queries(queries: DataFrame, dimension: int, k: int | str) -> None:
    """Raise for an invalid query whose k is over 0, even if the index is empty; with k 0 nothing is checked."""
    size = (F.col(k) if isinstance(k, str) else F.lit(k)).cast("bigint")
    bad = queries.where(size > 0).select(vector.vector_error("query", dimension).alias("error")).where("error is not null").limit(1).collect()
    if bad:
        raise InvalidArgument(f"query: {bad[0].error}")


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """``(query_id, label, votes)``: the most frequent label among each query's neighbours, ties to the smaller label."""
    counts = neighbours.join(labels.select("vector_id", "label"), "vector_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    best = counts.groupBy("query_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("m"))
    return best.select("query_id", "m.label", (-F.col("m.v")).alias("votes"))
