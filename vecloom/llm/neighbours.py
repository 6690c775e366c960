"""Problem 4: the k most similar vectors of every vector, by balanced posting lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.arrow_vectors import best_rows, exact_scores, unpack
from vecloom.llm.cells import DATA, QUERY, CentroidGraph, Collection, Layout, fit_centroids, spread

#: Vectors a posting list should hold before replication.
LIST_ROWS = 600
#: A list that may hold more than this, replicas included, is cut into blocks, and one of over VISITS blocks is divided into lists of its own.
BLOCK_ROWS, VISITS = 16_384, 16


def _search_list(dimension: int, k: int, least: float | None):
    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        _, first = np.unique(ids, return_index=True)  # rows repeated unchanged meet in the same list
        ids, role = ids[first], table["role"].to_numpy()[first]
        vectors = unpack(table["vec"], dimension)[first]
        query, data = (role & QUERY) > 0, (role & DATA) > 0
        out = [(ids[query][q], near, score) for q, near, score in best_rows(vectors[query], ids[data], vectors[data], k, ids[query], least)] if query.any() and data.any() else []
        asked, near, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        return _lists_of(asked, near, score)

    return run


def _lists_of(asked: np.ndarray, near: np.ndarray, score: np.ndarray) -> pa.Table:
    """One row per query from rows grouped by query."""
    starts = np.flatnonzero(np.append(True, asked[1:] != asked[:-1])) if len(asked) else np.empty(0, np.int64)
    offsets = pa.array(np.append(starts, len(asked)).astype(np.int32))
    return pa.table({"id": asked[starts], "near": pa.ListArray.from_arrays(offsets, pa.array(near)), "score": pa.ListArray.from_arrays(offsets, pa.array(score.astype(np.float32)))})


def _merge_sorted(k: int):
    """Partial lists sorted by query id to the final k of each query; a query may span two batches."""

    def flat(batch):
        near, score = batch["near"].combine_chunks(), batch["score"].combine_chunks()
        asked = np.repeat(batch["id"].to_numpy(), near.value_lengths().to_numpy())
        return asked, near.flatten().to_numpy(), score.flatten().to_numpy()

    def best(asked, near, score):
        order = np.lexsort((near, asked))
        asked, near, score = asked[order], near[order], score[order]
        once = np.append(True, (asked[1:] != asked[:-1]) | (near[1:] != near[:-1])) if len(asked) else np.empty(0, bool)
        asked, near, score = asked[once], near[once], score[once]
        order = np.lexsort((near, -score, asked))
        asked, near, score = asked[order], near[order], score[order]
        kept = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
        return asked[kept], near[kept], score[kept]

    def run(batches):
        held = None
        for batch in batches:
            rows = flat(pa.Table.from_batches([batch]))
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            if not len(rows[0]):
                continue
            rows = best(*rows)
            last = rows[0] == rows[0][-1]
            held = tuple(x[last] for x in rows)
            yield from _lists_of(*(x[~last] for x in rows)).to_batches()
        if held is not None:
            yield from _lists_of(*held).to_batches()

    return run


def nearest_vectors(
    table: DataFrame,
    k: int = 5,
    queries: Column | None = None,
    least: float | None = None,
    dimension: int = 64,
    replicas: int = 3,
    data_ratio: float = 0.3,
    probes: int = 3,
    query_ratio: float = 0.3,
    list_rows: int = LIST_ROWS,
    block_rows: int = BLOCK_ROWS,
    visits: int = VISITS,
) -> DataFrame:
    """``(id, near ARRAY<BIGINT>, score ARRAY<FLOAT>)``: the k most similar vectors of each queried vector.

    ``table`` has ``id`` and ``values``; other columns are ignored. ``queries`` is a condition on ``id`` that
    says whose neighbours are wanted (default: everyone's); all vectors are searched. ``least`` leaves out
    neighbours under that cosine. Neighbours are ordered by cosine as FLOAT descending, then id ascending.

    Every vector is stored in the lists of its nearest centroid and of up to ``replicas`` - 1 more whose
    distance is at most 1 + ``data_ratio`` times the nearest one's. A query searches up to ``probes`` lists
    under the same kind of rule. Nothing within a list is approximate. The centroids come from a bounded
    sample and are found through an in-memory graph; a list that may hold more than ``block_rows`` rows is
    cut into blocks that a query visits one by one in different tasks; one of over ``visits`` blocks is divided by
    centroids of its own instead, so that the work for a query does not grow with the collection, unless most of
    its vectors are too close together to be told apart.

    Null ids and invalid vectors (null, empty, another length, null or non-finite components, all zeros)
    neither ask nor answer. Rows repeated unchanged count once. Of an id with several valid vectors one is
    kept, see :class:`~vecloom.llm.cells.Collection`. Vectors without any neighbour give no row, nor does
    an empty table.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    spark = table.sparkSession
    found = Collection.of(table, dimension, keep=k + 1)
    schema = "id bigint, near array<bigint>, score array<float>"
    if not found.n or not k:
        return spark.createDataFrame([], schema)
    sample = found.sample()
    graph = CentroidGraph(fit_centroids(sample, round(found.n / list_rows)))
    layout = Layout(dimension, (replicas, data_ratio), (probes, query_ratio), list_rows, block_rows, visits)
    rows = found.vectors().select("id", "vec", (queries if queries is not None else F.lit(True)).alias("asks"))
    partial = spread(rows, graph, sample, found.n, layout).groupBy("cell", "block").applyInArrow(_search_list(dimension, k, least), schema)
    merged = partial.repartition("id").sortWithinPartitions("id").mapInArrow(_merge_sorted(k), schema)
    if found.copies is None:
        return merged
    return merged.unionByName(_answers_of_copies(found, k, queries))


def _answers_of_copies(found: Collection, k: int, queries: Column | None) -> DataFrame:
    """A copy left out of the lists has over k smaller ids with its very vector: those are its k best."""
    kept = found._smallest().join(found.vectors(), "id").groupBy("h").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k).alias("near"), F.first("vec").alias("vec"))
    itself = kept.mapInArrow(_self_scores(found.dimension, k), "h binary, near array<bigint>, score array<float>")
    asking = found.copies.where(queries) if queries is not None else found.copies
    return asking.join(F.broadcast(itself), "h").select("id", "near", "score")


def _self_scores(dimension: int, k: int):
    def run(batches):
        for batch in batches:
            vectors = unpack(batch.column(2), dimension)
            score = exact_scores(vectors, vectors)
            lengths = batch.column(1).value_lengths().to_numpy()
            offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(np.repeat(score, lengths)))], names=["h", "near", "score"])

    return run


def similar_pairs(table: DataFrame, k: int = 5, least: float = 0.8, dimension: int = 64) -> DataFrame:
    """``(id_a, id_b)``, smaller first, each pair once: one is among the other's k best with cosine >= ``least``."""
    near = nearest_vectors(table, k, least=least, dimension=dimension)
    pairs = near.select("id", F.explode("near").alias("other"))
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
