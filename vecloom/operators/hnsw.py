"""Approximate neighbours by layered proximity graphs: one graph per shard, built and searched in Arrow workers.

An index is a table with a row per node, ``(shard, node, vector_id, vec BINARY, deleted, links
ARRAY<ARRAY<INT>>)``: ``links[l]`` are the node's neighbours on layer l. With one shard results follow the
order score descending, id ascending over a single graph; more shards are searched apart, each with the full
``ef``, and merged.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.errors import InvalidArgument
from vecloom.functions.arrow_vectors import exact_scores, normalise, pack, unpack, valid_matrix
from vecloom.limits import ResourceLimits
from vecloom.operators import evaluation
from vecloom.operators.knn import RESULT, check_vectors, knn, query_blocks, ranked
from vecloom.session import materialise
from vecloom.sources.snapshot_file import GraphFile

SCHEMA = "shard int, node int, vector_id bigint, vec binary, deleted boolean, links array<array<int>>"
#: Levels are at most this high. Fixed value.
MAX_LEVEL = 63
#: Nodes a shard should hold: graph and vectors fit a worker.
SHARD_ROWS = 50_000


@dataclass(frozen=True)
class GraphConfig:
    """Shape of a graph; the defaults of the library. Fixed values."""

    dimension: int
    max_connections: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    seed: int = 42
    heuristic: bool = False

    def __post_init__(self):
        if self.dimension <= 0 or not 2 <= self.max_connections <= ((1 << 32) - 1) // 2 or self.ef_construction < self.max_connections or self.ef_search <= 0:
            raise InvalidArgument("need dimension > 0, max_connections >= 2, ef_construction >= max_connections and ef_search > 0")


def level_of(vector_id: int, config: GraphConfig) -> int:
    """A node's highest layer: geometric with base ``max_connections``, from a hash of its id, so that it depends on nothing else."""
    digest = hashlib.blake2b(int(vector_id).to_bytes(8, "little", signed=True), digest_size=8, key=config.seed.to_bytes(8, "little")).digest()
    u = ((int.from_bytes(digest, "little") >> 11) + 1) / ((1 << 53) + 1)
    return min(int(-math.log(u) / math.log(config.max_connections)), MAX_LEVEL)


class Graph:
    """One shard's graph in memory."""

    def __init__(self, config: GraphConfig, ids: np.ndarray, vectors: np.ndarray):
        self.config, self.ids, self.vectors = config, ids, vectors.astype(np.float64)
        self.links: list[list[list[int]]] = []
        self.deleted = np.zeros(len(ids), bool)
        self.entry, self.top = -1, -1

    def scores(self, nodes: list[int], query: np.ndarray) -> np.ndarray:
        return (self.vectors[nodes] @ query).astype(np.float32)

    def insert(self, node: int) -> None:
        """Add the next node: its vector becomes reachable on its level and below."""
        level = level_of(int(self.ids[node]), self.config)
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry, self.top = node, level
            return
        query, at = self.vectors[node], self.entry
        for layer in range(self.top, level, -1):
            at = self.descend(query, at, layer)
        for layer in range(min(level, self.top), -1, -1):
            found = self.search_layer(query, at, self.config.ef_construction, layer, live_only=False)
            room = self.config.max_connections * (2 if layer == 0 else 1)
            self.links[node][layer] = self.select(found, room)
            for other in list(self.links[node][layer]):
                self.links[other][layer].append(node)
                if len(self.links[other][layer]) > room:
                    self.prune(other, layer, room)
            at = found[0][1]
        if level > self.top:
            self.entry, self.top = node, level

    def descend(self, query: np.ndarray, at: int, layer: int) -> int:
        """From neighbour to better neighbour until there is none; ties go to the smaller id."""
        best = (-float(self.scores([at], query)[0]), int(self.ids[at]))
        while self.links[at][layer]:
            near = self.links[at][layer]
            score = self.scores(near, query)
            better, next_node = min(((-float(s), int(self.ids[n])), n) for s, n in zip(score, near, strict=True))
            if better >= best:
                break
            best, at = better, next_node
        return at

    def search_layer(self, query: np.ndarray, at: int, ef: int, layer: int, live_only: bool) -> list[tuple[float, int]]:
        """Up to ``ef`` (score, node), best first. Deleted nodes are walked through, and left out with ``live_only``."""
        seen = {at}
        first = float(self.scores([at], query)[0])
        frontier = [(-first, int(self.ids[at]), at)]
        kept = [] if live_only and self.deleted[at] else [(first, -int(self.ids[at]), at)]
        while frontier:
            score, _, node = heapq.heappop(frontier)
            if len(kept) >= ef and kept[0][0] > -score:
                break
            near = [n for n in self.links[node][layer] if n not in seen]
            if not near:
                continue
            seen.update(near)
            for s, n in zip(self.scores(near, query).tolist(), near, strict=True):
                entry = (s, -int(self.ids[n]), n)
                if len(kept) < ef or entry[:2] > kept[0][:2]:
                    heapq.heappush(frontier, (-s, int(self.ids[n]), n))
                    if not (live_only and self.deleted[n]):
                        heapq.heappush(kept, entry)
                        if len(kept) > ef:
                            heapq.heappop(kept)
        return [(s, n) for s, _, n in sorted(kept, key=lambda e: (-e[0], -e[1]))]

    def select(self, found: list[tuple[float, int]], room: int) -> list[int]:
        """The best ``room`` candidates; by the heuristic those first that are nearer to the query than to any selected one."""
        if not self.config.heuristic:
            return [n for _, n in found[:room]]
        own = self.vectors[[n for _, n in found]]
        between = (own @ own.T).astype(np.float32)
        chosen, passed = [], []
        for i, (score, _) in enumerate(found):
            if len(chosen) == room:
                break
            (passed if chosen and between[i, chosen].max() >= np.float32(score) else chosen).append(i)
        return [found[i][1] for i in chosen + passed[: room - len(chosen)]]

    def prune(self, node: int, layer: int, room: int) -> None:
        """Keep the best links of a node that has too many, and drop both directions of the others."""
        near = self.links[node][layer]
        score = self.scores(near, self.vectors[node])
        order = np.lexsort((self.ids[near], -score))
        kept = self.select([(float(score[i]), near[i]) for i in order], room)
        for gone in set(near) - set(kept):
            self.links[gone][layer].remove(node)
        self.links[node][layer] = kept

    def search(self, query: np.ndarray, k: int, ef: int) -> list[int]:
        live = int(len(self.ids) - self.deleted.sum())
        if not live or not k:
            return []
        k = min(k, live)
        at = self.entry
        for layer in range(self.top, 0, -1):
            at = self.descend(query, at, layer)
        return [n for _, n in self.search_layer(query, at, max(k, ef), 0, live_only=True)[:k]]


def _build(config: GraphConfig):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at, matrix = valid_matrix(table["values"].combine_chunks(), config.dimension)
        ids = table["vector_id"].to_numpy()[at]
        ids, first = np.unique(ids, return_index=True)
        return _as_table(_built(config, ids, normalise(matrix[first])), key[0].as_py())

    return run


def _built(config: GraphConfig, ids: np.ndarray, vectors: np.ndarray) -> Graph:
    graph = Graph(config, ids, vectors)
    for node in range(len(ids)):
        graph.insert(node)
    return graph


def _as_table(graph: Graph, shard: int) -> pa.Table:
    n = len(graph.ids)
    return pa.table({"shard": pa.array([shard] * n, pa.int32()), "node": pa.array(range(n), pa.int32()), "vector_id": pa.array(graph.ids, pa.int64()), "vec": pack(graph.vectors.astype(np.float32)) if n else pa.array([], pa.binary()), "deleted": pa.array(graph.deleted), "links": pa.array(graph.links, pa.list_(pa.list_(pa.int32())))})


def build(vectors: DataFrame, config: GraphConfig, shards: int | None = None) -> DataFrame:
    """The index of ``vectors`` (``vector_id, values``).

    Invalid vectors and null ids are left out; of an id that is repeated one row is taken. Each shard (a hash
    of the id; by default as many as keep a shard at SHARD_ROWS) is built in id order, so the index does not
    depend on the partitioning. Lazy: write the result, or materialise it, before it is searched repeatedly.
    """
    rows = vectors.select(F.col("vector_id").cast("bigint").alias("vector_id"), "values").where("vector_id is not null")
    count = shards or max(1, -(-rows.count() // SHARD_ROWS))
    return rows.groupBy(shard_of(count).alias("shard")).applyInArrow(_build(config), SCHEMA)


def shard_of(count: int):
    """The shard of a ``vector_id`` in an index of so many shards."""
    return F.pmod(F.xxhash64("vector_id"), F.lit(count)).cast("int")


def _insert(config: GraphConfig):
    def run(key: tuple[pa.Scalar, ...], old: pa.Table, new: pa.Table) -> pa.Table:
        at, matrix = valid_matrix(new["values"].combine_chunks(), config.dimension)
        ids, first = np.unique(new["vector_id"].to_numpy()[at], return_index=True)
        fresh = normalise(matrix[first])
        if not old.num_rows:
            return _as_table(_built(config, ids, fresh), key[0].as_py())
        graph = _loaded(config, old)
        before = len(graph.ids)
        graph.ids, graph.vectors = np.concatenate([graph.ids, ids]), np.concatenate([graph.vectors, fresh.astype(np.float64)])
        graph.deleted = np.append(graph.deleted, np.zeros(len(ids), bool))
        for node in range(before, before + len(ids)):
            graph.insert(node)
        return _as_table(graph, key[0].as_py())

    return run


def insert(index: DataFrame, vectors: DataFrame, config: GraphConfig, shards: int) -> DataFrame:
    """The index with ``vectors`` (``vector_id, values``) added to its graphs, in id order; stored nodes keep their numbers.

    All or nothing: an id that the index has, also as a deleted node, or that occurs twice, a null id and an invalid
    vector are errors before anything is built, and as an index is a table, a failure on the way leaves the old one
    as it was. ``shards`` is the number the index was built with. No vectors give the index again.
    """
    check_vectors(vectors, config.dimension)
    rows = vectors.select(F.col("vector_id").cast("bigint").alias("vector_id"), "values")
    known = rows.join(index.select("vector_id"), "vector_id", "left_semi").limit(1).collect()
    if known:
        raise InvalidArgument(f"vector id {known[0].vector_id} is in the index")
    dealt = rows.withColumn("shard", shard_of(shards))
    return index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(_insert(config), SCHEMA)


def _loaded(config: GraphConfig, table: pa.Table) -> Graph:
    order = np.argsort(table["node"].to_numpy())
    graph = Graph(config, table["vector_id"].to_numpy()[order], unpack(table["vec"], config.dimension)[order])
    links = table["links"].to_pylist()
    graph.links = [links[i] for i in order]
    graph.deleted = table["deleted"].to_numpy(zero_copy_only=False)[order].astype(bool)
    levels = [len(x) - 1 for x in graph.links]
    graph.top = max(levels, default=-1)
    graph.entry = levels.index(graph.top) if levels else -1
    return graph


def _search(shared, config: GraphConfig, k: int, ef: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        graph = _loaded(config, table)
        ids, queries, _ = shared.value
        asked, nodes = [], []
        for i, q in enumerate(queries.astype(np.float64)):
            found = graph.search(q, k, ef)
            asked += [i] * len(found)
            nodes += found
        scores = exact_scores(queries[asked], graph.vectors[nodes].astype(np.float32)) if nodes else np.empty(0, np.float32)
        return pa.table({"query_id": ids[np.array(asked, np.int64)], "vector_id": graph.ids[np.array(nodes, np.int64)], "score": scores})

    return run


def search(index: DataFrame, queries: DataFrame, k: int, config: GraphConfig, ef: int | None = None, query_block: int | None = None) -> DataFrame:
    """``(query_id, rank, vector_id, score FLOAT)`` of ``queries`` (``query_id, query``).

    ``ef`` (default ``config.ef_search``) is raised to k. Deleted nodes lead on but are never returned; with
    fewer than k live vectors all that are reached come out. ``k`` 0 gives no row before ``ef`` is looked at;
    then an ``ef`` of 0 is an error. Invalid queries give no row. Every shard is loaded once for up to 64 MB of queries.
    """
    spark = index.sparkSession
    if k <= 0:
        return spark.createDataFrame([], RESULT)
    ef = config.ef_search if ef is None else ef
    if ef <= 0:
        raise InvalidArgument("ef must be positive")
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "query", F.lit(k).cast("bigint").alias("k")).where("query_id is not null")
    result = None
    for block in query_blocks(asked, config.dimension, query_block):
        shared = spark.sparkContext.broadcast(block)
        partial = index.groupBy("shard").applyInArrow(_search(shared, config, k, ef), "query_id bigint, vector_id bigint, score float")
        found = ranked(partial, k).select("query_id", "rank", "vector_id", "score")
        result = found if result is None else result.unionByName(found)
    return spark.createDataFrame([], RESULT) if result is None else result


def erase(index: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index with the nodes of ``deleted`` (``vector_id``) marked; graph, counts and reserved ids stay as they are."""
    gone = deleted.select("vector_id").distinct().withColumn("gone", F.lit(True))
    return index.join(gone, "vector_id", "left").select("shard", "node", "vector_id", "vec", (F.col("deleted") | F.coalesce("gone", F.lit(False))).alias("deleted"), "links")


def live_ids(index: DataFrame) -> DataFrame:
    """``(vector_id)`` of the nodes that are not deleted, ascending."""
    return index.where(~F.col("deleted")).select("vector_id").orderBy("vector_id")


def _rebuild(config: GraphConfig):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["vector_id"].to_numpy()
        order = np.argsort(ids)
        return _as_table(_built(config, ids[order], unpack(table["vec"], config.dimension)[order]), key[0].as_py())

    return run


def rebuild(index: DataFrame, config: GraphConfig) -> DataFrame:
    """A new index of the live vectors only, in id order and not normalised again; the old one is unchanged."""
    return index.where(~F.col("deleted")).groupBy("shard").applyInArrow(_rebuild(config), SCHEMA)


def stats(index: DataFrame) -> DataFrame:
    """``(nodes, live, deleted, max_level, edges, max_degree)``; edges are directed, the degree is that of one layer."""
    sizes = F.transform("links", lambda x: F.size(x))
    return index.agg(F.count("*").alias("nodes"), F.count_if(~F.col("deleted")).alias("live"), F.count_if(F.col("deleted")).alias("deleted"), F.max(F.size("links") - 1).alias("max_level"), F.coalesce(F.sum(F.aggregate(sizes, F.lit(0), lambda a, x: a + x)), F.lit(0)).alias("edges"), F.max(F.array_max(sizes)).alias("max_degree"))


def edges(index: DataFrame) -> DataFrame:
    """``(shard, layer, node, other)``: every directed edge."""
    layered = index.select("shard", "node", F.posexplode("links").alias("layer", "others"))
    return layered.select("shard", "layer", "node", F.explode("others").alias("other"))


def broken_edges(index: DataFrame) -> DataFrame:
    """Edges to a node that does not exist on their layer, to the node itself, or without the opposite edge."""
    every = edges(index)
    there = index.select("shard", F.col("node").alias("other"), F.posexplode("links").alias("layer", "_")).select("shard", "layer", "other")
    back = every.select("shard", "layer", F.col("other").alias("node"), F.col("node").alias("other"))
    missing = every.join(there, ["shard", "layer", "other"], "left_anti").withColumn("problem", F.lit("missing node"))
    one_way = every.join(back, ["shard", "layer", "node", "other"], "left_anti").withColumn("problem", F.lit("one way"))
    loops = every.where("node = other").withColumn("problem", F.lit("loop"))
    return missing.unionByName(one_way).unionByName(loops).select("shard", "layer", "node", "other", "problem")


def to_file(index: DataFrame, config: GraphConfig, limits=None) -> GraphFile:
    """The binary form of an index of one shard; a file is made in one process, so its nodes are bounded by the limits."""
    limit = (limits or ResourceLimits()).vectors
    table = index.limit(limit + 1).toArrow()
    if table.num_rows > limit or len(set(table["shard"].to_pylist())) > 1:
        raise InvalidArgument("a graph file holds one shard within the limits")
    graph = _loaded(config, table)
    return GraphFile(graph.ids.astype(np.int64).view(np.uint64), graph.vectors.astype(np.float32).reshape(len(graph.ids), config.dimension), graph.links, graph.deleted, max(graph.entry, 0), config.max_connections, config.ef_construction, config.ef_search, config.seed, config.heuristic)


def _of_files(limits):
    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = GraphFile.decode(content, limits)
                graph = Graph(GraphConfig(file.vectors.shape[1]), file.ids.view(np.int64), file.vectors)
                graph.links, graph.deleted = file.links, file.deleted
                yield from _as_table(graph, shard).to_batches()

    return run


def from_files(spark: SparkSession, path: str, limits=None) -> DataFrame:
    """The index of one or many graph files, a shard each in order of their names, decoded and fully validated by a task each."""
    files = spark.read.format("binaryFile").load(path)
    names = files.select("path").distinct().withColumn("shard", (F.row_number().over(Window.orderBy("path")) - 1).cast("int"))
    return files.join(F.broadcast(names), "path").select("shard", "content").mapInArrow(_of_files(limits), SCHEMA)


def sweep(index: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, efs: list[int], config: GraphConfig) -> DataFrame:
    """``(ef, queries, mean_recall, min_recall, short, leaked, seconds, qps)``: a search for every distinct ``ef``, in ascending order.

    ``vectors`` (``vector_id, values``) are the live vectors that the exact result is taken from; ``short`` counts queries
    with fewer results than it, ``leaked`` results that are not live.
    """
    spark = index.sparkSession
    truth = materialise(knn(queries, vectors, k, config.dimension), "truth")
    rows = []
    for ef in sorted(set(efs)):
        began = time.perf_counter()
        found = materialise(search(index, queries, k, config, ef), "found")
        took = time.perf_counter() - began
        quality = evaluation.recall_summary(evaluation.recall(truth, found)).first()
        short = evaluation.short_queries(truth, found).first().short
        gone = found.join(vectors.select("vector_id"), "vector_id", "left_anti").count()
        rows.append((ef, quality.queries, quality.mean_recall, quality.min_recall, short, gone, took, quality.queries / took))
    return spark.createDataFrame(rows, "ef int, queries bigint, mean_recall double, min_recall double, short bigint, leaked bigint, seconds double, qps double")
