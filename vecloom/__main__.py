"""Command line: ``python -m vecloom COMMAND --help``."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vecloom.errors import InvalidArgument, VectorError
from vecloom.functions.text import chunk_rows
from vecloom.operators import evaluation, hnsw, knn, lookup
from vecloom.plans.files import SharedFile
from vecloom.plans.graphs import GraphStore
from vecloom.plans.store import VectorStore
from vecloom.session import materialise
from vecloom.sources import csv, jsonl, manifest, snapshot_file
from vecloom.sources.generate import random_vectors


def build(spark: SparkSession, a: argparse.Namespace) -> dict:
    """JSON lines to an exact snapshot file that is checked before it appears under its name."""
    if os.path.exists(a.output) and not a.overwrite:
        raise InvalidArgument(f"{a.output} exists")
    rows = jsonl.read_vectors(spark, a.input)
    dimension = a.dimension or rows.select(F.size("values")).first()[0]
    knn.check_vectors(rows, dimension)
    from vecloom.functions.vector import normalize_l2

    part = f"{a.output}.part-{os.getpid()}"
    try:
        count = snapshot_file.write_flat(rows.select("vector_id", normalize_l2("values").alias("values")), part)
        if a.expected_count is not None and count != a.expected_count:
            raise InvalidArgument(f"{count} vectors instead of {a.expected_count}")
        with open(part, "rb") as file:
            snapshot_file.FlatFile.decode(file.read())
        os.replace(part, a.output)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return manifest.create(spark, a.output, "flat", dimension, count)


def load(spark: SparkSession, a: argparse.Namespace) -> dict:
    """JSON lines into a store, in batches; the first batch with a stored id ends it."""
    rows = jsonl.read_vectors(spark, a.input).withColumn("vector_id", F.col("vector_id").cast("bigint"))
    store = VectorStore(spark, a.store, a.dimension or rows.select(F.size("values")).first()[0], max_batch=a.batch)
    count = rows.count()
    parts = -(-count // max(1, a.batch // 2))
    for i in range(parts):
        store.add_batch(rows.where(F.pmod(F.xxhash64("vector_id"), F.lit(parts)) == i))
    return store.stats()


def search(spark: SparkSession, a: argparse.Namespace) -> list:
    """The k nearest vectors of one query."""
    return [{"id": i, "score": s} for i, s in VectorStore(spark, a.store).search([float(x) for x in a.query.split(",")], a.k)]


def compact(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Write a store's live rows anew and remove what is no longer named."""
    store = VectorStore(spark, a.store)
    return {"vectors": store.compact(), "removed": len(store.vacuum())}


def validate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Recall of the graph index against the exact result, and an error if it is under the minimum."""
    vectors = csv.read_vectors(spark, a.vectors).select(F.col("id").cast("bigint").alias("vector_id"), "values")
    dimension = vectors.select(F.size("values")).first()[0]
    queries = csv.read_queries(spark, a.queries, dimension).withColumn("query_id", F.col("query_id").cast("bigint"))
    knn.check_vectors(vectors, dimension)
    knn.check_queries(queries, dimension, a.k)
    exact = knn.knn(queries, vectors, a.k, dimension)
    config = hnsw.GraphConfig(dimension, a.m, a.ef_construction, a.ef, heuristic=True)
    found = exact if a.index == "flat" else hnsw.search(hnsw.build(vectors, config), queries, a.k, config)
    row = evaluation.recall_summary(evaluation.recall(exact, found)).first().asDict()
    if (row["mean_recall"] or 0) < a.minimum_recall:
        raise InvalidArgument(f"recall {row['mean_recall']} is under {a.minimum_recall}")
    return row


def chunk(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Documents in JSON lines to chunks in JSON lines."""
    chunks = chunk_rows(jsonl.read_documents(spark, a.input), a.words, a.overlap)
    chunks.write.json(a.output)
    return {"chunks": spark.read.text(a.output).count()}


def describe(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The manifest of a snapshot file."""
    return manifest.create(spark, a.index, a.index_type, a.dimension, a.count, a.revision)


def rebuild(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A graph file of the live nodes of another one; input and output must differ, and the ids must be the same."""
    if os.path.realpath(a.input) == os.path.realpath(a.output):
        raise InvalidArgument("input and output are the same file")
    with tempfile.TemporaryDirectory() as folder:
        file = snapshot_file.GraphFile.decode(SharedFile(spark, a.input).all())
        config = hnsw.GraphConfig(file.vectors.shape[1], file.max_connections, file.ef_construction, file.ef_search, file.seed, file.heuristic)
        store = GraphStore(spark, f"{folder}/graph", config)
        store.import_files(a.input)
        before = store.stats()
        store.rebuild()
        store.export_file(a.output, a.overwrite)
        after = store.stats()
    return {"nodes_before": before["nodes"], "live": after["live"], "nodes": after["nodes"]}


def sweep(spark: SparkSession, a: argparse.Namespace) -> list:
    """Recall, short and leaked results and queries a second of a graph over generated vectors, for every ef and share of deletions."""
    vectors = materialise(random_vectors(spark, a.count, a.dimension), "vectors")
    queries = materialise(random_vectors(spark, a.queries, a.dimension, seed=a.seed, key="query_id", values="query"), "queries")
    config = hnsw.GraphConfig(a.dimension, a.m, a.ef_construction, heuristic=True)
    index, out = materialise(hnsw.build(vectors, config), "graph"), []
    for percent in sorted(set(a.deleted)):
        gone = lookup.deletion_prefix(vectors, percent)
        erased = materialise(hnsw.erase(index, gone), "erased")
        rows = hnsw.sweep(erased, queries, lookup.survivors(vectors, gone), a.k, a.ef, config).collect()
        out += [{"deleted_percent": percent, **r.asDict()} for r in rows]
    return out


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vecloom", description=__doc__)
    commands = out.add_subparsers(required=True)

    def command(f, *options):
        own = commands.add_parser(f.__name__, help=f.__doc__)
        for names, settings in options:
            own.add_argument(*names, **settings)
        own.set_defaults(run=f)

    def option(*names, **settings):
        return names, settings

    needed = {"required": True}
    command(build, option("--input", **needed), option("--output", **needed), option("--dimension", type=int), option("--expected-count", type=int), option("--overwrite", action="store_true"))
    command(load, option("--input", **needed), option("--store", **needed), option("--dimension", type=int), option("--batch", type=int, default=10_000))
    command(search, option("--store", **needed), option("--query", **needed), option("--k", type=int, default=10))
    command(compact, option("--store", **needed))
    command(validate, option("--vectors", **needed), option("--queries", **needed), option("--k", type=int, default=10), option("--index", choices=("flat", "hnsw"), default="flat"), option("--m", type=int, default=16), option("--ef-construction", type=int, default=200), option("--ef", type=int, default=50), option("--minimum-recall", type=float, default=0.0))
    command(chunk, option("--input", **needed), option("--output", **needed), option("--words", type=int, default=120), option("--overlap", type=int, default=20))
    command(describe, option("--index", **needed), option("--index-type", choices=("flat", "hnsw"), **needed), option("--dimension", type=int, **needed), option("--count", type=int, **needed), option("--revision", default=""))
    command(rebuild, option("--input", **needed), option("--output", **needed), option("--overwrite", action="store_true"))
    numbers = {"type": int, "nargs": "+"}
    command(sweep, option("--count", type=int, default=10_000), option("--dimension", type=int, default=128), option("--queries", type=int, default=1_000), option("--k", type=int, default=10), option("--m", type=int, default=16), option("--ef-construction", type=int, default=200), option("--ef", default=[10, 50, 100, 200], **numbers), option("--deleted", default=[0], **numbers), option("--seed", type=int, default=1))
    return out


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("vecloom").getOrCreate()
    try:
        print(json.dumps(a.run(spark, a)))
        return 0
    except (VectorError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
