"""Manifests of snapshots and of text datasets: small JSON files that are read strictly."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.errors import InvalidArgument
from vecloom.functions.arrow_vectors import normalise
from vecloom.functions.text import check_documents, chunk_rows
from vecloom.operators.lookup import check_same_ids
from vecloom.plans.files import Folder, SharedFile
from vecloom.session import materialise
from vecloom.sources import jsonl, snapshot_file

#: Bytes of a manifest and of a revision at most, and the smallest snapshot. Fixed values.
MAX_MANIFEST, MAX_REVISION, MIN_SNAPSHOT = 16_384, 256, 56
#: Columns of a manifest table; a file has the same fields, of which those of OPTIONAL may be absent. Fixed values.
COLUMNS = {
    "format_version": "decimal(20,0)",
    "snapshot_id": "string",
    "index_type": "string",
    "dimension": "decimal(20,0)",
    "vector_count": "decimal(20,0)",
    "file_size": "decimal(20,0)",
    "sha256": "string",
    "embedding_revision": "string",
}
OPTIONAL = {"embedding_revision": ""}
#: What has to hold of each column, as SQL over a manifest table, in the order in which breaches are named.
RULES = {
    "index_type": "index_type IN ('flat', 'hnsw')",
    "format_version": "format_version BETWEEN 1 AND IF(index_type = 'hnsw', 3, 1)",
    "dimension": "dimension > 0",
    "vector_count": "vector_count >= 0",
    "file_size": f"file_size BETWEEN {MIN_SNAPSHOT} AND :max_bytes",
    "sha256": "length(sha256) = 64 AND sha256 RLIKE '^[0-9a-f]{64}'",
    "snapshot_id": "snapshot_id = concat('sha256:', sha256)",
    "embedding_revision": f"octet_length(coalesce(embedding_revision, '')) <= {MAX_REVISION}",
}


def canonical_id(column: Column | str) -> Column:
    """A snapshot id is ``sha256:`` and 64 lower-case hexadecimal digits; false for null."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).rlike("^sha256:[0-9a-f]{64}\\z"), F.lit(False))


def manifest_error(max_bytes: int = 1 << 40) -> Column:
    """The first of RULES that a row of a manifest table breaks, or null; a rule over a null is broken."""
    rules = {name: rule.replace(":max_bytes", str(max_bytes)) for name, rule in RULES.items()}
    return F.coalesce(*[F.expr(f"IF(coalesce({rule}, false), NULL, '{name}')") for name, rule in rules.items()])


def as_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """A parsed manifest as a table of one row; fields that are missing, unknown or of another type are errors."""
    from decimal import Decimal

    row = OPTIONAL | manifest if isinstance(manifest, dict) else {}
    if row.keys() != COLUMNS.keys():
        raise InvalidArgument(f"manifest: fields {sorted(row.keys() ^ COLUMNS.keys())}")
    wrong = [name for name, kind in COLUMNS.items() if type(row[name]) is not (str if kind == "string" else int)]
    if wrong or any(abs(x) >= 10**20 for x in row.values() if type(x) is int):
        raise InvalidArgument(f"manifest: types or sizes of {wrong or 'numbers'}")
    values = tuple(Decimal(x) if isinstance(x, int) else x for x in (row[name] for name in COLUMNS))
    return spark.createDataFrame([values], ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items()))


def validate(spark: SparkSession, manifest: dict, max_bytes: int = (1 << 64) - 1) -> dict:
    """The manifest itself, or an error that names the rule it breaks."""
    broken = as_table(spark, manifest).select(manifest_error(max_bytes)).first()[0]
    if broken:
        raise InvalidArgument(f"manifest: {broken}")
    return manifest


def read(spark: SparkSession, source: str) -> dict:
    """A validated manifest of at most 16 KiB at a path or address of any file system the session knows."""
    content = SharedFile(spark, source).head(MAX_MANIFEST + 1)
    try:
        parsed = json.loads(content) if len(content) <= MAX_MANIFEST else None
    except ValueError as e:
        raise InvalidArgument(f"manifest: {e}") from None
    if parsed is None:
        raise InvalidArgument(f"manifest: not an object of at most {MAX_MANIFEST} bytes")
    return validate(spark, parsed)


def create(spark: SparkSession, path: str, index_type: str, dimension: int, vector_count: int, embedding_revision: str = "") -> dict:
    """The manifest of a snapshot file, whose digest is taken where the file system is read, in the JVM."""
    file = SharedFile(spark, path)
    kind, version = snapshot_file.kind_of(file.head(snapshot_file.HEAD))
    if kind != index_type:
        raise InvalidArgument(f"manifest: {path} is no {index_type} snapshot")
    digest = file.sha256()
    named = {"format_version": version, "index_type": kind, "snapshot_id": f"sha256:{digest}", "sha256": digest, "file_size": file.size()}
    return validate(spark, named | {"dimension": dimension, "vector_count": vector_count, "embedding_revision": embedding_revision})


def write_dataset(chunks: DataFrame, vectors: DataFrame, folder: str, model: str, dimension: int, most: int, overlap: int) -> dict:
    """Vectors, chunks and ``manifest.json`` of a text dataset; every vector must be of length 1 and have a chunk."""
    from vecloom.functions.vector import has_dimension, is_unit

    if not vectors.where(~has_dimension("values", dimension) | ~is_unit("values")).isEmpty():
        raise InvalidArgument("embeddings must have one dimension and length 1")
    check_same_ids(vectors, chunks)
    jsonl.write_vectors(vectors, f"{folder}/vectors.jsonl")
    chunks.select("vector_id", "document_id", "chunk_id", "text", "source").write.json(f"{folder}/chunks.jsonl")
    manifest = {"format_version": 1, "model": model, "dimension": dimension, "chunk_count": chunks.count(), "maximum_words": most, "overlap_words": overlap, "normalized_embeddings": True, "vectors_file": "vectors.jsonl", "chunks_file": "chunks.jsonl"}
    Folder(vectors.sparkSession, folder).write_json("manifest.json", manifest)
    return manifest


def _encoded(encode: Callable[[list[str]], np.ndarray], rows: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                vectors = normalise(np.asarray(encode(part.column(1).to_pylist()), np.float32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=["vector_id", "values"])

    return run


def build_dataset(documents: DataFrame, encode: Callable[[list[str]], np.ndarray], folder: str, model: str, dimension: int, most: int = 120, overlap: int = 20, rows: int = 256) -> dict:
    """Documents (``document_id, text, source``) to a text dataset: windows, stable ids, vectors by ``encode``, manifest.

    ``encode`` is the place for a text model: it takes up to ``rows`` texts and gives a matrix with a row each, in
    the tasks. Rows are brought to length 1; a row of another dimension or without direction is an error.
    """
    check_documents(documents)
    chunks = materialise(chunk_rows(documents, most, overlap), "chunks")
    vectors = materialise(chunks.select("vector_id", "text").mapInArrow(_encoded(encode, rows), "vector_id decimal(20,0), values array<float>"), "encoded")
    return write_dataset(chunks, vectors, folder, model, dimension, most, overlap)


def read_dataset(spark: SparkSession, folder: str) -> tuple[dict, DataFrame, DataFrame]:
    """Manifest, vectors and chunks of a text dataset, checked against each other."""
    from vecloom.functions.vector import has_dimension, is_unit

    manifest = Folder(spark, folder).read_json("manifest.json")
    vectors = jsonl.read_vectors(spark, f"{folder}/{manifest['vectors_file']}")
    chunks = jsonl.read_chunks(spark, f"{folder}/{manifest['chunks_file']}")
    if not vectors.where(~has_dimension("values", manifest["dimension"]) | ~is_unit("values")).isEmpty():
        raise InvalidArgument("dataset: vectors")
    if vectors.count() != manifest["chunk_count"] or chunks.count() != manifest["chunk_count"]:
        raise InvalidArgument("dataset: counts")
    check_same_ids(vectors, chunks)
    return manifest, vectors, chunks
