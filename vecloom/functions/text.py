"""Word windows of texts and stable ids of their chunks."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.errors import InvalidArgument

_BLANK = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column | str) -> Column:
    """Words separated by runs of Unicode white space; an empty array for an empty or null text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), _BLANK), lambda w: w != "")


def window_texts(text: str | None, most: int, overlap: int) -> list[str]:
    """The word windows of one text, see :func:`word_windows`."""
    own = (text or "").split()
    count = max(1, -(-(len(own) - most) // (most - overlap)) + 1) if own else 0
    return [" ".join(own[i * (most - overlap) :][:most]) for i in range(count)]


def _windows(most: int, overlap: int, rows: int = 512):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                pieces = [window_texts(t, most, overlap) for t in part.columns[-1].to_pylist()]
                counts = np.array([len(p) for p in pieces])
                take = pa.array(np.repeat(np.arange(len(pieces)), counts))
                number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                kept = [c.take(take) for c in part.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(number, pa.int32()), pa.array([x for p in pieces for x in p], pa.string())], names=[*part.schema.names[:-1], "chunk_id", part.schema.names[-1]])

    return run


def word_windows(documents: DataFrame, most: int, overlap: int, text: str = "text") -> DataFrame:
    """All columns of ``documents`` but ``text``, with ``chunk_id INT`` and ``text``: a row per window of up to ``most`` words.

    Words are separated by Unicode white space and joined by single blanks. A window begins every ``most -
    overlap`` words; the last one is the first that reaches the end of the text. A text without words, an
    empty or null one gives no row. Arrow batches: the same as nested array expressions, which are
    interpreted, took three times as long.
    """
    if most <= 0 or not 0 <= overlap < most:
        raise InvalidArgument("need most > 0 and 0 <= overlap < most")
    kept = [c for c in documents.columns if c not in (text, "chunk_id")]
    rows = documents.select(*kept, F.col(text).cast("string").alias(text))
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("chunk_id", T.IntegerType()), T.StructField(text, T.StringType())])
    return rows.mapInArrow(_windows(most, overlap), schema)


@F.pandas_udf(T.DecimalType(20, 0))
def stable_vector_id(document: pd.Series, chunk: pd.Series) -> pd.Series:
    """Unsigned 64 bits of a hash of the document id and the chunk number; null if either is null."""

    def one(d, c):
        if d is None or pd.isna(c):
            return None
        return Decimal(int.from_bytes(hashlib.blake2b(f"{d}\0{int(c)}".encode(), digest_size=8).digest(), "little"))

    return pd.Series([one(d, c) for d, c in zip(document, chunk, strict=True)], dtype=object)


def check_documents(documents: DataFrame) -> None:
    """Raise for null or empty document ids and for repeated ones."""
    empty = documents.where(F.coalesce(F.col("document_id"), F.lit("")) == "").limit(1).count()
    repeated = documents.groupBy("document_id").count().where("count > 1").limit(1).count()
    if empty or repeated:
        raise InvalidArgument("document_id must not be empty" if empty else "duplicate document_id")


def chunk_rows(documents: DataFrame, most: int, overlap: int) -> DataFrame:
    """``(vector_id DECIMAL(20,0), document_id, chunk_id, text, source)``: the word windows of every document.

    ``documents`` has ``document_id STRING, text STRING, source STRING``. A null source is empty; null and
    empty texts and texts of white space give no chunk.
    """
    pieces = word_windows(documents.select("document_id", F.coalesce("source", F.lit("")).alias("source"), "text"), most, overlap)
    return pieces.select(stable_vector_id("document_id", "chunk_id").alias("vector_id"), "document_id", "chunk_id", "text", "source")
