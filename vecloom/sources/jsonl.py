"""Strict JSON-lines sources of vectors, documents and chunks."""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.errors import InvalidArgument
from vecloom.limits import MAX_U64

_BLANK = r"^[ \t\r\n]*$"
_ID = re.compile(r"0|[1-9][0-9]*")


def _fields(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise InvalidArgument("duplicate key")
    return out


def _reject(name: str):
    raise InvalidArgument(f"{name} is not a number")


class _Id(int):
    """A number written as an integer."""


def parse_vector(line: str) -> tuple[int, list[float]]:
    """Id and components of one line: an object with exactly ``id`` and ``values``, in any order.

    The id is an unsigned 64-bit integer without leading zeros or sign; components are numbers that are
    finite as 32-bit floats. Unknown, repeated and escaped keys and anything after the object are errors.
    """
    try:
        row = json.loads(line.strip(" \t\r\n"), object_pairs_hook=_fields, parse_int=_Id, parse_constant=_reject)
    except json.JSONDecodeError as e:
        raise InvalidArgument(f"not JSON: {e.msg}") from None
    if not isinstance(row, dict) or set(row) != {"id", "values"}:
        raise InvalidArgument("need exactly id and values")
    if re.search(r'"[^"]*\\[^"]*"\s*:', line):
        raise InvalidArgument("escaped key")
    key, values = row["id"], row["values"]
    if not isinstance(key, _Id) or not 0 <= key <= MAX_U64 or not re.search(r'"id"\s*:\s*(?:0|[1-9][0-9]*)\s*[,}]', line):
        raise InvalidArgument("id must be an unsigned 64-bit integer")
    if not isinstance(values, list) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in values):
        raise InvalidArgument("values must be an array of numbers")
    with np.errstate(over="ignore"):
        if not all(math.isfinite(np.float32(float(x))) for x in values):
            raise InvalidArgument("values must be finite")
    return int(key), [float(x) for x in values]


def _parsed(batches):
    for batch in batches:
        ids, values, errors = [], [], []
        for line in batch.column(0).to_pylist():
            try:
                key, row = parse_vector(line)
                ids.append(Decimal(key))
                values.append(row)
                errors.append(None)
            except (InvalidArgument, OverflowError) as e:
                ids.append(None)
                values.append(None)
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.decimal128(20, 0)), pa.array(values, pa.list_(pa.float32())), pa.array(errors, pa.string()), batch.column(0)], names=["vector_id", "values", "error", "line"])


def scan_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(vector_id DECIMAL(20,0), values ARRAY<FLOAT>, error, line)`` of every line that is not blank; ``error`` is null for good ones."""
    lines = spark.read.text(path).where(~F.col("value").rlike(_BLANK))
    return lines.mapInArrow(_parsed, "vector_id decimal(20,0), values array<float>, error string, line string")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(vector_id, values)`` of a file of vectors; a malformed line is an error that names the first few."""
    rows = scan_vectors(spark, path)
    bad = rows.where("error is not null").select("error", "line").limit(3).collect()
    if bad:
        raise InvalidArgument("; ".join(f"{r.error}: {r.line[:80]}" for r in bad))
    return rows.select("vector_id", "values")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_number BIGINT, value)`` of a text file, from 1; for messages about small files, as it reads a file in one task."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("n", "value")).select((F.col("n") + 1).cast("bigint").alias("line_number"), F.rtrim(F.col("value")).alias("value"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(document_id, text, source)``; the source may be absent. Malformed lines and empty or repeated ids are errors."""
    from vecloom.functions.text import check_documents

    rows = spark.read.schema("document_id string, text string, source string").option("mode", "FAILFAST").json(path)
    rows = rows.select("document_id", "text", F.coalesce("source", F.lit("")).alias("source"))
    check_documents(rows)
    if not rows.where("text is null").isEmpty():
        raise InvalidArgument("text is missing")
    return rows


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``(vector_id DECIMAL(20,0), document_id, chunk_id, text, source)``; malformed lines are errors."""
    return spark.read.schema("vector_id decimal(20,0), document_id string, chunk_id int, text string, source string").option("mode", "FAILFAST").json(path)


def write_vectors(vectors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of JSON lines that :func:`read_vectors` takes; ids are written as plain integers."""
    line = F.format_string('{"id": %s, "values": [%s]}', F.col("vector_id").cast("string"), F.array_join(F.transform("values", lambda x: x.cast("string")), ", "))
    vectors.select(line.alias("value")).write.mode(mode).text(path)
