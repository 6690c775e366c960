"""CSV files of vectors, queries and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.errors import InvalidArgument


def read_vectors(spark: SparkSession, path: str, key: str = "id", dimension: int | None = None) -> DataFrame:
    """``(<key> DECIMAL(20,0), values ARRAY<FLOAT>)`` of a file with the header ``<key>,x0,x1,...``.

    The header tells the dimension, which must equal ``dimension`` if given. Rows with another number of
    columns, unreadable numbers or an id that is not an unsigned 64-bit integer are errors.
    """
    header = spark.read.text(path).first()
    names = header.value.strip().split(",") if header else []
    if len(names) < 2 or names[0] != key or names[1:] != [f"x{i}" for i in range(len(names) - 1)]:
        raise InvalidArgument(f"header must be {key},x0,x1,...")
    if dimension is not None and len(names) - 1 != dimension:
        raise InvalidArgument(f"{len(names) - 1} components instead of {dimension}")
    rows = spark.read.text(path).where((F.trim("value") != "") & (F.trim("value") != F.lit(header.value.strip()))).select(F.split(F.trim("value"), ",").alias("f"))
    parts = rows.select("f", F.when(F.col("f")[0].rlike(r"^[0-9]+$"), F.expr("try_cast(f[0] as decimal(20,0))")).alias(key), F.transform(F.slice("f", 2, len(names)), lambda x: x.try_cast("float")).alias("values"))
    largest = F.lit("18446744073709551615").cast("decimal(20,0)")
    bad = parts.where(F.col(key).isNull() | (F.col(key) > largest) | (F.size("f") != len(names)) | F.exists("values", lambda x: x.isNull()))
    if not bad.isEmpty():
        raise InvalidArgument(f"malformed row: {','.join(bad.first().f)[:80]}")
    return parts.select(key, "values")


def read_queries(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """``(query_id, query)`` of a file of queries of a given dimension."""
    return read_vectors(spark, path, "query_id", dimension).withColumnRenamed("values", "query")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, rank, vector_id, score)`` of a result file; malformed rows are errors."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema("query_id decimal(20,0), rank int, vector_id decimal(20,0), score double").csv(path)


def write_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Results as CSV with a header; scores with nine significant digits, which restore a float exactly."""
    rows = results.select("query_id", "rank", "vector_id", F.format_string("%.9g", F.col("score").cast("double")).alias("score"))
    rows.write.mode(mode).option("header", True).csv(path)


def write_vectors(vectors: DataFrame, path: str, dimension: int, key: str = "id", mode: str = "errorifexists") -> None:
    """Vectors as CSV with the header ``<key>,x0,...``; components with nine significant digits."""
    columns = [F.format_string("%.9g", F.col("values")[i].cast("double")).alias(f"x{i}") for i in range(dimension)]
    vectors.select(F.col(key), *columns).write.mode(mode).option("header", True).csv(path)


def parse_literal(column: str):
    """A vector from text such as ``1,0,0``; null if a part is no number."""
    parts = F.transform(F.split(column, ","), lambda x: F.trim(x).try_cast("float"))
    return F.when(F.forall(parts, lambda x: x.isNotNull()), parts)
