"""Seeded random vectors and the small demo table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_vectors(spark: SparkSession, count: int, dimension: int, seed: int = 20_250_908, key: str = "vector_id", values: str = "values") -> DataFrame:
    """``count`` rows with components uniform in [-1, 1): a function of id, place and seed alone, so of no partitioning."""
    share = lambda i: F.shiftrightunsigned(F.xxhash64(F.col("id"), i, F.lit(seed)), 11) / F.lit(float(1 << 53))
    return spark.range(count).select(F.col("id").alias(key), F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (share(i) * 2 - 1).cast("float")).alias(values))


def demo_vectors(spark: SparkSession) -> DataFrame:
    """Three vectors for a first search."""
    return spark.createDataFrame([(101, [1.0, 0.0, 0.0]), (102, [0.8, 0.2, 0.0]), (103, [0.0, 1.0, 0.0])], "vector_id bigint, values array<float>")
