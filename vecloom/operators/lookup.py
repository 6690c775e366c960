"""Joins of search results with chunks, and checks that two id sets are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.errors import InvalidArgument


def with_chunks(results: DataFrame, chunks: DataFrame, strict: bool = True) -> DataFrame:
    """Results with the chunk of each ``vector_id``: ``document_id, chunk_id, text, source``.

    A chunk repeated unchanged counts once; of different chunks of one vector the first by document and
    number is taken. A result without a chunk has nulls, or is an error with ``strict``. The join's plan is
    left to Spark, which sends the smaller side around only if it is small.
    """
    fields = ["document_id", "chunk_id", "text", "source"]
    one = chunks.where("vector_id is not null").groupBy("vector_id").agg(F.min(F.struct(*fields)).alias("c"))
    out = results.join(one, "vector_id", "left")
    if strict and not out.where("c is null").isEmpty():
        raise InvalidArgument("a result has no chunk")
    return out.select(*results.columns, *[F.col(f"c.{f}").alias(f) for f in fields])


def id_mismatch(left: DataFrame, right: DataFrame, key: str = "vector_id") -> DataFrame:
    """``(<key>, side)``: ids that only one of two tables has, each once; nulls are ignored.

    Both sides are reduced to a mark per id before they meet, so repeated ids cost nothing.
    """
    marked = left.select(key, F.lit(1).alias("side")).union(right.select(key, F.lit(2).alias("side"))).where(F.col(key).isNotNull())
    sides = marked.groupBy(key).agg(F.min("side").alias("low"), F.max("side").alias("high"))
    return sides.where("low = high").select(key, F.when(F.col("low") == 1, "left").otherwise("right").alias("side"))


def check_same_ids(left: DataFrame, right: DataFrame, key: str = "vector_id") -> None:
    """Raise unless both tables have the same set of ids."""
    if not id_mismatch(left, right, key).isEmpty():
        raise InvalidArgument(f"the tables differ in {key}")


def survivors(rows: DataFrame, deleted: DataFrame, key: str = "vector_id") -> DataFrame:
    """Rows whose id was not deleted; a new snapshot of an exact index, in which the ids are free again."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def leaked(results: DataFrame, deleted: DataFrame) -> DataFrame:
    """Results that name a deleted id or name an id twice for one query: must be empty."""
    gone = results.join(deleted.select("vector_id").distinct(), "vector_id", "left_semi").select("query_id", "vector_id")
    return gone.union(results.groupBy("query_id", "vector_id").count().where("count > 1").select("query_id", "vector_id")).distinct()


def deletion_prefix(rows: DataFrame, percent: int, seed: int = 42, key: str = "vector_id") -> DataFrame:
    """A sample operator: the first ``percent`` of the ids in an order shuffled by ``seed``; a larger share contains the smaller.

    The order is a hash's, so the cut is found from a histogram of 65,536 hash ranges and only the rows of
    one range are ranked.
    """
    h = F.xxhash64(key, F.lit(seed))
    ids = rows.select(key).distinct().withColumn("h", h).withColumn("bin", F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 48).cast("int"))
    bins = sorted((r.bin, r.n) for r in ids.groupBy("bin").agg(F.count("*").alias("n")).collect())
    wanted = sum(n for _, n in bins) * percent // 100
    before = 0
    for number, size in bins:
        if before + size > wanted:
            cut = ids.where(F.col("bin") == number).orderBy("h", key).limit(wanted - before).select(key)
            return ids.where(F.col("bin") < number).select(key).union(cut)
        before += size
    return ids.select(key)
