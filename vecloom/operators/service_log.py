"""Aggregations over request logs and insert logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_records(log: DataFrame) -> DataFrame:
    """The log without rows that are repeated unchanged."""
    return log.distinct()


def status_counts(log: DataFrame, status: str = "status") -> DataFrame:
    """``(status, requests)`` per status and, with status null and ``total`` true, over all; null statuses are left out."""
    rows = log.where(F.col(status).isNotNull())
    return rows.rollup(status).agg(F.count("*").alias("requests"), (F.grouping(status) == 1).alias("total")).select(F.col(status).alias("status"), "requests", "total")


def method_summary(log: DataFrame) -> DataFrame:
    """``(method, requests, errors, rejected, rejection_rate)``: errors are statuses but OK, rejections RESOURCE_EXHAUSTED."""
    done = log.where("method is not null and status is not null")
    return done.groupBy("method").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") != "OK").alias("errors"),
        F.count_if(F.col("status") == "RESOURCE_EXHAUSTED").alias("rejected"),
        F.avg((F.col("status") == "RESOURCE_EXHAUSTED").cast("double")).alias("rejection_rate"),
    )


def log_gaps(records: DataFrame, sequence: str = "lsn") -> DataFrame:
    """``(next, problem)``: numbers that break a sequence, as they have no predecessor (gap) or occur again (repeated).

    The first number may be any. Nothing is sorted: whether the number before exists is told by an equi-join
    of counts. Nulls are ignored.
    """
    counts = records.where(F.col(sequence).isNotNull()).groupBy(F.col(sequence).alias("n")).agg(F.count("*").alias("c"))
    first = counts.agg(F.min("n")).first()[0]
    before = counts.select((F.col("n") + 1).alias("n"), F.lit(1).alias("has"))
    checked = counts.join(before, "n", "left").select(F.col("n").alias("next"), F.when(F.col("c") > 1, "repeated").when(F.col("has").isNull() & (F.col("n") != F.lit(first)), "gap").alias("problem"))
    return checked.where("problem is not null")


def epoch_usage(operations: DataFrame, dimension: int) -> DataFrame:
    """``(epoch, operations, bytes)``: the quota each epoch uses; an operation costs 80 + 8 + its id's bytes + 4 per component."""
    size = F.lit(80 + 8 + 4 * dimension) + F.octet_length("operation_id")
    return operations.groupBy("epoch").agg(F.count("*").alias("operations"), F.sum(size).cast("bigint").alias("bytes"))


def retained(operations: DataFrame, current: int, epochs: int) -> DataFrame:
    """Operations of the last ``epochs`` epochs up to the current one."""
    return operations.where(F.col("epoch").between(max(0, current - epochs + 1), current))


def inter_arrival(log: DataFrame, node: str = "node", at: str = "arrived_at", parts: int = 64) -> DataFrame:
    """``(node, records, longest_gap_s)``: the longest time between two records of a node.

    A node may hold any share of the log, so its records are first cut into time slices that are ranked
    apart; the gaps between slices come from their first and last times.
    """
    rows = log.where(F.col(at).isNotNull()).select(node, F.col(at).cast("timestamp").alias("at"))
    sliced = rows.withColumn("slice", F.date_trunc("day", "at"))
    order = Window.partitionBy(node, "slice").orderBy("at")
    inside = sliced.withColumn("gap", F.unix_micros("at") - F.unix_micros(F.lag("at").over(order)))
    per_slice = inside.groupBy(node, "slice").agg(F.count("*").alias("n"), F.max("gap").alias("gap"), F.min("at").alias("first"), F.max("at").alias("last"))
    across = Window.partitionBy(node).orderBy("slice")
    joined = per_slice.withColumn("between", F.unix_micros("first") - F.unix_micros(F.lag("last").over(across)))
    return joined.groupBy(node).agg(F.sum("n").alias("records"), (F.greatest(F.max("gap"), F.max("between")) / 1e6).alias("longest_gap_s"))
