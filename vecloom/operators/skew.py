"""Joins in which one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import materialise, stored_rows

#: Rows of one key that one task may hold, and how many keys at most can be told to every task.
ROWS, KEYS = 100_000, 4_096


def split_joins(many: DataFrame, others: list[tuple[DataFrame, list[str]]], rows: int = ROWS, total: int | None = None) -> DataFrame:
    """:func:`split_join` to several tables in turn, each of at most one row a key; a large table is stored in between."""
    total = total if total is not None else stored_rows(many)
    for i, (few, on) in enumerate(others):
        if i and (total is None or total > rows):
            many = materialise(many, "joined")
        many = split_join(many, few, on, rows, total=total)
    return many


def split_join(many: DataFrame, few: DataFrame, on: list[str], rows: int = ROWS, how: str = "inner", total: int | None = None) -> DataFrame:
    """Equi-join of ``many`` rows a key to ``few`` rows a key, with frequent keys split over tasks.

    Rows are counted per key, with sums within tasks first. A key with more than max(``rows``, n / KEYS) rows of
    ``many``, of which there are at most KEYS, is cut into parts of about that size by a hash of the whole row; the
    rows of ``few`` go to every part. The result is that of a plain join. ``many`` is read twice, so it should be
    a stored table. With at most ``rows`` rows in all (``total``, known of stored tables) no key is counted. ``how``
    is inner, left, left_semi or left_anti. Null keys join nothing.
    """
    total = total if total is not None else stored_rows(many)
    if total is not None and total <= rows:
        return many.join(few, on, how)
    counts = many.where(" and ".join(f"`{c}` is not null" for c in on)).groupBy(*on).agg(F.count("*").alias("_n"))
    large = counts.where(F.col("_n") > rows)
    found = large.orderBy(F.desc("_n"), *on).limit(KEYS).collect()
    if not found:
        return many.join(few, on, how)
    schema = ", ".join(f"`{c}` {many.schema[c].dataType.simpleString()}" for c in on)
    hot = F.broadcast(many.sparkSession.createDataFrame([(*r[:-1], -(-r["_n"] // rows)) for r in found], f"{schema}, _parts bigint"))
    dealt = many.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*many.columns), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    spread = few.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(spread, [*on, "_part"], how).drop("_part")
