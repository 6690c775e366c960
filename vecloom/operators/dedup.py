"""Problem 2: exactly one copy of every message that was delivered at least once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY, _ORDER, _KEPT = "__key", "__order", "__kept"


def _order(columns: Sequence[str]) -> Column:
    """Arrival order as one comparable value; a missing arrival time comes last."""
    parts: list[Column] = []
    for name in columns:
        parts += [F.col(name).isNull(), F.col(name)]
    return F.struct(*parts)


def first_deliveries(deliveries: DataFrame, key: Sequence[Column], arrival: Sequence[str], unique: str) -> DataFrame:
    """``(<unique>)`` of the delivery that is kept of each message: the first by ``arrival``, then by ``unique``.

    ``key`` identifies a message; rows with a null key part identify nothing and are left out. The rank is
    taken by a minimum over (arrival, unique), which every task forms over its own rows before the shuffle,
    so a message with any share of all deliveries costs one row per task. The table itself is never
    shuffled or sorted, and columns other than these are never read.
    """
    keys = [k.alias(f"{_KEY}{i}") for i, k in enumerate(key)]
    names = [f"{_KEY}{i}" for i in range(len(keys))]
    ranked = deliveries.select(*keys, _order([*arrival, unique]).alias(_ORDER), F.col(unique).alias(_KEPT)).dropna(subset=names)
    return ranked.groupBy(*names).agg(F.min_by(_KEPT, _ORDER).alias(unique)).select(unique)


def surplus_deliveries(deliveries: DataFrame, key: Sequence[Column], arrival: Sequence[str], unique: str) -> DataFrame:
    """``(<unique>)`` of every delivery of a message but the kept one.

    Rows with a null key part make no case. Joined on ``unique``, whose values are spread evenly however
    often one message was delivered.
    """
    named = deliveries.select(F.col(unique), *[k.alias(f"{_KEY}{i}") for i, k in enumerate(key)]).dropna()
    return named.select(unique).join(first_deliveries(deliveries, key, arrival, unique), unique, "left_anti")


def exactly_once(deliveries: DataFrame, key: Sequence[Column], arrival: Sequence[str], unique: str) -> DataFrame:
    """All columns of exactly one delivery of each message, and every delivery that identifies no message.

    Equal to ``deliveries`` without :func:`surplus_deliveries`. An empty table stays empty.
    """
    return deliveries.join(surplus_deliveries(deliveries, key, arrival, unique), unique, "left_anti")


def new_messages(batch: DataFrame, stored: DataFrame, key: Sequence[str], arrival: Sequence[str], unique: str) -> DataFrame:
    """The rows of a new batch whose message is not stored yet, one of each: for incremental loads.

    ``stored`` has the ``key`` columns of all messages taken so far, by equal names; nulls never match a
    stored message. The batch is first reduced to one delivery a message, so that a message that fills the
    batch meets the stored identifiers as a single row.
    """
    once = exactly_once(batch, [F.col(k) for k in key], arrival, unique)
    return once.join(stored.select(*key).distinct(), list(key), "left_anti")


def operation_key(operation_id: str = "client_operation_id", epoch: str = "dedup_epoch") -> list[Column]:
    """The key of an insert operation: its id, byte for byte, and its epoch, where null is the unset field 0.

    An empty operation id is the unset field and identifies nothing.
    """
    return [F.when(F.col(operation_id) != "", F.col(operation_id)), F.coalesce(F.col(epoch), F.lit(0).cast("bigint"))]
