"""What a vector index has to offer, and the two kinds of the library behind it; another kind only has to have the same methods."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.plans.graphs import GraphStore
from vecloom.plans.store import VectorStore


class VectorIndex(Protocol):
    """Vectors of one dimension under unique ids that answer batches of queries by cosine."""

    def insert(self, vectors: DataFrame) -> None:
        """Add ``vector_id, values``; an id that is there already is an error."""

    def erase(self, ids: DataFrame) -> None:
        """Take ``vector_id`` out of every later result; unknown ids are ignored."""

    def live(self) -> DataFrame:
        """``vector_id`` of the vectors that can be found."""

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``query_id, rank, vector_id, score`` of ``query_id, query``: score descending, then id ascending."""


class ExactIndex:
    """A :class:`VectorStore` as an index: every search is exact."""

    def __init__(self, store: VectorStore):
        self.store = store

    def insert(self, vectors: DataFrame) -> None:
        self.store.add_batch(vectors)

    def erase(self, ids: DataFrame) -> None:
        self.store.erase(ids)

    def live(self) -> DataFrame:
        return self.store.rows().select("vector_id")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.store.search_all(queries, k)


class GraphIndex:
    """A :class:`GraphStore` as an index: searches are approximate, with ``ef`` candidates."""

    def __init__(self, store: GraphStore, ef: int | None = None):
        self.store, self.ef = store, ef

    def insert(self, vectors: DataFrame) -> None:
        self.store.insert(vectors)

    def erase(self, ids: DataFrame) -> None:
        self.store.erase(ids)

    def live(self) -> DataFrame:
        return self.store.index().where(~F.col("deleted")).select("vector_id")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.store.search(queries, k, self.ef)
