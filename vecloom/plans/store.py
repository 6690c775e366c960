"""A vector store of immutable versions: Parquet parts named by a pointer file that is swapped atomically."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.errors import InvalidArgument, LimitExceeded, ReadOnlyStore, SnapshotMismatch, VectorError
from vecloom.functions import vector
from vecloom.limits import ResourceLimits
from vecloom.operators import knn
from vecloom.plans.files import Folder
from vecloom.plans.serving import SearchContext
from vecloom.sources.manifest import MAX_REVISION

_POINTER = "CURRENT.json"
ROWS = "vector_id bigint, values array<float>"


@dataclass(frozen=True)
class SnapshotIdentity:
    """Names a published snapshot; generation 0 is an unmanaged one."""

    snapshot_id: str = ""
    generation: int = 0
    embedding_revision: str = ""


@dataclass(frozen=True)
class Snapshot:
    """One version of a store. Its parts never change, so a reader keeps what it has while others appear."""

    version: int
    size: int
    parts: tuple[str, ...] = ()
    deletions: tuple[tuple[str, int], ...] = ()
    identity: SnapshotIdentity = field(default_factory=SnapshotIdentity)

    def as_json(self) -> dict:
        return {"version": self.version, "size": self.size, "parts": list(self.parts), "deletions": [list(d) for d in self.deletions], "identity": vars(self.identity)}

    @staticmethod
    def of(value: dict) -> Snapshot:
        return Snapshot(value["version"], value["size"], tuple(value["parts"]), tuple((n, p) for n, p in value["deletions"]), SnapshotIdentity(**value["identity"]))


class VectorStore:
    """Vectors of one dimension under unique ids, searched exactly by cosine.

    Rows are stored at length 1. A batch is checked as a whole before anything is written: size, repeated
    ids, dimensions, finite and non-zero vectors; then the rows before the first one whose id is stored
    already are added and that row is an error. Deleting frees an id. Each change writes one part and swaps
    the pointer.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, read_only: bool = False, max_batch: int = 10_000, limits: ResourceLimits | None = None):
        self.spark, self.folder, self.read_only = spark, Folder(spark, path), read_only
        self.max_batch, self.limits = max_batch, limits or ResourceLimits()
        self._lock = threading.RLock()
        self.successful_queries = self.failed_queries = self.inserted_vectors = 0
        if self.folder.exists(_POINTER):
            self.dimension = self.folder.read_json("STORE.json")["dimension"]
            if dimension not in (None, self.dimension):
                raise InvalidArgument(f"the store has dimension {self.dimension}")
        else:
            if not dimension or dimension < 0:
                raise InvalidArgument("dimension must be positive")
            self.limits.check_shape(dimension, 0)
            self.dimension = dimension
            self.folder.claim("STORE.json", {"dimension": dimension})
            self.folder.claim(_POINTER, Snapshot(1, 0).as_json())
        self._snapshot = Snapshot.of(self.folder.read_json(_POINTER))

    @property
    def snapshot(self) -> Snapshot:
        return self._snapshot

    def refresh(self) -> Snapshot:
        """Read the pointer again, as after a change by another process."""
        self._swap(Snapshot.of(self.folder.read_json(_POINTER)), write=False)
        return self._snapshot

    def _swap(self, snapshot: Snapshot, write: bool = True) -> None:
        if write:
            self.folder.write_json(_POINTER, snapshot.as_json())
        self._snapshot = snapshot

    def rows(self, snapshot: Snapshot | None = None) -> DataFrame:
        """``(vector_id, values)`` of a version: its parts without the rows deleted after each part was added."""
        s = snapshot or self._snapshot
        if not s.parts:
            return self.spark.createDataFrame([], ROWS)
        if not s.deletions:
            return self.spark.read.schema(ROWS).parquet(*[f"{self.folder.path}/{p}" for p in s.parts])
        numbered = [self.spark.read.schema(ROWS).parquet(f"{self.folder.path}/{p}").withColumn("part", F.lit(i)) for i, p in enumerate(s.parts)]
        rows = numbered[0]
        for more in numbered[1:]:
            rows = rows.unionByName(more)
        gone = None
        for name, before in s.deletions:
            one = self.spark.read.parquet(f"{self.folder.path}/{name}").select("vector_id", F.lit(before).alias("before"))
            gone = one if gone is None else gone.unionByName(one)
        latest = gone.groupBy("vector_id").agg(F.max("before").alias("before"))
        return rows.join(latest, "vector_id", "left").where("before is null or part >= before").select("vector_id", "values")

    def _frame(self, rows: DataFrame | Sequence[tuple[int, Sequence[float]]]) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows.select(F.col("vector_id").cast("bigint").alias("vector_id"), "values")
        return self.spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], ROWS)

    def add(self, vector_id: int, values: Sequence[float]) -> int:
        """Add one vector; returns the new size. Errors: dimension, id taken, then a vector without direction."""
        if self.read_only:
            raise ReadOnlyStore("the store is read-only")
        with self._lock:
            if len(values) != self.dimension:
                raise InvalidArgument("dimension")
            one = self._frame([(vector_id, values)])
            if not self.rows().where(F.col("vector_id") == vector_id).isEmpty():
                raise InvalidArgument("duplicate id")
            knn.check_vectors(one, self.dimension)
            self._append(one, 1)
            return self._snapshot.size

    def add_batch(self, rows: DataFrame | Sequence[tuple[int, Sequence[float]]], order: str | None = None) -> int:
        """Add a batch of at most ``max_batch`` rows; returns how many. ``order`` names the column a table is ordered by."""
        if self.read_only:
            raise ReadOnlyStore("the store is read-only")
        if isinstance(rows, DataFrame):
            # a batch is bounded by max_batch, so it can be numbered as a whole
            ranked = rows.select(F.col("vector_id").cast("bigint").alias("vector_id"), "values", (F.col(order) if order else F.col("vector_id")).alias("at")).limit(self.max_batch + 1)
            batch = ranked.withColumn("n", F.expr("row_number() over (order by at, vector_id)"))
        else:
            batch = self.spark.createDataFrame([(int(i), [float(x) for x in v], n) for n, (i, v) in enumerate(rows)], f"{ROWS}, n int")
        with self._lock:
            count = batch.count()
            if count > self.max_batch:
                raise LimitExceeded(f"a batch has at most {self.max_batch} vectors")
            knn.check_vectors(batch, self.dimension)
            self.limits.check_growth(self.dimension, self._snapshot.size, count)
            taken = batch.join(self.rows().select("vector_id"), "vector_id", "left_semi").agg(F.min("n")).first()[0]
            fine = batch if taken is None else batch.where(F.col("n") < taken)
            added = count if taken is None else fine.count()
            if added:
                self._append(fine.select("vector_id", "values"), added)
            if taken is not None:
                raise InvalidArgument("duplicate id")
            return added

    def _append(self, rows: DataFrame, count: int) -> None:
        self.limits.check_growth(self.dimension, self._snapshot.size, count)
        name = f"part-{uuid.uuid4().hex}"
        rows.select("vector_id", vector.normalize_l2("values").alias("values")).write.parquet(f"{self.folder.path}/{name}")
        s = self._snapshot
        self._swap(Snapshot(s.version + 1, s.size + count, (*s.parts, name), s.deletions, s.identity))
        self.inserted_vectors += count

    def erase(self, ids: DataFrame | Sequence[int]) -> int:
        """Delete ids; returns how many were stored. Unknown ids are ignored."""
        if self.read_only:
            raise ReadOnlyStore("the store is read-only")
        gone = ids.select("vector_id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in ids], "vector_id bigint")
        with self._lock:
            name = f"deletion-{uuid.uuid4().hex}"
            self.rows().select("vector_id").join(gone, "vector_id", "left_semi").write.parquet(f"{self.folder.path}/{name}")
            count = self.spark.read.parquet(f"{self.folder.path}/{name}").count()
            if count:
                s = self._snapshot
                self._swap(Snapshot(s.version + 1, s.size - count, s.parts, (*s.deletions, (name, len(s.parts))), s.identity))
            return count

    def compact(self) -> int:
        """Write all rows anew as one part without deletions; returns their number. Older versions stay readable until :meth:`vacuum`."""
        with self._lock:
            name = f"part-{uuid.uuid4().hex}"
            self.rows().write.parquet(f"{self.folder.path}/{name}")
            size = self.spark.read.parquet(f"{self.folder.path}/{name}").count()
            self._swap(Snapshot(self._snapshot.version + 1, size, (name,), (), self._snapshot.identity))
            return size

    def vacuum(self) -> list[str]:
        """Delete the store's own folders that the current version does not name; returns their names."""
        with self._lock:
            kept = {*self._snapshot.parts, *(n for n, _ in self._snapshot.deletions)}
            old = [n for n in self.folder.names() if n.startswith(("part-", "deletion-")) and n not in kept]
            for name in old:
                self.folder.delete(name)
            return old

    def search(self, query: Sequence[float], k: int, context: SearchContext | None = None) -> list[tuple[int, float]]:
        """The k best (id, score) of one query, by the version that is current now.

        Checked in this order: limit of k, deadline and cancellation, expected snapshot; with k 0 the result
        is then empty, whatever the query.
        """
        context = context or SearchContext()
        try:
            self.limits.check_top_k(k)
            context.check()
            snapshot = self._snapshot
            if context.expected_snapshot_id and context.expected_snapshot_id != snapshot.identity.snapshot_id:
                raise SnapshotMismatch("another snapshot is served")
            found: list[tuple[int, float]] = []
            if k > 0:
                asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id bigint, query array<float>")
                knn.check_queries(asked, self.dimension, k)
                found = [(r.vector_id, r.score) for r in context.run(self.spark, lambda: self.search_all(asked, k, snapshot).orderBy("rank").collect())]
            context.check()
        except VectorError:
            with self._lock:
                self.failed_queries += 1
            raise
        with self._lock:
            self.successful_queries += 1
        return found

    def search_all(self, queries: DataFrame, k: int | str, snapshot: Snapshot | None = None) -> DataFrame:
        """``(query_id, rank, vector_id, score)`` of many queries (``query_id, query``)."""
        return knn.knn(queries, self.rows(snapshot), k, self.dimension, limits=self.limits)

    def stats(self) -> dict:
        """Counters and the served snapshot."""
        s = self._snapshot
        return {"size": s.size, "dimension": self.dimension, "successful_queries": self.successful_queries, "failed_queries": self.failed_queries, "inserted_vectors": self.inserted_vectors, "read_only": self.read_only, "snapshot_version": s.version, **vars(s.identity)}

    def prepare(self, rows: DataFrame, identity: SnapshotIdentity) -> Snapshot:
        """Write a checked replacement of all rows without serving it yet; its generation must be new."""
        if not self.read_only:
            raise ReadOnlyStore("only a read-only store takes snapshots")
        if not identity.snapshot_id or len(identity.snapshot_id) > MAX_REVISION or identity.generation <= 0 or len(identity.embedding_revision.encode()) > MAX_REVISION:
            raise InvalidArgument("snapshot identity")
        if identity.generation <= self._snapshot.identity.generation:
            raise SnapshotMismatch("the generation must grow")
        own = self._frame(rows)
        knn.check_vectors(own, self.dimension)
        name = f"part-{uuid.uuid4().hex}"
        own.select("vector_id", vector.normalize_l2("values").alias("values")).write.parquet(f"{self.folder.path}/{name}")
        size = self.spark.read.parquet(f"{self.folder.path}/{name}").count()
        self.limits.check_shape(self.dimension, size)
        return Snapshot(self._snapshot.version + 1, size, (name,), (), identity)

    def activate(self, snapshot: Snapshot) -> None:
        """Serve a prepared snapshot; searches that run keep the version they began with."""
        with self._lock:
            if snapshot.identity.generation <= self._snapshot.identity.generation or snapshot.version != self._snapshot.version + 1:
                raise SnapshotMismatch("the snapshot was prepared against another version")
            self._swap(snapshot)
