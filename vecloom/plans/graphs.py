"""A graph index as a store of immutable versions: insert, delete, rebuild and publish by swapping a pointer file."""

from __future__ import annotations

import threading
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.errors import InvalidArgument
from vecloom.operators import hnsw
from vecloom.operators.lookup import check_same_ids
from vecloom.plans.files import Folder

_POINTER = "GRAPH.json"


class GraphStore:
    """One graph index in a folder. Every change writes a new version, checks it, and then names it in the pointer.

    A change that fails, whether by a refused vector or by a lost process, leaves the version that was named.
    """

    def __init__(self, spark: SparkSession, path: str, config: hnsw.GraphConfig | None = None, shards: int = 1):
        self.spark, self.folder, self._lock = spark, Folder(spark, path), threading.RLock()
        if not self.folder.exists(_POINTER):
            if config is None or shards <= 0:
                raise InvalidArgument("a new graph store needs a configuration and shards")
            self.folder.claim(_POINTER, {"version": 0, "part": None, "shards": shards, "config": asdict(config)})
        self._state = self.folder.read_json(_POINTER)
        self.config, self.shards = hnsw.GraphConfig(**self._state["config"]), self._state["shards"]
        if config is not None and config != self.config:
            raise InvalidArgument("the stored index has another configuration")

    @property
    def version(self) -> int:
        return self._state["version"]

    def index(self) -> DataFrame:
        """The index of the version that is named now."""
        part = self._state["part"]
        return self.spark.createDataFrame([], hnsw.SCHEMA) if part is None else self.spark.read.schema(hnsw.SCHEMA).parquet(f"{self.folder.path}/{part}")

    def _publish(self, index: DataFrame, check=None, shards: int | None = None) -> int:
        """Write a version, read it back, check it, and only then swap the pointer; returns its number."""
        name = f"graph-{uuid.uuid4().hex}"
        try:
            index.write.parquet(f"{self.folder.path}/{name}")
            stored = self.spark.read.schema(hnsw.SCHEMA).parquet(f"{self.folder.path}/{name}")
            broken = hnsw.broken_edges(stored).limit(1).collect()
            if broken:
                raise InvalidArgument(f"the new graph has a broken edge: {broken[0].problem}")
            if check is not None:
                check(stored)
        except BaseException:
            self.folder.delete(name)
            raise
        state = self._state | {"version": self.version + 1, "part": name, "shards": shards or self.shards}
        self.folder.write_json(_POINTER, state)
        self._state, self.shards = state, state["shards"]
        return self.version

    def insert(self, vectors: DataFrame) -> int:
        """Add vectors (``vector_id, values``) to the stored graphs, all or none of them."""
        with self._lock:
            return self._publish(hnsw.insert(self.index(), vectors, self.config, self.shards))

    def erase(self, deleted: DataFrame) -> int:
        """Mark nodes (``vector_id``) as deleted; they lead on, and their ids stay reserved until a rebuild."""
        with self._lock:
            return self._publish(hnsw.erase(self.index(), deleted))

    def rebuild(self) -> int:
        """Graphs of the live vectors only; published if they have exactly the ids that were live."""
        with self._lock:
            live = hnsw.live_ids(self.index())
            return self._publish(hnsw.rebuild(self.index(), self.config), lambda stored: check_same_ids(stored.select("vector_id"), live))

    def search(self, queries: DataFrame, k: int, ef: int | None = None) -> DataFrame:
        return hnsw.search(self.index(), queries, k, self.config, ef)

    def stats(self) -> dict:
        return hnsw.stats(self.index()).first().asDict() | {"version": self.version, "shards": self.shards}

    def import_files(self, path: str, overwrite: bool = False) -> int:
        """Take over binary graph files, a shard each. An index that is not empty is only replaced with ``overwrite``.

        As their vectors were not dealt by id, the shards of imported files can be searched and rebuilt, and
        with one file also inserted into.
        """
        with self._lock:
            if not overwrite and not self.index().isEmpty():
                raise InvalidArgument("the store has an index")
            index = hnsw.from_files(self.spark, path)
            count = index.agg(F.max("shard")).first()[0]
            return self._publish(index, shards=1 if count is None else count + 1)

    def export_file(self, path: str, overwrite: bool = False) -> None:
        """The binary file of a store of one shard: written under another name, read back and validated, then renamed."""
        target = Folder(self.spark, path.rsplit("/", 1)[0])
        target.write_bytes(path.rsplit("/", 1)[1], hnsw.to_file(self.index(), self.config).encode(), overwrite, hnsw.GraphFile.decode)

    def vacuum(self) -> list[str]:
        """Remove versions that the pointer does not name; readers of older versions must be done."""
        old = [n for n in self.folder.names() if n.startswith("graph-") and n != self._state["part"]]
        for name in old:
            self.folder.delete(name)
        return old
