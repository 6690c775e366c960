"""An insert log that takes every operation once: ordered commits, deduplication epochs, checkpoints, recovery.

The log is a folder of Parquet parts named by a pointer file. A batch's decisions follow from joins with the
stored operations and ids, and from one pass over the batch's keys in order; vectors stay distributed. A
crash leaves either the old pointer or the new one; parts that no pointer names are removed on recovery.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.errors import EpochError, InvalidArgument, LimitExceeded, RecoveryRequired, ResourceExhausted, VectorError
from vecloom.functions import vector
from vecloom.functions.checksums import request_digest
from vecloom.limits import ResourceLimits
from vecloom.plans.files import Folder
from vecloom.session import materialise

_POINTER = "LOG.json"
#: Bytes of an operation id, retained epochs at most, and the fixed cost of an entry. Fixed values.
MAX_OPERATION, MAX_EPOCHS, ENTRY_COST = 256, 64, 80 + 8
REQUEST = "seq bigint, operation_id string, epoch bigint, vector_id bigint, values array<float>"
RECORD = "lsn bigint, epoch bigint, operation_id string, vector_id bigint, digest string, original array<float>, values array<float>"
#: Outcomes of a request, in the order they are decided; the errors a caller of :meth:`DurableLog.commit` gets.
ERRORS: dict[str, Callable[[], VectorError]] = {
    "INVALID_REQUEST": lambda: InvalidArgument("operation id or dimension"),
    "FUTURE_EPOCH": lambda: EpochError("future or unsupported epoch"),
    "EXPIRED_EPOCH": lambda: EpochError("expired epoch"),
    "CONFLICT": lambda: InvalidArgument("operation id used with different content"),
    "CLOSED_EPOCH": lambda: EpochError("closed epoch without a matching operation"),
    "QUOTA": lambda: ResourceExhausted("epoch quota"),
    "DUPLICATE_VECTOR": lambda: InvalidArgument("vector id exists"),
    "LIMIT": lambda: ResourceExhausted("index limits"),
    "INVALID_VECTOR": lambda: InvalidArgument("vector without direction"),
}


@dataclass(frozen=True)
class Policy:
    """Deduplication window: ``current`` 0 is the mode without epochs, in which only epoch 0 is taken."""

    current: int = 0
    retained: int = 0
    operations: int = 0
    bytes: int = 0

    def __post_init__(self):
        if self.current and not (0 < self.retained <= MAX_EPOCHS and self.operations > 0 and self.bytes > 0):
            raise InvalidArgument("epoch policy")

    @property
    def oldest(self) -> int:
        return max(0, self.current - self.retained + 1) if self.current else 0


@dataclass(frozen=True)
class Outcome:
    """What became of a request: NEW and REPLAY carry the log number, of a replay the original one."""

    seq: int
    outcome: str
    lsn: int | None = None
    index_size: int | None = None

    @property
    def replayed(self) -> bool:
        return self.outcome == "REPLAY"


class DurableLog:
    """A single writer's log of inserts and the index they make."""

    def __init__(self, spark: SparkSession, path: str, dimension: int, policy: Policy | None = None, max_batch: int = 50_000, segment_rows: int | None = None, limits: ResourceLimits | None = None, hook: Callable[[str], None] | None = None):
        self.spark, self.folder, self.max_batch = spark, Folder(spark, path), max_batch
        self.segment_rows, self.limits, self._hook = segment_rows, limits or ResourceLimits(), hook or (lambda boundary: None)
        self._lock, self.recovery_required = threading.RLock(), False
        if not self.folder.exists(_POINTER):
            if dimension <= 0:
                raise InvalidArgument("dimension must be positive")
            first = {"dimension": dimension, "lsn": 0, "checkpoint_lsn": 0, "size": 0, "generation": 0, "policy": vars(policy or Policy()), "index": [], "dedup": [], "log": []}
            self.folder.claim(_POINTER, first)
        self._state = self.folder.read_json(_POINTER)
        if self._state["dimension"] != dimension:
            raise InvalidArgument(f"the log has dimension {self._state['dimension']}")
        if policy and policy.current and not self._state["policy"]["current"]:
            # history without epochs becomes epoch 0 of the window and must fit its quota
            self._publish(self._state | {"policy": vars(replace(policy, current=1))})
            self._check_quota(0)
        expected = self._state["checkpoint_lsn"]
        for part in self._state["log"]:
            if part["first"] != expected + 1 or part["last"] - part["first"] + 1 != part["rows"]:
                raise RecoveryRequired(f"log numbers do not follow {expected}")
            expected = part["last"]
        if expected != self.lsn:
            raise RecoveryRequired("the log ends early")
        self.recovered = {"records": sum(p["rows"] for p in self._state["log"]), "discarded": self.cleanup()}

    @property
    def policy(self) -> Policy:
        return Policy(**self._state["policy"])

    @property
    def lsn(self) -> int:
        return self._state["lsn"]

    @property
    def size(self) -> int:
        return self._state["size"]

    def _read(self, parts: Sequence[dict], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder.path}/{p['name']}" for p in parts])

    def index(self) -> DataFrame:
        """``(vector_id, values)`` of all inserts, at length 1."""
        rows = self._read(self._state["index"], "vector_id bigint, values array<float>")
        return rows.unionByName(self._read(self._state["log"], RECORD).select("vector_id", "values"))

    def operations(self) -> DataFrame:
        """``(epoch, operation_id, lsn, vector_id, digest)`` of the operations in the window."""
        columns = ["epoch", "operation_id", "lsn", "vector_id", "digest"]
        kept = self._read(self._state["dedup"], RECORD).select(columns).unionByName(self._read(self._state["log"], RECORD).select(columns))
        return kept.where(F.col("epoch") >= self.policy.oldest)

    def records(self) -> DataFrame:
        """The log since the last checkpoint."""
        return self._read(self._state["log"], RECORD)

    def commit(self, operation_id: str, vector_id: int, values: Sequence[float], epoch: int = 0) -> Outcome:
        """One operation; refused ones raise the error of their outcome."""
        rows = self.spark.createDataFrame([(0, operation_id, epoch, int(vector_id), [float(x) for x in values])], REQUEST)
        out = self.commit_batch(rows)[0]
        if out.outcome in ERRORS:
            raise ERRORS[out.outcome]()
        return out

    def commit_batch(self, requests: DataFrame, batch_id: str | None = None) -> list[Outcome]:
        """Decide the requests (``seq, operation_id, epoch, vector_id, values``) in order of ``seq`` and append the new ones.

        At most ``max_batch`` requests, whose keys (not vectors) come to the driver. A request is refused
        alone; the others go on. A null epoch is 0, a null operation id is empty. With a ``batch_id`` that was
        committed before nothing is done, so a repeated micro-batch is harmless.
        """
        with self._lock:
            if self.recovery_required:
                raise RecoveryRequired("the log must be recovered")
            if batch_id is not None and self._knows(batch_id):
                return []
            decided, accepted = self._decide(requests)
            if not accepted:
                if batch_id is not None:
                    self._remember(batch_id)
                return decided
            name = f"log-{uuid.uuid4().hex}"
            try:
                self._hook("before append")
                numbers = self.spark.createDataFrame(accepted, "seq bigint, lsn bigint")
                rows = requests.join(F.broadcast(numbers), "seq").select("lsn", F.coalesce("epoch", F.lit(0)).alias("epoch"), "operation_id", "vector_id", request_digest("values").alias("digest"), F.col("values").alias("original"), vector.normalize_l2("values").alias("values"))
                rows.write.parquet(f"{self.folder.path}/{name}")
                self._hook("after append")
                part = {"name": name, "first": accepted[0][1], "last": accepted[-1][1], "rows": len(accepted), "generation": self._state["generation"], "batch": batch_id}
                self._publish(self._state | {"lsn": accepted[-1][1], "size": self.size + len(accepted), "log": [*self._state["log"], part]})
                self._hook("after publish")
            except BaseException:
                self.recovery_required = True
                raise
            if self.segment_rows and sum(p["rows"] for p in self._state["log"]) >= self.segment_rows:
                self.checkpoint(advance=False)
            return decided

    @staticmethod
    def _mark(batch_id: str) -> str:
        return f"batch-{hashlib.sha256(batch_id.encode()).hexdigest()}"

    def _knows(self, batch_id: str) -> bool:
        """Whether a batch was committed: the pointer names those of the current log, a mark in the folder every other one."""
        return any(p.get("batch") == batch_id for p in self._state["log"]) or self.folder.exists(self._mark(batch_id))

    def _remember(self, batch_id: str) -> None:
        if not self.folder.exists(self._mark(batch_id)):
            self.folder.write_json(self._mark(batch_id), {"batch": batch_id})

    def _decide(self, requests: DataFrame) -> tuple[list[Outcome], list[tuple[int, int]]]:
        state, policy, dimension = self._state, self.policy, self._state["dimension"]
        asked = requests.select("seq", F.coalesce("operation_id", F.lit("")).alias("operation_id"), F.coalesce("epoch", F.lit(0)).alias("epoch"), "vector_id", vector.vector_error("values", dimension).alias("error"), request_digest("values").alias("digest")).limit(self.max_batch + 1)
        known = self.operations().select("epoch", "operation_id", F.col("lsn").alias("old_lsn"), F.col("vector_id").alias("old_id"), F.col("digest").alias("old_digest"))
        there = self._stored_ids(asked)
        joined = asked.join(known, ["epoch", "operation_id"], "left").join(there, "vector_id", "left").orderBy("seq")
        rows = joined.collect()
        if len(rows) > self.max_batch:
            raise LimitExceeded(f"a batch has at most {self.max_batch} requests")
        usage = {r.epoch: [r.operations, r.bytes] for r in self._usage().where(F.col("epoch") == policy.current).collect()} if policy.current else {}
        used = usage.get(policy.current, [0, 0])
        seen: dict[tuple[int, str], tuple[int, int, str]] = {}
        ids: set[int] = set()
        lsn, size, out, accepted = state["lsn"], state["size"], [], []
        for r in rows:
            old = seen.get((r.epoch, r.operation_id)) or ((r.old_lsn, r.old_id, r.old_digest) if r.old_lsn is not None else None)
            cost = ENTRY_COST + len(r.operation_id.encode()) + 4 * dimension
            if not 0 < len(r.operation_id.encode()) <= MAX_OPERATION or r.error == "dimension" or r.vector_id is None:
                outcome = "INVALID_REQUEST"
            elif r.epoch > policy.current:
                outcome = "FUTURE_EPOCH"
            elif r.epoch < policy.oldest:
                outcome = "EXPIRED_EPOCH"
            elif old:
                outcome = "REPLAY" if old[1:] == (r.vector_id, r.digest) else "CONFLICT"
            elif policy.current and r.epoch != policy.current:
                outcome = "CLOSED_EPOCH"
            elif policy.current and (used[0] >= policy.operations or used[1] + cost > policy.bytes):
                outcome = "QUOTA"
            elif r.exists or r.vector_id in ids:
                outcome = "DUPLICATE_VECTOR"
            elif size + 1 > self.limits.vectors or self.limits.durable_bytes(size + 1, dimension) > self.limits.index_bytes:
                outcome = "LIMIT"
            elif r.error:
                outcome = "INVALID_VECTOR"
            else:
                outcome, lsn, size = "NEW", lsn + 1, size + 1
                used[0], used[1] = used[0] + 1, used[1] + cost
                seen[r.epoch, r.operation_id] = (lsn, r.vector_id, r.digest)
                ids.add(r.vector_id)
                accepted.append((r.seq, lsn))
            out.append(Outcome(r.seq, outcome, lsn if outcome == "NEW" else old[0] if outcome == "REPLAY" else None, size if outcome == "NEW" else old[0] if outcome == "REPLAY" else None))
        return out, accepted

    def _stored_ids(self, asked: DataFrame) -> DataFrame:
        """``(vector_id, exists)``: which of a batch's ids are stored.

        The ids, ``max_batch`` at most, go to the stored ones; of those only that column is read, no row of it is
        shuffled, and a few ids are looked up by the files' statistics (parts are written in id order).
        """
        ids = [r[0] for r in asked.where("vector_id is not null").select("vector_id").distinct().collect()]
        stored = self.index().select("vector_id")
        if len(ids) <= 10:
            hit = stored.where(F.col("vector_id").isin(ids)) if ids else stored.limit(0)
        else:
            hit = stored.join(F.broadcast(self.spark.createDataFrame([(i,) for i in ids], "vector_id bigint")), "vector_id", "left_semi")
        return hit.distinct().withColumn("exists", F.lit(True))

    def _usage(self) -> DataFrame:
        from vecloom.operators.service_log import epoch_usage

        return epoch_usage(self.operations(), self._state["dimension"])

    def _check_quota(self, epoch: int) -> None:
        p = self.policy
        for r in self._usage().where(F.col("epoch") == epoch).collect():
            if r.operations > p.operations or r.bytes > p.bytes:
                raise ResourceExhausted("epoch quota")

    def checkpoint(self, advance: bool = True, expected_epoch: int | None = None) -> dict:
        """Make the log part of the index, keep the window's operations, and with ``advance`` begin a new epoch.

        With an ``expected_epoch`` other than the current one nothing is done but an error raised, so that a
        repeated call is harmless.
        """
        with self._lock:
            if self.recovery_required:
                raise RecoveryRequired("the log must be recovered")
            policy = self.policy
            if expected_epoch is not None and expected_epoch != policy.current:
                raise EpochError("checkpoint epoch mismatch")
            following = replace(policy, current=policy.current + 1) if policy.current and advance else policy
            index, dedup = f"index-{uuid.uuid4().hex}", f"dedup-{uuid.uuid4().hex}"
            self._hook("before checkpoint")
            try:
                self._read(self._state["log"], RECORD).select("vector_id", "values").repartitionByRange("vector_id").sortWithinPartitions("vector_id").write.parquet(f"{self.folder.path}/{index}")
                kept = self._read(self._state["dedup"], RECORD).unionByName(self._read(self._state["log"], RECORD)).where(F.col("epoch") >= following.oldest)
                kept.write.parquet(f"{self.folder.path}/{dedup}")
                for batch in {p.get("batch") for p in self._state["log"]} - {None}:
                    self._remember(batch)  # before the pointer forgets it
                generation = self._state["generation"] + 1
                parts = [*self._state["index"], {"name": index}]
                self._publish(self._state | {"checkpoint_lsn": self.lsn, "generation": generation, "policy": vars(following), "index": parts, "dedup": [{"name": dedup}], "log": []})
            except BaseException:
                self.recovery_required = True
                raise
            self._hook("after checkpoint")
            self.cleanup()
            return {"lsn": self.lsn, "current_epoch": following.current, "oldest_epoch": following.oldest}

    def _publish(self, state: dict) -> None:
        self.folder.write_json(_POINTER, state)
        self._state = state

    def cleanup(self) -> list[str]:
        """Remove the log's own folders that the pointer does not name; returns their names."""
        kept = {p["name"] for kind in ("index", "dedup", "log") for p in self._state[kind]}
        old = [n for n in self.folder.names() if n.startswith(("index-", "dedup-", "log-", f".{_POINTER}-")) and n not in kept]
        for name in old:
            self.folder.delete(name)
        return old

    def verify(self) -> DataFrame:
        """``(lsn, problem)`` of broken records since the last checkpoint: numbers, digests, lengths of vectors; must be empty."""
        from vecloom.operators.service_log import log_gaps

        rows = self.records()
        problem = F.when(request_digest("original") != F.col("digest"), "digest").when(~vector.has_dimension("values", self._state["dimension"]) | ~vector.is_unit("values"), "vector").when(~F.col("values").eqNullSafe(vector.normalize_l2("original")), "normalised")
        broken = rows.select("lsn", problem.alias("problem")).where("problem is not null")
        return broken.unionByName(log_gaps(rows).withColumnRenamed("next", "lsn"))

    def stats(self) -> dict:
        p = self.policy
        entries, key_bytes = self.operations().agg(F.count("*"), F.coalesce(F.sum(F.octet_length("operation_id") + 8), F.lit(0))).first()
        return {"applied_lsn": self.lsn, "checkpoint_lsn": self._state["checkpoint_lsn"], "size": self.size, "wal_generation": self._state["generation"], "log_records": sum(x["rows"] for x in self._state["log"]), "current_epoch": p.current, "oldest_epoch": p.oldest, "dedup_entries": entries, "dedup_key_bytes": key_bytes, "recovery_required": self.recovery_required}


def arrival_slices(rows: DataFrame, most: int, order: Sequence[str] = ("received_at", "delivery_id")) -> Iterator[DataFrame]:
    """The rows in order of the columns ``order`` (nulls last) as slices of at most ``most``, numbered by ``seq``.

    Rows are sorted by range and numbered within their partition, so a slice ends anywhere, also within one
    arrival time; of each partition only the number of rows comes to the driver.
    """
    ordered = rows.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).withColumn("part", F.spark_partition_id())
    ordered = materialise(ordered, "arrivals")
    place = materialise(ordered.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_last() for c in order]))), "numbered")
    for r in place.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        for first in range(0, r.n, most):
            yield place.where((F.col("part") == r.part) & (F.col("n") > first) & (F.col("n") <= first + most)).withColumn("seq", F.col("n").cast("bigint")).drop("part", "n")


def ingest(requests: DataFrame, log: DurableLog, checkpoint: str, order: Sequence[str] = ("received_at", "delivery_id"), outcomes: str | None = None):
    """A streaming query that commits a stream of requests (``operation_id, epoch, vector_id, values`` and the order columns).

    Every micro-batch is cut into slices of at most ``log.max_batch`` rows in arrival order; a slice that was
    committed before a restart is recognised by its name. ``outcomes`` is a folder for (seq, outcome, lsn).
    """

    def commit(batch: DataFrame, number: int) -> None:
        columns = ["operation_id", "epoch", "vector_id", "values"]
        for i, part in enumerate(arrival_slices(batch.select(*columns, *[c for c in order if c not in columns]), log.max_batch, order)):
            decided = log.commit_batch(part.select("seq", *columns), f"{number}-{i}")
            if outcomes and decided:
                batch.sparkSession.createDataFrame([(number, i, d.seq, d.outcome, d.lsn) for d in decided], "batch bigint, slice int, seq bigint, outcome string, lsn bigint").write.mode("append").parquet(outcomes)

    return requests.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def classify(requests: DataFrame, stored: DataFrame, current: int, retained: int) -> DataFrame:
    """The first, parallel step of a commit over any number of requests: what each one is with regard to stored operations.

    ``requests`` and ``stored`` have ``epoch, operation_id, vector_id, digest``, requests also ``seq`` and ``error``
    (of :func:`~vecloom.functions.vector.vector_error`; a wrong dimension is an invalid request); stored keys are unique. Gives ``(seq, outcome)``: INVALID_REQUEST, FUTURE_EPOCH, EXPIRED_EPOCH, REPLAY, CONFLICT,
    CLOSED_EPOCH or CANDIDATE.
    """
    oldest = max(0, current - retained + 1)
    known = stored.select("epoch", "operation_id", F.col("vector_id").alias("old_id"), F.col("digest").alias("old_digest"))
    asked = requests.select("seq", F.coalesce("epoch", F.lit(0)).alias("epoch"), F.coalesce("operation_id", F.lit("")).alias("operation_id"), "vector_id", "digest", "error")
    length = F.octet_length("operation_id")
    outcome = (
        F.when((length == 0) | (length > MAX_OPERATION) | F.col("vector_id").isNull() | (F.coalesce("error", F.lit("")) == "dimension"), "INVALID_REQUEST")
        .when(F.col("epoch") > current, "FUTURE_EPOCH")
        .when(F.col("epoch") < oldest, "EXPIRED_EPOCH")
        .when(F.col("old_id").isNotNull() & (F.col("old_id") == F.col("vector_id")) & F.col("old_digest").eqNullSafe(F.col("digest")), "REPLAY")
        .when(F.col("old_id").isNotNull(), "CONFLICT")
        .when(F.col("epoch") < current, "CLOSED_EPOCH")
        .otherwise("CANDIDATE")
    )
    return asked.join(known, ["epoch", "operation_id"], "left").select("seq", outcome.alias("outcome"))
