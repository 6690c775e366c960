import io
import json
import threading
import time

import pytest

from vecloom.errors import EpochError, FailedPrecondition, InvalidArgument, LimitExceeded, PublicationBusy, ReadOnlyStore, RecoveryRequired, ResourceExhausted, SearchInterrupted, SearchRejected, SnapshotMismatch, status_of
from vecloom.limits import MemoryBudget, ResourceLimits, parse_bool, parse_unsigned
from vecloom.plans.serving import SearchContext, SearchExecutor, SnapshotPublication, StructuredLogger, publish_rolling
from vecloom.plans.store import SnapshotIdentity, VectorStore
from vecloom.streaming.durable import DurableLog, Policy, ingest

V = [3.1, 7.2, -2.3]


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore(spark, f"file://{tmp_path}/store", 2, max_batch=3)


def test_adding_searching_and_deleting(spark, store):
    assert store.add_batch([(30, [1, 0]), (20, [0, 1]), (10, [-1, 0])]) == 3 and store.add(40, [0, -1]) == 4
    assert store.erase([20, 99]) == 1
    assert store.search([0, -1], 10) == [(40, 1.0), (10, 0.0), (30, 0.0)]
    assert store.add(20, [1, 1]) == 4 and store.search([1, 1], 1)[0][0] == 20
    for bad, error in (((1, [1]), InvalidArgument), ((20, [1, 0]), InvalidArgument), ((1, [0, 0]), InvalidArgument), ((1, [float("nan"), 1]), InvalidArgument)):
        with pytest.raises(error):
            store.add(*bad)
    assert store.snapshot.size == 4
    assert VectorStore(spark, store.folder.path).search([0, -1], 1) == [(40, 1.0)]


def test_batches_are_checked_as_a_whole_then_applied_up_to_a_stored_id(store):
    with pytest.raises(LimitExceeded):
        store.add_batch([(i, [1, 0]) for i in range(4)])
    for bad in ([(1, [1, 0]), (1, [0, 1])], [(1, [1, 0]), (2, [1])], [(1, [1, 0]), (2, [0, 0])]):
        with pytest.raises(InvalidArgument):
            store.add_batch(bad)
    assert store.snapshot.size == 0
    store.add(2, [1, 0])
    with pytest.raises(InvalidArgument):
        store.add_batch([(1, [1, 0]), (2, [1, 0]), (3, [1, 0])])
    assert store.snapshot.size == 2 and store.stats()["inserted_vectors"] == 2


def test_old_snapshots_stay_and_compaction_keeps_rows(store):
    store.add_batch([(1, [1, 0]), (2, [0, 1])])
    old = store.snapshot
    store.erase([1])
    assert store.rows(old).count() == 2 and store.rows().count() == 1
    assert store.compact() == 1 and store.vacuum() and store.search([0, 1], 5) == [(2, 1.0)]


def test_queries_are_checked_in_order_and_counted(store):
    assert store.search([], 0) == []
    for query, k, context, error in (([1], 1, None, InvalidArgument), ([1, 0], 10_001, None, LimitExceeded), ([1, 0], 1, SearchContext(deadline=time.monotonic() - 1), SearchInterrupted), ([], 0, SearchContext(expected_snapshot_id="x"), SnapshotMismatch)):
        with pytest.raises(error):
            store.search(query, k, context)
    stats = store.stats()
    assert (stats["successful_queries"], stats["failed_queries"]) == (1, 4)


def test_contexts_keep_the_first_reason(spark, store):
    context = SearchContext(deadline=time.monotonic() - 1)
    context.cancel("shutdown")
    context.cancel()
    with pytest.raises(SearchInterrupted, match="shutdown"):
        context.check()
    store.add(1, [1, 0])
    assert store.search([1, 0], 1, SearchContext(deadline=time.monotonic() + 60)) == [(1, 1.0)]
    slow = SearchContext(deadline=time.monotonic() + 0.3)
    with pytest.raises(SearchInterrupted, match="deadline"):
        slow.run(spark, lambda: spark.range(1 << 40).selectExpr("sum(id % 7)").collect())
    tracker, until = spark.sparkContext.statusTracker(), time.monotonic() + 30
    while tracker.getActiveJobsIds() and time.monotonic() < until:
        time.sleep(0.1)
    assert not tracker.getActiveJobsIds()


def manifest(count=1, sha="a" * 64, dimension=2):
    return {"format_version": 1, "snapshot_id": f"sha256:{sha}", "index_type": "flat", "dimension": dimension, "vector_count": count, "file_size": 100, "sha256": sha}


def replica(spark, path, generation=1):
    VectorStore(spark, path, 2)
    store = VectorStore(spark, path, read_only=True)
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "vector_id bigint, values array<float>")
    store.activate(store.prepare(rows, SnapshotIdentity("sha256:" + "0" * 64, generation)))
    return store, rows


def test_publication(spark, tmp_path):
    store, rows = replica(spark, f"file://{tmp_path}/r")
    with pytest.raises(ReadOnlyStore):
        store.add(5, [1, 0])
    p = SnapshotPublication(store)
    with pytest.raises(SnapshotMismatch):
        p.begin(manifest(), 1)
    token = p.begin(manifest(), 3)
    with pytest.raises(PublicationBusy):
        p.begin(manifest(), 4)
    p.fail(token)
    assert p.status()["state"] == "FAILED" and p.status()["last_result"] == "PREPARE_FAILED"
    for wrong, generation in ((manifest(sha="b" * 64), 3), (manifest(), 2)):
        with pytest.raises(SnapshotMismatch):
            p.begin(wrong, generation)
    token = p.begin(manifest(), 3)
    with pytest.raises(SnapshotMismatch):
        p.complete(token + 1, rows)
    p.complete(token, rows)
    with pytest.raises(SnapshotMismatch):
        p.activate("sha256:" + "b" * 64, 3)
    p.activate(manifest()["snapshot_id"], 3)
    p.activate(manifest()["snapshot_id"], 3)
    assert p.status()["last_result"] == "ALREADY_ACTIVE" and store.search([1, 0], 1, SearchContext(expected_snapshot_id=manifest()["snapshot_id"])) == [(1, 1.0)]


def test_rolling_publication_stops_at_the_first_failure(spark, tmp_path):
    made = {name: replica(spark, f"file://{tmp_path}/{name}") for name in "abc"}
    replicas = {name: SnapshotPublication(store) for name, (store, _) in made.items()}

    def load(name):
        if name == "b":
            raise OSError("gone")
        return made[name][1]

    report = publish_rolling(replicas, manifest(), 2, load)
    assert [(r["replica"], r["converged"]) for r in report] == [("a", True), ("b", False)] and "gone" in report[1]["error"]


def test_executor_totals_always_add_up():
    gate, budget = threading.Event(), MemoryBudget(10)
    executor = SearchExecutor(workers=1, queue=2, budget=budget)
    first = executor.submit(gate.wait, size=4)
    while executor.totals["running"] < 1:
        time.sleep(0.01)
    late = SearchContext(deadline=time.monotonic())
    expired, failed = executor.submit(lambda: 1, late, size=3), executor.submit(lambda: 1 / 0)
    with pytest.raises(SearchRejected):
        executor.submit(lambda: 1)
    gate.set()
    assert first.result() is True
    with pytest.raises(SearchInterrupted):
        expired.result()
    with pytest.raises(ZeroDivisionError):
        failed.result()
    with pytest.raises(ResourceExhausted):
        executor.submit(lambda: 1, size=11)
    executor.stop()
    with pytest.raises(SearchRejected) as stopped:
        executor.submit(lambda: 1)
    assert status_of(stopped.value) == "UNAVAILABLE"
    t = executor.totals
    assert t["admitted"] == t["completed"] == 3 and (t["succeeded"], t["failed"], t["expired"], t["rejected"]) == (1, 1, 1, 2) and budget.used == 0


def test_logger_and_limits():
    stream = io.StringIO()
    logger = StructuredLogger(stream, frozenset({"node"}))
    logger.write("INFO", "rpc_completed", method="Search", latency_us=5, status="", node='a"\n')
    row = json.loads(stream.getvalue())
    assert list(row)[:3] == ["timestamp", "severity", "event"] and row["status"] is None and row["latency_us"] == 5 and row["node"] == 'a"\n'
    with pytest.raises(InvalidArgument):
        logger.write("INFO", "x", secret=1)
    limits = ResourceLimits()
    assert (limits.flat_bytes(2, 3), limits.durable_bytes(2, 3), limits.graph_bytes(1, 3, 16)) == (1048, 2072, 4 * 3 + 512 + 64 * (48 + 512))
    for bad in ("", "-1", "01x", "1.0", str(1 << 64)):
        with pytest.raises(InvalidArgument):
            parse_unsigned(bad)
    assert parse_unsigned("18446744073709551615") == (1 << 64) - 1 and parse_bool("true")
    assert status_of(EpochError("x")) == "FAILED_PRECONDITION" and status_of(ValueError()) == "INVALID_ARGUMENT" and status_of(OSError()) == "INTERNAL"


def test_a_retry_gets_the_first_result(spark, tmp_path):
    log = DurableLog(spark, f"file://{tmp_path}/log", 3)
    first = log.commit("first", 91, V)
    assert (first.lsn, first.index_size, first.replayed) == (1, 1, False)
    assert log.commit("second", 19, [0, 1, 0]).lsn == 2
    again = log.commit("first", 91, V)
    assert (again.lsn, again.index_size, again.replayed) == (1, 1, True)
    for operation, key, values in (("first", 92, V), ("first", 91, [1, 2, 3]), ("third", 91, V), ("", 1, V), ("x" * 257, 1, V), ("y", 1, [1.0]), ("y", 1, [0, 0, 0])):
        with pytest.raises(InvalidArgument):
            log.commit(operation, key, values)
    with pytest.raises(EpochError):
        log.commit("z", 5, V, 1)
    log.commit("zero", 7, [0.0, 1, 0])
    with pytest.raises(InvalidArgument):
        log.commit("zero", 7, [-0.0, 1, 0])
    assert log.lsn == 3 and DurableLog(spark, log.folder.path, 3).index().count() == 3
    assert log.verify().isEmpty() and log.stats()["dedup_key_bytes"] == sum(8 + len(x) for x in ("first", "second", "zero"))
    state = log.folder.read_json("LOG.json")
    log.folder.write_json("LOG.json", state | {"log": state["log"][:1] + state["log"][2:]})
    with pytest.raises(RecoveryRequired):
        DurableLog(spark, log.folder.path, 3)


def test_epochs_move_and_expire(spark, tmp_path):
    log = DurableLog(spark, f"file://{tmp_path}/log", 3, Policy(1, 3, 10, 2048))
    assert log.commit("same", 1, V, 1).lsn == 1
    log.checkpoint(expected_epoch=1)
    with pytest.raises(EpochError):
        log.checkpoint(expected_epoch=1)
    assert log.commit("same", 1, V, 1).replayed
    for epoch in (1, 3, 0):
        with pytest.raises(EpochError):
            log.commit("new", 99, V, epoch)
    assert log.commit("same", 2, V, 2).lsn == 2
    log.checkpoint()
    assert log.commit("same", 1, V, 1).replayed
    log.checkpoint()
    assert log.stats()["oldest_epoch"] == 2 and log.stats()["dedup_entries"] == 1
    with pytest.raises(EpochError):
        log.commit("same", 1, V, 1)
    back = DurableLog(spark, log.folder.path, 3)
    assert back.stats()["current_epoch"] == 4 and back.commit("same", 2, V, 2).replayed and back.commit("next", 3, V, 4).lsn == 3


@pytest.mark.parametrize("policy", [Policy(1, 3, 1, 2048), Policy(1, 3, 10, 103)])
def test_quotas_refuse_and_retries_pass(spark, tmp_path, policy):
    log = DurableLog(spark, f"file://{tmp_path}/log", 3, policy)
    log.commit("one", 1, V, 1)
    with pytest.raises(ResourceExhausted):
        log.commit("two", 2, V, 1)
    assert log.commit("one", 1, V, 1).replayed and log.lsn == 1
    log.checkpoint()
    assert log.commit("two", 2, V, 2).lsn == 2


def test_a_batch_is_decided_in_order(spark, tmp_path):
    log = DurableLog(spark, f"file://{tmp_path}/log", 2, segment_rows=2)
    rows = [(1, "a", None, 1, [1.0, 0.0]), (2, "a", 0, 1, [1.0, 0.0]), (3, "a", 0, 2, [1.0, 0.0]), (4, "b", 0, 1, [1.0, 1.0]), (5, None, 0, 3, [1.0, 0.0]), (6, "c", 0, 4, [0.0, 0.0]), (7, "c", 0, 5, [0.0, 2.0]), (8, "d", 0, None, [1.0, 0.0]), (9, "e", 0, 6, None)]
    batch = spark.createDataFrame(rows, "seq bigint, operation_id string, epoch bigint, vector_id bigint, values array<float>").repartition(4)
    got = [(o.outcome, o.lsn) for o in log.commit_batch(batch, "b0")]
    assert got == [("NEW", 1), ("REPLAY", 1), ("CONFLICT", None), ("DUPLICATE_VECTOR", None), ("INVALID_REQUEST", None), ("INVALID_VECTOR", None), ("NEW", 2), ("INVALID_REQUEST", None), ("INVALID_REQUEST", None)]
    assert log.commit_batch(batch, "b0") == [] and log.stats()["wal_generation"] == 1 and log.stats()["log_records"] == 0
    assert [o.outcome for o in log.commit_batch(batch.limit(0))] == []
    with pytest.raises(LimitExceeded):
        DurableLog(spark, log.folder.path, 2, max_batch=2).commit_batch(batch)


@pytest.mark.parametrize("boundary, kept", [("before append", 1), ("after append", 1), ("after publish", 2)])
def test_a_crash_leaves_the_old_or_the_new_log(spark, tmp_path, boundary, kept):
    path = f"file://{tmp_path}/log"
    DurableLog(spark, path, 3).commit("one", 1, V)

    def hook(name):
        if name == boundary:
            raise OSError("crash")

    log = DurableLog(spark, path, 3, hook=hook)
    with pytest.raises(OSError):
        log.commit("two", 2, V)
    with pytest.raises(RecoveryRequired):
        log.commit("three", 3, V)
    back = DurableLog(spark, path, 3)
    assert back.lsn == back.index().count() == kept and len(back.recovered["discarded"]) == (boundary == "after append")
    assert back.commit("two", 2, V).replayed == (kept == 2)
    assert issubclass(RecoveryRequired, FailedPrecondition)


def test_a_stream_is_committed_once(spark, tmp_path):
    source = tmp_path / "in"
    schema = "delivery_id bigint, operation_id string, epoch bigint, vector_id bigint, values array<float>, received_at timestamp"
    rows = spark.range(7).selectExpr("id as delivery_id", "concat('op', id % 5) as operation_id", "0L as epoch", "id % 5 as vector_id", "array(1f, 0f) as values", "timestamp'2025-01-01' as received_at")
    rows.write.parquet(str(source))
    log = DurableLog(spark, f"file://{tmp_path}/log", 2, max_batch=3)
    for _ in range(2):
        stream = ingest(spark.readStream.schema(schema).parquet(str(source)), log, str(tmp_path / "cp"), outcomes=str(tmp_path / "out")).start()
        stream.awaitTermination()
    assert log.lsn == 5
    counts = dict(map(tuple, spark.read.parquet(str(tmp_path / "out")).groupBy("outcome").count().collect()))
    assert counts == {"NEW": 5, "REPLAY": 2}
