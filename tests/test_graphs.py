import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.__main__ import main
from vecloom.errors import InvalidArgument
from vecloom.functions.arrow_vectors import normalise
from vecloom.operators import hnsw, knn
from vecloom.plans.graphs import GraphStore
from vecloom.plans.index import ExactIndex, GraphIndex, VectorIndex
from vecloom.plans.store import VectorStore
from vecloom.session import materialise
from vecloom.sources.snapshot_file import GraphFile


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vector_id bigint, values array<float>")


def queries(spark, *rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "query_id bigint, query array<float>")


def found(df):
    return [(r.vector_id, round(r.score, 4)) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("bad", [{"dimension": 0}, {"max_connections": 1}, {"ef_construction": 3}, {"ef_search": 0}])
def test_configuration_is_checked(bad):
    with pytest.raises(InvalidArgument):
        hnsw.GraphConfig(**{"dimension": 2, "max_connections": 4, **bad})


def test_deleted_nodes_lead_on_and_keep_their_ids(spark):
    config = hnsw.GraphConfig(2)
    index = materialise(hnsw.build(vectors(spark, [(0, (1, 0)), (9, (0, 1)), (7, (-1, 0))]), config, 1))
    gone = hnsw.erase(index, vectors(spark, [(0, (1, 0))]))
    assert found(hnsw.search(gone, queries(spark, (1, 0)), 10, config)) == [(9, 0.0), (7, -1.0)]
    stats = hnsw.stats(gone).first()
    assert (stats.nodes, stats.live, stats.deleted) == (3, 2, 1)
    assert [r.vector_id for r in hnsw.live_ids(hnsw.rebuild(gone, config)).collect()] == [7, 9]


def test_order_with_a_small_ef(spark):
    config = hnsw.GraphConfig(2)
    index = hnsw.build(vectors(spark, [(30, (1, 0)), (20, (1, 0)), (10, (1, 0)), (40, (-1, 0))]), config, 1)
    gone = hnsw.erase(index, vectors(spark, [(30, (1, 0))]))
    assert found(hnsw.search(gone, queries(spark, (1, 0)), 10, config, ef=1)) == [(10, 1.0), (20, 1.0), (40, -1.0)]
    assert found(hnsw.search(gone, queries(spark, (1, 0)), 0, config, ef=0)) == []
    with pytest.raises(InvalidArgument):
        hnsw.search(gone, queries(spark, (1, 0)), 1, config, ef=0)


def test_a_chain_of_deleted_nodes_still_routes():
    graph = hnsw.Graph(hnsw.GraphConfig(2), np.array([100, 200, 300]), np.array([[1, 0], [-1, 0], [0, 1]], np.float32))
    graph.links, graph.deleted, graph.entry, graph.top = [[[1]], [[0, 2]], [[1]]], np.array([True, True, False]), 0, 0
    assert [int(graph.ids[n]) for n in graph.search(np.array([1.0, 0.0]), 1, 1)] == [300]


def test_equal_to_exact_search_with_enough_links(spark):
    rows = [(i, [(i * (d + 3)) % 31 + 1 for d in range(5)]) for i in range(48)]
    config = hnsw.GraphConfig(5, max_connections=32, ef_construction=64)
    table = vectors(spark, rows)
    index = hnsw.erase(materialise(hnsw.build(table, config, 1)), table.where("vector_id % 4 <> 0"))
    asked = queries(spark, *[[((q + 2) * (d + 5)) % 29 + 1 for d in range(5)] for q in range(15)])
    for k in (1, 10, 100):
        assert found(hnsw.search(index, asked, k, config, ef=1)) == found(knn.knn(asked, table.where("vector_id % 4 = 0"), k, 5))


def test_builds_are_the_same_whatever_the_partitioning(spark):
    table = vectors(spark, [(i, (i % 13 + 1, i % 7 + 2, i % 5 + 3)) for i in range(1, 101)])
    config = hnsw.GraphConfig(3, max_connections=4, heuristic=True)
    one, two = (sorted(map(str, hnsw.build(t, config, 2).collect())) for t in (table, table.repartition(5)))
    assert one == two
    index = materialise(hnsw.build(table, config, 2))
    assert hnsw.broken_edges(index).isEmpty()
    assert hnsw.edges(index).groupBy("shard", "layer", "node").count().agg(F.max("count")).first()[0] <= 8


def test_more_effort_finds_no_less(spark):
    rows = [(i, [(i * (c + 3)) % 101 + 1 for c in range(8)]) for i in range(1, 301)]
    config = hnsw.GraphConfig(8, max_connections=8, heuristic=True)
    table = vectors(spark, rows)
    index = materialise(hnsw.build(table, config, 1))
    asked = queries(spark, *[v for _, v in rows[:20]])
    exact = set(map(tuple, knn.knn(asked, table, 10, 8).select("query_id", "vector_id").collect()))
    few, many = (len(exact & set(map(tuple, hnsw.search(index, asked, 10, config, ef=ef).select("query_id", "vector_id").collect()))) for ef in (10, 80))
    assert many >= few and many >= 190


def test_unusable_rows_and_empty_tables(spark):
    config = hnsw.GraphConfig(2)
    table = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "vector_id bigint, values array<float>")
    assert found(hnsw.search(hnsw.build(table, config, 2), queries(spark, (1, 0)), 5, config)) == [(1, 1.0)]
    empty = hnsw.build(table.limit(0), config)
    assert hnsw.stats(empty).first().nodes == 0 and found(hnsw.search(empty, queries(spark, (1, 0)), 5, config)) == []


def test_levels_follow_the_geometric_law():
    config = hnsw.GraphConfig(2, max_connections=4)
    levels = np.array([hnsw.level_of(i, config) for i in range(4000)])
    assert abs((levels >= 1).mean() - 1 / 4) < 0.03 and abs((levels >= 2).mean() - 1 / 16) < 0.02
    assert normalise(np.ones((1, 2), np.float32)).shape == (1, 2)


def spiral(n, d=5):
    return [(i, [(i * (c + 3)) % 31 + 1 + c for c in range(d)]) for i in range(n)]


def test_insert_into_a_stored_graph(spark, tmp_path):
    config = hnsw.GraphConfig(5, max_connections=8, ef_construction=32)
    store = GraphStore(spark, str(tmp_path / "g"), config, shards=2)
    assert store.index().isEmpty() and store.stats()["nodes"] == 0
    rows = spiral(60)
    store.insert(vectors(spark, rows[:40]))
    store.insert(vectors(spark, rows[40:]))
    assert hnsw.broken_edges(store.index()).isEmpty() and store.stats()["live"] == 60
    asked = queries(spark, *[v for _, v in rows[:10]])
    assert found(store.search(asked, 5, 60)) == found(knn.knn(asked, vectors(spark, rows), 5, 5))
    # a refused vector leaves the version as it was, whatever else the batch holds
    for bad in ([(7, [1] * 5), (100, [1] * 5)], [(100, [1] * 5), (101, [0] * 5)], [(100, [1] * 5), (100, [2] * 5)], [(100, [1, 2])]):
        with pytest.raises(InvalidArgument):
            store.insert(vectors(spark, bad))
    assert store.version == 2 and GraphStore(spark, str(tmp_path / "g")).stats()["nodes"] == 60
    # ids of deleted nodes stay reserved until the graph is rebuilt
    store.erase(vectors(spark, rows[:30]))
    with pytest.raises(InvalidArgument):
        store.insert(vectors(spark, rows[:1]))
    store.rebuild()
    assert store.stats()["nodes"] == 30
    store.insert(vectors(spark, rows[:1]))
    assert sorted(r.vector_id for r in hnsw.live_ids(store.index()).collect()) == [0, *range(30, 60)]
    assert len(store.vacuum()) == 4 and store.stats()["nodes"] == 31


def test_graph_files_round_trip(spark, tmp_path):
    config = hnsw.GraphConfig(5, max_connections=4, ef_construction=16, seed=17)
    store = GraphStore(spark, str(tmp_path / "g"), config)
    store.insert(vectors(spark, [*spiral(20), (-1, [1, 2, 3, 4, 9])]))
    store.erase(vectors(spark, spiral(5)))
    file = str(tmp_path / "out.hnsw")
    store.export_file(file)
    with pytest.raises(InvalidArgument):
        store.export_file(file)
    other = GraphStore(spark, str(tmp_path / "h"), config)
    other.import_files(file)
    rows = lambda s: sorted((r.vector_id, r.deleted, [sorted(x) for x in r.links]) for r in s.index().collect())
    assert rows(other) == rows(store) and (1 << 64) - 1 in GraphFile.decode(open(file, "rb").read()).ids.tolist()
    asked = queries(spark, *[v for _, v in spiral(4)])
    assert found(other.search(asked, 7)) == found(store.search(asked, 7))
    with pytest.raises(InvalidArgument):
        other.import_files(file)
    assert main(["rebuild", "--input", file, "--output", file]) == 1
    assert main(["rebuild", "--input", file, "--output", str(tmp_path / "new.hnsw")]) == 0
    assert not GraphFile.decode((tmp_path / "new.hnsw").read_bytes()).deleted.any()


def test_sweep_takes_each_ef_once_in_order(spark):
    config = hnsw.GraphConfig(5, max_connections=4, ef_construction=16)
    table = vectors(spark, spiral(31))
    rows = hnsw.sweep(materialise(hnsw.build(table, config, 1)), queries(spark, *[v for _, v in spiral(5)]), table, 3, [40, 5, 40], config).collect()
    assert [r.ef for r in rows] == [5, 40] and rows[1].mean_recall == 1.0 and all(r.short == r.leaked == 0 and r.qps > 0 for r in rows)


@pytest.mark.parametrize("kind", ["exact", "graph"])
def test_kinds_of_index_have_the_same_methods(spark, tmp_path, kind):
    store = VectorStore(spark, str(tmp_path / "s"), 5) if kind == "exact" else GraphStore(spark, str(tmp_path / "s"), hnsw.GraphConfig(5))
    index: VectorIndex = ExactIndex(store) if kind == "exact" else GraphIndex(store, 50)
    table = vectors(spark, spiral(30))
    index.insert(table)
    index.erase(table.where("vector_id < 10"))
    asked = queries(spark, *[v for _, v in spiral(3)])
    assert found(index.search(asked, 4)) == found(knn.knn(asked, table.where("vector_id >= 10"), 4, 5))
    assert sorted(r.vector_id for r in index.live().collect()) == list(range(10, 30))
