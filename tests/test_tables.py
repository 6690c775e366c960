import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.operators import dedup, evaluation, service_log
from vecloom.operators.components import connected_components

DELIVERY = "delivery_id bigint, client_operation_id string, dedup_epoch bigint, received_at timestamp, values string, __key0 string"


def deliveries(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(i, op, ep, None if at is None else datetime(2025, 1, 1, 0, at // 60, at % 60), "v", "clash") for i, op, ep, at in rows], DELIVERY)


def surplus(df):
    return sorted(r.delivery_id for r in dedup.surplus_deliveries(df, dedup.operation_key(), ["received_at"], "delivery_id").collect())


def brute(rows):
    groups = {}
    for i, op, ep, at in rows:
        if op:
            groups.setdefault((op, ep or 0), []).append((at is None, at, i))
    return sorted(x[2] for g in groups.values() for x in sorted(g, key=lambda x: (x[0], x[1] or 0, x[2]))[1:])


def test_surplus_deliveries(spark):
    rows = [(1, "a", None, 5), (2, "a", 0, 3), (3, "a", 1, 1), (4, "a", 0, 3), (5, None, 0, 1), (6, "", 0, 1), (7, None, 0, 1), (8, "b", 2, None), (9, "b", 2, 9), (10, "A", 0, 1), (11, "a ", 0, 1)]
    df = deliveries(spark, rows)
    assert surplus(df) == brute(rows) == [1, 4, 8]
    kept = dedup.exactly_once(df, dedup.operation_key(), ["received_at"], "delivery_id")
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert surplus(df.limit(0)) == []


def test_surplus_with_one_operation_of_a_third_of_all_rows(spark):
    rnd = random.Random(4)
    rows = [(i, "hot" if i % 3 == 0 else f"op{rnd.randrange(300)}", rnd.choice([None, 0, 1]), rnd.choice([None, *range(50)])) for i in range(1500)]
    rnd.shuffle(rows)
    assert surplus(deliveries(spark, rows).repartition(7)) == brute(rows)


def test_new_messages_meet_the_stored_ones(spark):
    stored = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    batch = spark.createDataFrame([(1, "a", 1), (2, "c", 5), (3, "c", 4), (4, None, 1), (5, None, 1)], "i bigint, k string, at int")
    assert sorted(r.i for r in dedup.new_messages(batch, stored, ["k"], ["at"], "i").collect()) == [3, 4, 5]
    assert dedup.new_messages(batch.limit(0), stored, ["k"], ["at"], "i").count() == 0


def components_of(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    return {r.node: r.component for r in connected_components(df).collect()}


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(1, None), (None, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)], [(5, 4), (4, 5), (5, 4), (9, 8)]])
def test_components_of_special_graphs(spark, edges):
    assert components_of(spark, edges) == union_find(edges)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 60), st.integers(-20, 60)), max_size=60))
def test_components_of_random_graphs(edges):
    from pyspark.sql import SparkSession

    assert components_of(SparkSession.getActiveSession(), edges) == union_find(edges)


def results(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, rank int, vector_id bigint, score float")


def test_recall(spark):
    expected = results(spark, [(q, r, v, 0.0) for q, ids in enumerate([[1, 2, 3], [4, 5, 6]]) for r, v in enumerate(ids)])
    actual = results(spark, [(q, r, v, 0.0) for q, ids in enumerate([[3, 2, 9], [7, 8, 9]]) for r, v in enumerate(ids)])
    got = {r.query_id: r.recall for r in evaluation.recall(expected, actual).collect()}
    assert got == {0: 2 / 3, 1: 0.0}
    summary = evaluation.recall_summary(evaluation.recall(expected, actual)).first()
    assert (summary.queries, summary.min_recall) == (2, 0.0) and abs(summary.mean_recall - 1 / 3) < 1e-12
    assert evaluation.recall_summary(evaluation.recall(expected.limit(0), actual)).first().mean_recall is None
    assert tuple(evaluation.short_queries(expected, actual.where("query_id = 0")).first()) == (2, 1)
    same = {r.query_id: r.same for r in evaluation.ranked_match(expected, expected.unionByName(actual.where("vector_id = 7").withColumn("rank", F.lit(5)))).collect()}
    assert same == {0: True, 1: False}


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)] + [(None,)], "x double")
    wanted = {"middle": evaluation.linear(0.5), "half": evaluation.nearest_rank(0.5), "least": evaluation.nearest_rank(0.01)}
    assert tuple(evaluation.percentiles(df, [], "x", wanted).first()) == (2.5, 2.0, 1.0)
    assert evaluation.percentiles(df.limit(0), [], "x", wanted).isEmpty()


def test_percentiles_of_large_groups_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"skewed": np.exp(rng.normal(0, 4, 3000)), "tied": rng.integers(0, 3, 900).astype(float), None: np.array([-1e308, 1e308, 0.0]), "one": np.array([7.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None), ("none", None)]
    wanted = {f"p{p}": evaluation.nearest_rank(p / 100) for p in (1, 50, 99)} | {f"l{p}": evaluation.linear(p / 100) for p in (5, 50, 95)}
    got = {r.g: r for r in evaluation.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", wanted, few=20).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        for p in (1, 50, 99):
            assert got[g][f"p{p}"] == np.sort(xs)[max(1, -(-len(xs) * p // 100)) - 1]
        for p in (5, 50, 95):
            assert np.isclose(got[g][f"l{p}"], np.quantile(xs, p / 100), rtol=1e-9) or g is None


def test_incomplete_results(spark):
    queries = spark.createDataFrame([(0,), (1,), (2,), (3,)], "query_id bigint")
    rows = [(0, 0, 1, 1.0), (0, 1, 2, 1.0), (1, 0, 1, 1.0), (2, 0, 1, 1.0), (2, 0, 2, 1.0), (3, 0, 1, 1.0), (3, 2, 1, 1.0), (9, 0, 1, 1.0)]
    got = {r.query_id: r.problem for r in evaluation.incomplete_results(results(spark, rows), queries, 2).collect()}
    assert got == {1: "missing rank", 2: "repeated rank", 3: "rank", 9: "unexpected query"}


def test_score_errors(spark):
    queries = spark.createDataFrame([(0, [2.0, 0.0])], "query_id bigint, query array<float>")
    vectors = spark.createDataFrame([(5, [3.0, 4.0])], "vector_id bigint, values array<float>")
    got = {r.vector_id: r.error for r in evaluation.score_errors(results(spark, [(0, 0, 5, 0.6), (0, 1, 6, 0.1)]), queries, vectors).collect()}
    assert got[5] < 1e-6 and got[6] is None


def test_log_gaps_and_epochs(spark):
    df = spark.createDataFrame([(x,) for x in (4, 5, 6, 8, 8, 9, None)], "lsn bigint")
    assert sorted(map(tuple, service_log.log_gaps(df).collect())) == [(8, "repeated")]
    assert sorted(map(tuple, service_log.log_gaps(df.where("lsn <> 5").distinct()).collect())) == [(6, "gap"), (8, "gap")]
    ops = spark.createDataFrame([(1, "abc"), (1, "é"), (2, "x")], "epoch bigint, operation_id string")
    assert sorted(map(tuple, service_log.epoch_usage(ops, 3).collect())) == [(1, 2, 103 + 102), (2, 1, 101)]
    assert service_log.retained(ops, 4, 3).count() == 1


def test_status_counts_leave_nulls_out(spark):
    log = spark.createDataFrame([("OK",), ("OK",), (None,), ("BAD",)], "status string")
    assert sorted(map(str, ((r.status, r.requests, r.total) for r in service_log.status_counts(log).collect()))) == sorted(map(str, [("OK", 2, False), ("BAD", 1, False), (None, 3, True)]))
