import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions.arrow_vectors import normalise
from vecloom.operators import knn
from vecloom.operators.components import connected_components
from vecloom.operators.skew import split_join, split_joins
from vecloom.session import materialise, stored_rows
from vecloom.streaming.durable import DurableLog


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_frequent_keys_are_split(spark, how):
    many = spark.range(300).selectExpr("id", "if(id < 200, 0, id) as k", "if(id % 50 = 7, null, 'x') as t")
    few = spark.createDataFrame([(0, "x", 1.0), (210, "x", 2.0), (999, "x", 3.0), (220, None, 4.0)], "k bigint, t string, v double")
    for keys in (["k"], ["k", "t"]):
        right = few if keys == ["k", "t"] else few.drop("t")
        got, plain = (sorted(map(repr, df.collect())) for df in (split_join(many, right, keys, 20, how), many.join(right, keys, how)))
        assert got == plain


def test_stored_tables_know_their_rows(spark):
    table = materialise(spark.range(7))
    assert stored_rows(table) == 7 and stored_rows(table.where("id > 3")) is None and stored_rows(materialise(spark.range(0))) == 0
    few = spark.range(5).withColumn("v", F.col("id") * 2)
    assert split_joins(table, [(few, ["id"]), (few.withColumnRenamed("v", "w"), ["id"])], rows=2).count() == 5


def test_a_giant_component_is_split(spark):
    edges = spark.range(1, 400).selectExpr("0L as a", "id as b").union(spark.range(600, 620).selectExpr("id", "id + 1"))
    for rows in (50, 1_000_000):
        sizes = {r.component: r["count"] for r in connected_components(edges, rows=rows).groupBy("component").count().collect()}
        assert sizes == {0: 400, 600: 21}


def test_scores_are_summed_per_label(spark):
    rng = np.random.default_rng(2)
    rows, labels = rng.normal(size=(50, 4)).astype(np.float32), rng.integers(0, 3, 50)
    table = spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(rows, labels, strict=True))] + [(99, None, 1), (98, [1.0] * 4, None)], "vector_id bigint, values array<float>, label int")
    asked = table.select(F.col("vector_id").alias("query_id"), F.col("values").alias("query"), "label")
    unit = normalise(rows).astype(np.float64)
    score = (unit @ unit.T).astype(np.float32)
    got = {(r.query_label, r.label): r for r in knn.label_scores(asked, table.repartition(3), 4).collect()}
    for a in range(3):
        for b in range(3):
            part = score[np.ix_(labels == a, labels == b)]
            assert got[a, b].pairs == part.size and abs(got[a, b].total - part.sum(dtype=float)) < 1e-5 and abs(got[a, b].best - part.max()) < 1e-6


def test_every_batch_is_remembered(spark, tmp_path):
    log = DurableLog(spark, str(tmp_path / "log"), 2)
    rows = lambda i: spark.createDataFrame([(0, f"op{i}", 0, i, [1.0, float(i)])], "seq bigint, operation_id string, epoch bigint, vector_id bigint, values array<float>")
    assert [o.outcome for o in log.commit_batch(rows(1), "first")] == ["NEW"]
    assert [o.outcome for o in log.commit_batch(rows(1).withColumn("vector_id", F.lit(None).cast("bigint")), "refused")] == ["INVALID_REQUEST"]
    log.checkpoint()
    again = DurableLog(spark, str(tmp_path / "log"), 2)
    assert again.commit_batch(rows(1), "first") == again.commit_batch(rows(1), "refused") == [] and again.size == 1
