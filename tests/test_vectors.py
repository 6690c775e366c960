import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.errors import InvalidArgument, LimitExceeded
from vecloom.functions import vector
from vecloom.functions.arrow_vectors import exact_scores, normalise, pack, unpack, valid_matrix
from vecloom.limits import ResourceLimits
from vecloom.operators import knn, lookup

NAN, INF = float("nan"), float("inf")


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vector_id bigint, values array<float>")
    return df.withColumns({"score": F.lit("x"), "rank": F.lit(1), "query": F.lit(2)}) if extra else df


def ask(spark, *queries):
    return spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id bigint, query array<float>")


def found(df):
    return [(r.query_id, r.vector_id, round(r.score, 4)) for r in df.orderBy("query_id", "rank").collect()]


def test_normalisation_follows_the_fixed_order_of_additions(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(50, 7)).astype(np.float32)
    expected = []
    for v in rows:
        total = 0.0
        for x in v:
            total += float(x) * float(x)
        expected.append([np.float32(float(x) * (1.0 / total**0.5)) for x in v])
    assert (normalise(rows) == np.array(expected)).all()
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(rows)])
    got = df.select("vector_id", vector.normalize_l2("values").alias("v")).orderBy("vector_id").collect()
    assert (np.array([r.v for r in got], np.float32) == np.array(expected)).all()


def test_dot_product_is_equal_in_both_engines(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 40, 9)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<float>, b array<float>")
    got = [r.d for r in df.orderBy("i").select(vector.dot_product("a", "b").alias("d")).collect()]
    assert (np.array(got, np.float32) == exact_scores(a, b)).all()
    uneven = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert uneven.select(vector.dot_product("a", "b")).first()[0] is None


def test_vector_errors_come_in_order(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [NAN, 1.0]), (6, [None, 1.0]), (7, [INF, 0.0]), (8, [0.0, -0.0])]
    got = {r.vector_id: r.e for r in table(spark, rows).select("vector_id", vector.vector_error("values", 2).alias("e")).collect()}
    assert got == {1: None, 2: "dimension", 3: "dimension", 4: "dimension", 5: "not finite", 6: "not finite", 7: "not finite", 8: "zero"}


def test_arrow_matrix_keeps_only_usable_rows():
    import pyarrow as pa

    column = pa.array([[1.0, 2.0], None, [], [NAN, 1.0], [None, 2.0], [0.0, 0.0], [3.0, 4.0]], pa.list_(pa.float32()))
    rows, matrix = valid_matrix(column, 2)
    assert rows.tolist() == [0, 6] and matrix.tolist() == [[1, 2], [3, 4]]
    sliced = column.slice(6, 1)
    assert valid_matrix(sliced, 2)[1].tolist() == [[3, 4]]
    assert (unpack(pack(matrix).slice(1, 1), 2) == matrix[1:]).all()


def test_ties_go_to_the_smaller_id(spark):
    rows = [(30, [0.0, 1.0]), (20, [1.0, -1.0]), (10, [1.0, 1.0]), (40, [-1.0, 0.0])]
    assert [r[1] for r in found(knn.knn(ask(spark, [1.0, 0.0]), table(spark, rows), 3, 2))] == [10, 20, 30]


def test_negative_scores_and_deletion(spark):
    rows = table(spark, [(30, [1.0, 0.0]), (20, [0.0, 1.0]), (10, [-1.0, 0.0]), (40, [0.0, -1.0])])
    left = lookup.survivors(rows, spark.createDataFrame([(20,), (20,)], "vector_id bigint"))
    assert found(knn.knn(ask(spark, [0.0, -1.0]), left, 10, 2)) == [(0, 40, 1.0), (0, 10, 0.0), (0, 30, 0.0)]


def test_no_neighbours_are_asked_before_a_query_is_checked(spark):
    empty = table(spark, [])
    assert found(knn.knn(ask(spark, []), empty, 0, 2)) == []
    knn.check_queries(ask(spark, []), 2, 0)
    for bad in ([], [1.0], [0.0, 0.0], [NAN, 1.0], None):
        with pytest.raises(InvalidArgument):
            knn.check_queries(ask(spark, bad), 2, 1)


def test_nulls_repeats_extra_columns_and_own_k(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.0]), (3, None), (4, [1.0]), (5, [NAN, 1.0])]
    queries = spark.createDataFrame([(7, [1.0, 0.0], 1), (8, [0.0, 1.0], 10), (9, [1.0, 1.0], 0), (10, None, 3), (11, [1.0, 1.0], None), (12, [1.0, 1.0], -1)], "query_id bigint, query array<float>, k int").withColumn("vector_id", F.lit(5))
    got = found(knn.knn(queries, table(spark, rows, extra=True), "k", 2))
    assert got == [(7, 1, 1.0), (8, 2, 1.0), (8, 1, 0.0)]
    with pytest.raises(LimitExceeded):
        knn.knn(queries, table(spark, rows), "k", 2, limits=ResourceLimits(top_k=9))


def test_ids_beyond_the_signed_range_are_ordered_as_unsigned(spark):
    rows = table(spark, [(-1, [1.0, 0.0]), (5, [1.0, 0.0])])  # -1 holds the bits of 2^64 - 1
    assert [r[1] for r in found(knn.knn(ask(spark, [1.0, 0.0]), rows, 2, 2))] == [5, -1]


def test_equal_to_brute_force_in_blocks_of_queries(spark):
    rng = np.random.default_rng(3)
    data = np.round(rng.normal(size=(300, 5)), 1).astype(np.float32)
    data[::7] = data[0]
    unit = normalise(data)
    df = table(spark, [(int(i), v.tolist()) for i, v in enumerate(data)]).repartition(5)
    queries = df.where("vector_id % 10 = 0").select(F.col("vector_id").alias("query_id"), F.col("values").alias("query"))
    for exclude in (False, True):
        got = found(knn.knn(queries, df, 6, 5, exclude_self=exclude, query_block=8))
        expected = []
        for q in range(0, 300, 10):
            score = exact_scores(np.repeat(unit[q : q + 1], 300, axis=0), unit)
            order = [i for i in np.lexsort((np.arange(300), -score)) if not (exclude and i == q)][:6]
            expected += [(q, int(i), round(float(score[i]), 4)) for i in order]
        assert got == expected


def test_check_vectors_names_the_first_rule(spark):
    for rows, name in (([(1, [1.0])], "dimension"), ([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "duplicate"), ([(1, [NAN, 0.0])], "finite"), ([(1, [0.0, 0.0])], "zero"), ([(None, [1.0, 1.0])], "null")):
        with pytest.raises(InvalidArgument, match=name):
            knn.check_vectors(table(spark, rows), 2)
    knn.check_vectors(table(spark, [(1, [1.0, 2.0])]), 2)


def test_lookup_and_id_sets(spark):
    results = spark.createDataFrame([(0, 0, 11, 1.0)], "query_id bigint, rank int, vector_id bigint, score float")
    chunks = spark.createDataFrame([(11, "d", 0, "chunk 11", "s"), (11, "d", 0, "chunk 11", "s"), (None, "d", 1, "x", "s")], "vector_id bigint, document_id string, chunk_id int, text string, source string")
    assert lookup.with_chunks(results, chunks).first().text == "chunk 11"
    with pytest.raises(InvalidArgument):
        lookup.with_chunks(results, chunks.where("vector_id = 99"))
    assert lookup.with_chunks(results, chunks.where("vector_id = 99"), strict=False).first().text is None
    a, b = (spark.createDataFrame([(x,) for x in ids], "vector_id bigint") for ids in ((1, 1, 2, None), (2, 3)))
    assert sorted(map(tuple, lookup.id_mismatch(a, b).collect())) == [(1, "left"), (3, "right")]
    with pytest.raises(InvalidArgument):
        lookup.check_same_ids(a, b)
    lookup.check_same_ids(a, a)


def test_kernels():
    assert {k: knn.resolve_kernel(k) for k in ("scalar", "auto", "avx2")} == {"scalar": "expression", "auto": "arrow", "avx2": "arrow"}
    with pytest.raises(InvalidArgument):
        knn.resolve_kernel("gpu")


def test_deletion_prefixes_are_nested(spark):
    rows = spark.range(500).select(F.col("id").alias("vector_id"))
    sets = [{r.vector_id for r in lookup.deletion_prefix(rows, p, seed=3).collect()} for p in (0, 10, 25, 100)]
    assert [len(s) for s in sets] == [0, 50, 125, 500] and sets[1] < sets[2] < sets[3]
    again = {r.vector_id for r in lookup.deletion_prefix(rows.repartition(3), 10, seed=3).collect()}
    assert again == sets[1]


def test_vote_and_leaks(spark):
    near = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 1), (1, 2)], "query_id bigint, vector_id bigint")
    labels = spark.createDataFrame([(1, 5), (2, 4), (3, 5)], "vector_id bigint, label int")
    assert sorted(map(tuple, knn.vote(near, labels).collect())) == [(0, 5, 2), (1, 4, 1)]
    gone = spark.createDataFrame([(3,)], "vector_id bigint")
    assert [tuple(r) for r in lookup.leaked(near, gone).collect()] == [(0, 3)]
