import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions.arrow_vectors import exact_scores, normalise
from vecloom.llm import cells, clusters, neighbours

NAN = float("nan")


def table(spark, ids, rows, extra=()):
    data = [(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, rows, strict=True)] + list(extra)
    return spark.createDataFrame(data, "id bigint, values array<float>").withColumns({"near": F.lit("x"), "h": F.lit(1), "vec": F.lit(2), "cell": F.lit(3)})


def blobs(seed, sizes, noise, dim=16, spread=0.12):
    rng = np.random.default_rng(seed)
    rows = [c / np.linalg.norm(c) + rng.normal(scale=spread, size=(n, dim)) for n, c in zip(sizes, rng.normal(size=(len(sizes), dim)), strict=True)]
    return np.concatenate([*rows, rng.normal(size=(noise, dim))]).astype(np.float32)


def brute_neighbours(ids, rows, k, least):
    unit = normalise(rows)
    out = {}
    for q in range(len(ids)):
        score = exact_scores(np.repeat(unit[q : q + 1], len(ids), axis=0), unit)
        order = [i for i in np.lexsort((ids, -score)) if i != q and score[i] >= least][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def found(df):
    return {r.id: list(zip(r.near, [round(s, 5) for s in r.score], strict=True)) for r in df.collect()}


def same(a, b):
    return {k: [(i, round(s, 5)) for i, s in v] for k, v in b.items() if v} == a


@pytest.mark.parametrize("block_rows", [16_384, 20])
def test_one_list_is_exact_with_ties_and_repeats(spark, block_rows):
    rows = blobs(1, [40, 25], 30)
    rows[5] = rows[4]
    rows[6] = 2 * rows[4]
    ids = np.random.default_rng(2).permutation(10_000)[: len(rows)]
    bad = [(None, [1.0] * 16), (77_001, None), (77_002, []), (77_003, [1.0]), (77_004, [NAN] * 16), (77_005, [0.0] * 16), (77_006, [None] * 16), (int(ids[0]), rows[0].tolist())]
    df = table(spark, ids, rows, bad).repartition(5)
    for least in (None, 0.8):
        got = found(neighbours.nearest_vectors(df, 5, least=least, dimension=16, list_rows=1 << 30, block_rows=block_rows))
        assert same(got, brute_neighbours(ids, rows, 5, -2 if least is None else least))


def test_lists_find_nearly_all(spark):
    rows = blobs(3, [150, 90, 60, 40, 30, 20, 15], 300)
    ids = np.arange(len(rows)) * 3
    df = table(spark, ids, rows)
    expected = {(min(q, i), max(q, i)) for q, near in brute_neighbours(ids, rows, 5, 0.8).items() for i, _ in near}
    got = {tuple(r) for r in neighbours.similar_pairs(df, 5, 0.8, 16).collect()}
    assert len(got & expected) >= 0.95 * len(expected) and len(got & expected) >= 0.95 * len(got)
    near = found(neighbours.nearest_vectors(df, 10, queries=F.col("id") % 100 == 0, dimension=16, list_rows=50, replicas=2, probes=16, query_ratio=0.5))
    truth = {q: v for q, v in brute_neighbours(ids, rows, 10, -2).items() if q % 100 == 0}
    assert set(near) == set(truth)
    recall = np.mean([len({i for i, _ in near[q]} & {i for i, _ in truth[q]}) / 10 for q in truth])
    assert recall >= 0.9


def test_a_third_of_all_vectors_identical(spark, monkeypatch):
    monkeypatch.setattr(cells, "HOT_COPIES", 20)
    monkeypatch.setattr(cells, "MAX_HOT", 8)
    rows = blobs(4, [30], 40)
    rows = np.concatenate([np.repeat(rows[:1], 60, axis=0), rows])
    ids = np.random.default_rng(5).permutation(5_000)[: len(rows)]
    df = table(spark, ids, rows).repartition(6)
    got = found(neighbours.nearest_vectors(df, 3, dimension=16, list_rows=1 << 30))
    assert same(got, brute_neighbours(ids, rows, 3, -2))
    members = {r.id: r.typical_id for r in clusters.similarity_clusters(df, dimension=16, cell_rows=1 << 30).collect()}
    assert set(ids[:60].tolist()) <= set(members)


def test_empty_tables_and_no_neighbours(spark):
    empty = table(spark, [], [])
    assert neighbours.nearest_vectors(empty, 5).count() == 0 and clusters.similarity_clusters(empty).count() == 0
    assert neighbours.nearest_vectors(table(spark, [1], [[1.0, 0.0]]), 5, dimension=2).count() == 0
    assert neighbours.nearest_vectors(table(spark, [1, 2], [[1.0, 0.0], [1.0, 0.0]]), 0, dimension=2).count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest_vectors(empty, -1)


def test_one_of_several_vectors_of_an_id_is_kept(spark):
    df = table(spark, [1, 1, 2], [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    assert set(found(neighbours.nearest_vectors(df, 5, dimension=2))) == {1, 2}
    assert cells.Collection.of(df, 2).n == 2


def expected_clusters(ids, rows, least, smallest):
    """Connected by similarity; valid as these clusters are far apart."""
    unit = normalise(rows).astype(np.float64)
    near = unit @ unit.T >= least
    left, out = set(range(len(ids))), {}
    while left:
        seen, front = set(), [min(left)]
        while front:
            i = front.pop()
            if i not in seen:
                seen.add(i)
                front += np.flatnonzero(near[i]).tolist()
        left -= seen
        if len(seen) >= smallest:
            m = np.array(sorted(seen))
            typical = m[np.argmax(np.round(unit[m] @ unit[m].sum(axis=0), 7))]
            out |= {int(ids[i]): int(ids[typical]) for i in m}
    return out


@pytest.mark.parametrize("options", [{"cell_rows": 1 << 30}, {"cell_rows": 60}, {"cell_rows": 1 << 30, "local_rows": 120}, {"cell_rows": 1 << 30, "exact_rows": 120}, {"cell_rows": 100, "block_rows": 200}])
def test_clusters(spark, options):
    rows = blobs(6, [80, 50, 30, 14, 9], 120, spread=0.08)
    rows[3] = 5 * rows[2]
    ids = np.arange(len(rows)) * 7 + 1
    bad = [(None, [1.0] * 16), (900_001, None), (900_002, [0.0] * 16), (int(ids[0]), rows[0].tolist())]
    got = {r.id: r.typical_id for r in clusters.similarity_clusters(table(spark, ids, rows, bad).repartition(4), dimension=16, **options).collect()}
    expected = expected_clusters(ids, rows, 0.8, 10)
    assert len(set(expected.values())) == 4
    assert len(set(got.items()) & set(expected.items())) >= 0.98 * len(expected) and set(got.items()) <= set(expected.items())


def test_a_chain_is_cut_around_its_typical_members(spark):
    angles = np.linspace(0, np.pi * 0.9, 90)
    rows = np.stack([np.cos(angles), np.sin(angles)], axis=1).astype(np.float32)
    got = clusters.similarity_clusters(table(spark, range(90), rows), dimension=2, cell_rows=1 << 30).collect()
    assert len(got) > 60 and all(r.similarity >= 0.8 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.typical_id, []).append(r.id)
    unit = normalise(rows).astype(np.float64)
    for typical, members in by.items():
        assert typical in members and len(members) >= 10 and {r.size for r in got if r.typical_id == typical} == {len(members)}
        total = unit[members].sum(axis=0)
        assert unit[typical] @ total >= (unit[members] @ total).max() - 1e-6


def test_centroid_graph_finds_the_nearest(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(600, 8)).astype(np.float32)
    points = rng.normal(size=(500, 8)).astype(np.float32)
    graph = cells.CentroidGraph(centres)
    true, far = cells.nearest(points, centres, 3)
    got, distance = graph.search(points, 3)
    assert (got[:, 0] == true[:, 0]).mean() > 0.9
    hit = got[:, 0] == true[:, 0]
    assert np.allclose(distance[hit, 0], np.sqrt(far[hit, 0]), atol=1e-3)


def test_a_dense_mass_is_clustered_in_parts():
    rng = np.random.default_rng(9)
    mass = normalise((np.ones((700, 8)) + rng.normal(scale=1e-4, size=(700, 8))).astype(np.float32))
    small = normalise((np.eye(8)[0] * 3 - 1 + rng.normal(scale=0.05, size=(12, 8))).astype(np.float32))
    label, core = clusters.local_clusters(np.concatenate([mass, small]), 0.8, 4, local_rows=100)
    assert core.all() and len(set(label[:700])) == 1 and len(set(label[700:])) == 1 and label[0] != label[-1]


def test_large_lists_are_divided_without_much_loss(spark, monkeypatch):
    rows = blobs(12, [150, 90, 60, 40, 30, 20, 15], 300)
    ids = np.arange(len(rows)) * 3
    df = table(spark, ids, rows)
    monkeypatch.setattr(cells, "MAX_CENTROIDS", 4)
    layout = []
    real = cells.spread
    monkeypatch.setattr(neighbours, "spread", lambda *a: layout.append(real(*a)) or layout[-1])
    truth = brute_neighbours(ids, rows, 5, 0.8)
    near = found(neighbours.nearest_vectors(df, 5, least=0.8, dimension=16, block_rows=120, visits=1))
    hit = sum(len({i for i, _ in near.get(q, [])} & {i for i, _ in v}) for q, v in truth.items())
    assert hit >= 0.9 * sum(map(len, truth.values()))
    sizes = layout[0].groupBy("cell", "block").count()
    assert sizes.agg(F.max("count")).first()[0] <= 360 and sizes.count() > 4


def test_samples_of_huge_collections_are_not_empty(spark):
    ids = spark.range(200_000)
    assert 0 < ids.where(cells.hashed_below(1e-4, 1)).count() < 100
    # 65,536 of 4e11 vectors: the bound of the hash is far from 0, so its rounding is immaterial
    bound = round(65_536 / 4e11 * (1 << 53))
    assert abs(bound / (1 << 53) * 4e11 - 65_536) < 1


def test_a_mass_that_cannot_be_divided_keeps_its_neighbours(spark):
    rng = np.random.default_rng(3)
    mass = np.ones((900, 16)) + rng.normal(scale=1e-7, size=(900, 16))
    # beside the mass, a sparse group of its own and vectors at the edge of the mass
    group = np.eye(16)[0] * 3 - 1 + rng.normal(scale=0.1, size=(30, 16))
    edge = np.ones((5, 16)) + 2.2 * np.eye(16)[3:8]
    rows = np.concatenate([mass, group, edge]).astype(np.float32)
    df = table(spark, range(len(rows)), rows)
    whole, parts = ({r.id: r.typical_id for r in clusters.similarity_clusters(df, dimension=16, cell_rows=1 << 30, **o).collect()} for o in ({}, {"block_rows": 200}))
    assert whole.keys() == parts.keys() and len(set(parts.values())) == len(set(whole.values())) == 2


def test_few_are_compared_around_a_mass():
    rng = np.random.default_rng(5)
    rows = normalise(np.concatenate([np.ones((60, 8)) + rng.normal(scale=0.01, size=(60, 8)), blobs(2, [12, 9], 40, dim=8, spread=0.1)]).astype(np.float32))
    inner = np.arange(len(rows)) < 60
    a, b = clusters.density_clusters(rows, 0.8, 4), clusters.around_mass(rows, inner, 0.8, 4)
    assert (a[1] == b[1]).all() and ((a[0] >= 0) == (b[0] >= 0)).all()
    core = a[1]
    assert len({*zip(a[0][core].tolist(), b[0][core].tolist(), strict=True)}) == len(set(a[0][core].tolist())) == len(set(b[0][core].tolist()))
