"""Problem 1: groups of mutually similar vectors, by density clustering over overlapping cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.arrow_vectors import exact_scores, pack, unpack
from vecloom.llm.cells import MASS, CentroidGraph, Collection, Layout, fit_centroids, nearest, spread
from vecloom.llm.shingles import mixed
from vecloom.operators.components import connected_components
from vecloom.session import materialise

#: Vectors a cell should hold before margins are added.
CELL_ROWS = 600
#: A cell that may hold more, margins included, is divided by cells of its own: half-precision vectors of 4 MB in a task.
BLOCK_ROWS = 32_768
#: Vectors that a task compares all with all; a cell that holds more than was expected is partitioned once more within its task.
EXACT_ROWS = 65_536
#: Clusters of up to so many vectors are taken apart by one task.
LOCAL_ROWS = 6_144
#: Reduced components the space is partitioned by.
REDUCED = 32
#: Clusters with more members than max(HOT_ROWS, n / MAX_HOT_CLUSTERS) are joined by broadcast: at most MAX_HOT_CLUSTERS rows of 0.6 KB.
HOT_ROWS, MAX_HOT_CLUSTERS = 20_000, 512
#: Vectors whose sums, one for each batch of 10,000 and cluster, one task adds up.
BATCH_SUMS = 100_000_000


def principal_axes(sample: np.ndarray, components: int) -> np.ndarray:
    """Orthonormal columns that keep most of the sample's variance; a projection never grows a distance."""
    wide = sample.astype(np.float64)
    values, axes = np.linalg.eigh(wide.T @ wide / max(1, len(wide)))
    return np.ascontiguousarray(axes[:, np.argsort(-values)[:components]].astype(np.float32))


def density_clusters(vectors: np.ndarray, least: float, points: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Local clusters (-1: none) and core flags. A core has ``points`` vectors, itself included, at cosine >= ``least``."""
    n = len(vectors)
    count = np.empty(n, np.int64)
    for i in range(0, n, block):
        count[i : i + block] = (vectors[i : i + block] @ vectors.T >= least).sum(axis=1)
    core = count >= points
    label = np.full(n, -1, np.int64)
    number = 0
    for start in np.flatnonzero(core):
        if label[start] >= 0:
            continue
        label[start] = number
        front = np.array([start])
        while len(front):
            # each core is compared with what is still open, once
            free = np.flatnonzero(label < 0)
            near = np.zeros(len(free), bool)
            for i in range(0, len(front), block):
                near |= (vectors[front[i : i + block]] @ vectors[free].T >= least).any(axis=0)
            label[free[near]] = number
            front = free[near & core[free]]
        number += 1
    return label, core


def mass_cosine(least: float) -> float:
    """A cosine to a common centre from which any two vectors have at least ``least`` with each other, with room for half precision."""
    return float(np.cos(np.arccos(least) / 2)) + 2e-3


def chord(cosine: float) -> float:
    """The distance of unit vectors with a cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def around_mass(vectors: np.ndarray, inner: np.ndarray, least: float, points: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """:func:`density_clusters` where the ``inner`` vectors, at least ``points``, are known to be near each other.

    They are cores of one cluster, number 0, without being compared; only the others are, with all.
    """
    outer = np.flatnonzero(~inner)
    core, label = inner.copy(), np.where(inner, 0, -1)
    touches, edges = np.zeros(len(outer), bool), []
    for i in range(0, len(outer), block):
        near = vectors[outer[i : i + block]] @ vectors.T >= least
        core[outer[i : i + block]] = near.sum(axis=1) >= points
        touches[i : i + block] = near[:, inner].any(axis=1)
        a, b = np.nonzero(near[:, outer])
        edges.append((a + i, b))
    if not len(outer):
        return label, core
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
    dense = core[outer]
    # cores take the smallest number among their core neighbours until nothing changes; 0 is the mass
    number = np.where(dense & touches, 0, np.arange(1, len(outer) + 1))
    both = dense[a] & dense[b]
    while True:
        lower = number.copy()
        np.minimum.at(lower, a[both], number[b[both]])
        if (lower == number).all():
            break
        number = lower
    border = np.full(len(outer), len(outer) + 1)
    border[touches] = 0
    near_core = dense[b]
    np.minimum.at(border, a[near_core], number[b[near_core]])
    number = np.where(dense, number, border)
    label[outer] = np.where(number <= len(outer), number, -1)
    return label, core


def local_clusters(vectors: np.ndarray, least: float, points: int, local_rows: int, cells: int = 3, margin: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`density_clusters` for any number of vectors: overlapping cells within the task, joined by shared core points.

    Cells that are still too large are partitioned again; where most vectors are in one place, that place is one
    cluster and only the others are compared, see :func:`around_mass`.
    """
    n = len(vectors)
    if n <= local_rows:
        return density_clusters(vectors, least, points)
    centre = vectors.mean(axis=0, dtype=np.float64)
    inner = vectors @ (centre / max(np.linalg.norm(centre), 1e-30)).astype(np.float32) >= mass_cosine(least)
    if inner.sum() * 2 > n:
        return around_mass(vectors, inner, least, points)
    centres = fit_centroids(vectors[:: max(1, n // 16_384)], max(2, round(4 * cells * n / local_rows)))
    near, far = nearest(vectors, centres, cells)
    row, col = np.nonzero(np.sqrt(far) <= np.maximum(np.sqrt(far[:, :1]) * (1 + margin), chord(least)))
    cell = near[row, col]
    order = np.argsort(cell, kind="stable")
    at, label, core, count = [], [], np.zeros(n, bool), 0
    for own in np.split(row[order], np.flatnonzero(np.diff(cell[order])) + 1):
        # a cell as large as the whole would never end: it is compared around whatever is in one place
        part = local_clusters(vectors[own], least, points, local_rows, cells, margin) if len(own) < 0.9 * n else around_mass(vectors[own], inner[own] & (inner[own].sum() >= points), least, points)
        core[own] |= part[1]
        inside = part[0] >= 0
        at.append(own[inside])
        label.append(part[0][inside] + count)
        count += int(part[0].max(initial=-1)) + 1
    at, label, parent = np.concatenate(at), np.concatenate(label), np.arange(count)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.lexsort((label, at))
    at, label = at[order], label[order]
    again = np.flatnonzero((at[1:] == at[:-1]) & core[at[1:]])
    for x, y in np.unique(np.stack([label[again], label[again + 1]], axis=1), axis=0).tolist():
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    out = np.full(n, -1, np.int64)
    out[at[::-1]] = [find(x) for x in label[::-1].tolist()]
    return out, core


def peel(ids: np.ndarray, vectors: np.ndarray, least: float, smallest: int, points: int) -> list[tuple[int, np.ndarray]]:
    """All groups of one density component, as (place of the most typical member, places of the members).

    The members near the most typical one are measured again until all are near it; what is then left is
    clustered by density anew, so no group waits for a pass of its own. A most typical member with too few
    vectors around it, such as one between two groups, is set aside alone. Last, whatever is in no group is
    offered to the groups, the nearest first, and joins one whose members all stay near its most typical one.
    """
    order = np.argsort(ids, kind="stable")
    vectors = vectors[order]
    wide = vectors.astype(np.float64)

    def typical(own: np.ndarray) -> int:
        return int(own[np.argmax(np.round(wide[own] @ wide[own].sum(axis=0), 7))])

    def near(own: np.ndarray, centre: int) -> np.ndarray:
        return exact_scores(vectors[own], np.repeat(vectors[centre : centre + 1], len(own), axis=0)) >= least

    groups, waiting = [], [np.arange(len(ids))]
    while waiting:
        whole = waiting.pop()
        if len(whole) < smallest:
            continue
        own, centre = whole, typical(whole)
        while len(own) >= smallest and not (close := near(own, centre)).all():
            own = own[close]
            centre = typical(own) if len(own) >= smallest else centre
        if len(own) < smallest:
            waiting.append(whole[whole != centre])
            continue
        groups.append((centre, own))
        rest = np.setdiff1d(whole, own)
        label, _ = density_clusters(vectors[rest], least, points)
        waiting += [rest[label == k] for k in range(label.max(initial=-1) + 1)]
    free = np.ones(len(ids), bool)
    for _, own in groups:
        free[own] = False
    for i in np.flatnonzero(free) if groups else ():
        score = exact_scores(vectors[[c for c, _ in groups]], np.repeat(vectors[i : i + 1], len(groups), axis=0))
        for g in np.argsort(-score, kind="stable"):
            if score[g] < least:
                break
            own = np.union1d(groups[g][1], [i])
            if near(own, centre := typical(own)).all():
                groups[g] = (centre, own)
                break
    return [(int(order[centre]), order[own]) for centre, own in groups]


def _peel_cluster(dimension: int, least: float, smallest: int, points: int):
    def run(table: pa.Table) -> pa.Table:
        ids, vectors = table["id"].to_numpy(), unpack(table["vec"], dimension)
        out = [(ids[own], np.full(len(own), ids[c]), np.full(len(own), len(own)), exact_scores(vectors[own], np.repeat(vectors[c : c + 1], len(own), axis=0))) for c, own in peel(ids, vectors, least, smallest, points)]
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.float32)]
        return pa.table(dict(zip(("id", "typical_id", "size", "score"), columns, strict=True)))

    return run


def _local_numbers(cell: int, block: int, label: np.ndarray) -> np.ndarray:
    """Numbers of local clusters that no two cells or blocks share."""
    start = np.array([(cell * 0xC2B2AE3D27D4EB4F + block + 1) & (1 << 64) - 1], np.uint64)
    return mixed(mixed(start) + label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _cluster_cell(dimension: int, least: float, points: int, local_rows: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        ids, first = np.unique(ids, return_index=True)
        vectors = unpack(table["vec"], dimension, np.float16)[first].astype(np.float32)
        inner = (table["role"].to_numpy()[first] & MASS) > 0
        cell, block = (x.as_py() for x in key)
        if inner.sum() >= points:
            label, core = around_mass(vectors, inner, least, points)
        else:
            label, core = local_clusters(vectors, least, points, local_rows)
        inside = label >= 0
        local = _local_numbers(cell, block, label[inside])
        if inner.sum() >= points:
            # the mass is one cluster in all of its blocks
            local[label[inside] == 0] = _local_numbers(cell, -1, np.zeros(1, np.int64))[0]
        return pa.table({"id": ids[inside], "local": local, "core": core[inside]})

    return run


def _sums(dimension: int):
    """Per batch and cluster the sum of vectors and their number, so that little is shuffled."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster = batch.column(0).to_numpy()
            order = np.argsort(cluster, kind="stable")
            keys, starts = np.unique(cluster[order], return_index=True)
            total = np.add.reduceat(unpack(batch.column(1), dimension)[order].astype(np.float64), starts, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.diff(np.append(starts, len(cluster)))), pack(total)], names=["cluster", "size", "total"])

    return run


def _add_up(dimension: int):
    def run(table: pa.Table) -> pa.Table:
        total = unpack(table["total"], dimension, np.float64)
        order = np.lexsort(total.T[::-1])  # a fixed order, so that rounding never depends on the partitioning
        return pa.table({"cluster": table["cluster"][:1], "size": [int(table["size"].to_numpy().sum())], "total": pack(total[order].sum(axis=0, keepdims=True))})

    return run


def _typicality(dimension: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = np.einsum("ij,ij->i", unpack(batch.column(2), dimension).astype(np.float64), unpack(batch.column(3), dimension, np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(score, 7)), batch.column(2)], names=["id", "cluster", "score", "vec"])

    return run


def _similarity(dimension: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = exact_scores(unpack(batch.column(4), dimension), unpack(batch.column(5), dimension))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(score)], names=["id", "cluster", "typical_id", "size", "vec", "score"])

    return run


def join_clusters(rows: DataFrame, clusters: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """Inner join of many rows to one row per key, where one key may hold any share of the rows.

    Keys above a size that at most MAX_HOT_CLUSTERS keys can reach are joined by broadcast; only the
    others are shuffled by key.
    """
    limit = max(HOT_ROWS, n // MAX_HOT_CLUSTERS)
    hot, cold = clusters.where(F.col(size) > limit), clusters.where(F.col(size) <= limit)
    keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(keys, key, "left_anti").join(cold, key))


def _density_labels(found: Collection, vectors: DataFrame, first: tuple[CentroidGraph, np.ndarray], layout: Layout, least: float, points: int, exact_rows: int) -> DataFrame:
    """``(id, cluster)`` of the vectors (of ``found.vectors()``) in a density component, and of the copies of hot ones."""
    dealt = spread(vectors.withColumn("asks", F.lit(False)), *first, found.n, layout)
    local = materialise(dealt.groupBy("cell", "block").applyInArrow(_cluster_cell(layout.dimension, least, points, exact_rows), "id bigint, local bigint, core boolean"), "local")

    # local clusters that hold the same vector, a core of at least one of them, are joined
    several = local.groupBy("id").agg(F.collect_set("local").alias("all"), F.max("core").alias("core"), F.min("local").alias("first"))
    links = several.where("core and size(all) > 1").select("first", F.explode("all").alias("other")).where("first <> other").distinct()
    merged = connected_components(links, "first", "other")
    of_local = local.select("local").distinct().join(merged.withColumnRenamed("node", "local"), "local", "left").select("local", F.coalesce("component", "local").alias("cluster"))
    # a border point that several clusters reach goes to one with it as a core, else to the smallest key
    labels = local.join(of_local, "local").groupBy("id").agg(F.min(F.struct(~F.col("core"), "cluster")).alias("m")).select("id", "m.cluster")
    if found.copies is not None:
        # the copies of a hot vector have its scores, so they are wherever its smallest ids are
        hot = labels.join(found._smallest(), "id").groupBy("h").agg(F.min("cluster").alias("cluster"))
        labels = labels.unionByName(found.copies.join(F.broadcast(hot), "h").select("id", "cluster"))
    return labels


def similarity_clusters(
    table: DataFrame,
    least: float = 0.8,
    smallest: int = 10,
    points: int = 4,
    dimension: int = 64,
    cells: int = 3,
    margin: float = 0.3,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    exact_rows: int = EXACT_ROWS,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """``(id, typical_id, size, similarity FLOAT)`` of every vector that lies in a cluster.

    A cluster has at least ``smallest`` vectors, each with a cosine of at least ``least`` to the cluster's
    most typical member, the one with the greatest mean cosine to all members (ties: the smaller id).

    The vectors' principal components partition the space into balanced cells; a vector goes to its home
    cell and to up to ``cells`` - 1 more in whose margin (distance up to 1 + ``margin`` times the nearest,
    or within the radius of ``least``) it lies. Cells that may hold over ``block_rows`` rows are divided again in the same way, see
    :func:`~vecloom.llm.cells.spread`. Each cell is clustered by density on its own (a core has ``points`` vectors at cosine >=
    ``least``); local clusters that share a core point are one. Where members are too far from the most typical
    one, a cluster of up to ``local_rows`` is taken apart by a single task (:func:`peel`); of a larger one the
    far members are clustered by density again, in further passes until no cluster is left to take apart.

    Null ids and invalid vectors are in no cluster; repeated rows count once, as in
    :class:`~vecloom.llm.cells.Collection`; an empty table gives no rows.
    """
    spark = table.sparkSession
    schema = "id bigint, typical_id bigint, size bigint, similarity float"
    found = Collection.of(table, dimension, keep=max(16, points, smallest))
    if not found.n:
        return spark.createDataFrame([], schema)
    sample = found.sample()
    axes = principal_axes(sample, min(REDUCED, dimension))
    graph = CentroidGraph(fit_centroids(sample @ axes, round(found.n / cell_rows)))
    layout = Layout(dimension, (cells, margin), cell_rows=cell_rows, task_rows=block_rows, axes=axes, half=True, floor=chord(least), mass=mass_cosine(least))
    options = ((graph, sample), layout, least, points, exact_rows)
    labels = _density_labels(found, found.vectors(), *options)
    # of the vectors only members are kept; every row repeated unchanged goes here
    everyone = found._valid(False) if not found._resolve else found._valid(True).join(found.members, ["id", "h"], "left_semi").select("id", "vec")
    members = materialise(everyone.join(labels, "id").dropDuplicates(["id"]).select("id", "cluster", "vec"), "members")

    done = None
    again = 0
    while True:
        settled, near, far = _around_typical(members, least, smallest, points, dimension, found.n, local_rows)
        done = settled if done is None else done.unionByName(settled)
        if near is None:
            break
        # each pass settles a large cluster or makes it smaller by one vector at least, so they end
        left = found.vectors().join(far.select("id"), "id", "left_semi")
        labels = _density_labels(found, left, *options).withColumn("cluster", F.xxhash64("cluster", F.lit(again)))
        members = materialise(near.unionByName(far.join(labels, "id").dropDuplicates(["id"]).select("id", "cluster", "vec")), "rest")
        again += 1
    return done.select("id", "typical_id", F.col("size").cast("bigint").alias("size"), F.col("score").alias("similarity"))


def _around_typical(members: DataFrame, least: float, smallest: int, points: int, dimension: int, n: int, local_rows: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Clusters all of whose members are near their most typical one, and near and far members of the others.

    Others of up to ``local_rows`` members are taken apart at once. Near members of a larger one stay together
    and are measured again, as their most typical member may be another one now; if they are too few for a
    cluster, only the most typical one is set aside and the rest counts as far.
    """
    sums = members.select("cluster", "vec").mapInArrow(_sums(dimension), "cluster bigint, size bigint, total binary")
    salts = n // BATCH_SUMS
    if salts > 1:
        # a cluster may hold most of the vectors: its sums are added up in parts first
        sums = sums.groupBy("cluster", F.pmod(F.xxhash64("total"), F.lit(salts)).alias("salt")).applyInArrow(_add_up(dimension), "cluster bigint, size bigint, total binary")
    totals = sums.groupBy("cluster").applyInArrow(_add_up(dimension), "cluster bigint, size bigint, total binary")
    totals = materialise(totals.where(F.col("size") >= smallest), "totals")
    scored = join_clusters(members, totals, "cluster", "size", n).select("id", "cluster", "vec", "total").mapInArrow(_typicality(dimension), "id bigint, cluster bigint, score double, vec binary")
    typical = scored.groupBy("cluster").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "vec")).alias("best"))
    typical = materialise(typical.join(totals, "cluster").select("cluster", "size", F.col("best.id").alias("typical_id"), F.col("best.vec").alias("centre")), "typical")
    judged = join_clusters(members, typical, "cluster", "size", n).select("id", "cluster", "typical_id", "size", "vec", "centre").mapInArrow(_similarity(dimension), "id bigint, cluster bigint, typical_id bigint, size bigint, vec binary, score float")
    judged = materialise(judged, "judged")
    close = F.col("score") >= least
    open_ones = judged.groupBy("cluster").agg(F.max("size").alias("size"), F.count_if(close).alias("close"), F.count_if(~close).alias("away")).where("away > 0").select("cluster", "size", (F.col("close") >= smallest).alias("enough"))
    open_ones = materialise(open_ones, "open")
    settled = judged.join(open_ones.select("cluster"), "cluster", "left_anti").drop("vec", "cluster")
    few, many = open_ones.where(F.col("size") <= local_rows), open_ones.where(F.col("size") > local_rows)
    if not few.isEmpty():
        # at most local_rows vectors a task
        parts = judged.join(few.select("cluster"), "cluster").select("id", "cluster", "vec").groupBy("cluster")
        settled = settled.unionByName(materialise(parts.applyInArrow(_peel_cluster(dimension, least, smallest, points), "id bigint, typical_id bigint, size bigint, score float"), "peeled"))
    if many.isEmpty():
        return settled, None, None
    rest = materialise(join_clusters(judged.select("id", "cluster", "typical_id", "vec", "score"), many, "cluster", "size", n), "rest")
    stays = close & F.col("enough")
    return settled, rest.where(stays).select("id", "cluster", "vec"), rest.where(~stays & (F.col("enough") | (F.col("id") != F.col("typical_id")))).select("id", "vec")
