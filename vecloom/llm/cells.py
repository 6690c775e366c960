"""Cells of a vector collection: what clustering (problem 1) and neighbour search (problem 4) share.

The collection is read as *valid* vectors, centroids are fitted on a bounded sample in the driver, and
every vector is then sent to the cells of its nearest centroids. All that is broadcast is the centroids
(at most ``MAX_CENTROIDS`` rows) and the keys of very frequent vectors (at most ``MAX_HOT`` keys). Cells that
are still too large for a task are divided again by centroids of their own, which are fitted in tasks, so the
number of cells grows with the data and a cell's rows do not.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.arrow_vectors import normalise, pack, unpack, valid_matrix
from vecloom.llm.shingles import mixed
from vecloom.operators.skew import split_join
from vecloom.session import materialise, stored_rows

#: Rows the centroids are fitted on, at most: 64 components of 4 bytes make 17 MB in the driver.
SAMPLE_ROWS = 65_536
#: Centroids at most: 2 MB broadcast.
MAX_CENTROIDS = 8_192
#: Identical vectors with more copies than max(HOT_COPIES, n / MAX_HOT) are handled as one group; so there are at most MAX_HOT such groups.
HOT_COPIES, MAX_HOT = 256, 4_096
#: Rows of a cell that its own centroids are fitted on, and rows that one task sends on.
CELL_SAMPLE, ROUTE_ROWS = 16_384, 65_536
#: What a row is in a cell: it asks, it answers, it lies in the mass of a cell that cannot be divided.
QUERY, DATA, MASS = 1, 2, 4
ROUTED = "cell bigint, block int, id bigint, role tinyint, vec binary"
_OPEN, _HASH_BITS = -1, 53


def hashed_below(share: float, seed: int) -> Column:
    """A condition on ``id`` that holds for about a share of all ids, the same for every run; shares down to 1e-15 are kept apart."""
    return F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 64 - _HASH_BITS) < F.lit(min(1 << _HASH_BITS, round(share * (1 << _HASH_BITS))))


def _normalised(dimension: int, hashed: bool):
    def run(batches):
        for batch in batches:
            rows, matrix = valid_matrix(batch.column(1), dimension)
            unit = normalise(matrix)
            # extreme components can overflow or vanish when squared; such a row has no direction
            fine = np.isfinite(unit).all(axis=1) & (unit != 0).any(axis=1)
            rows, unit = rows[fine], np.ascontiguousarray(unit[fine])
            ids = batch.column(0).take(pa.array(rows))
            columns, names = [ids, pack(unit)], ["id", "vec"]
            if hashed:
                # adding 0.0 turns -0.0 into 0.0, so that equal vectors get equal keys
                columns.append(pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in unit + np.float32(0)], pa.binary()))
                names.append("h")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


@dataclass
class Collection:
    """The valid vectors of a table, each id once.

    ``n`` distinct ids; ``vectors()`` has ``id BIGINT, vec BINARY`` (float32, length 1). An id that is
    repeated unchanged counts once; one that has several different valid vectors keeps the one with the
    smallest 16-byte key. ``copies`` holds (id, h) of the ids left out of ``vectors()`` because more than
    ``keep`` smaller ids have the identical, very frequent vector; it is None if there are none.
    """

    source: DataFrame
    dimension: int
    n: int = 0
    keep: int = 0
    hot: list[bytes] = field(default_factory=list)
    members: DataFrame | None = None
    copies: DataFrame | None = None
    _resolve: bool = False

    def _valid(self, hashed: bool, where: Column | None = None) -> DataFrame:
        rows = self.source.where("id is not null")
        rows = rows.where(where) if where is not None else rows
        schema = "id bigint, vec binary" + ", h binary" * hashed
        return rows.select("id", "values").mapInArrow(_normalised(self.dimension, hashed), schema)

    @staticmethod
    def of(table: DataFrame, dimension: int = 64, keep: int = 16, id_column: str = "id", values_column: str = "values") -> Collection:
        """Take stock of a table: one pass over it, whose result is 24 bytes a vector."""
        self = Collection(table.select(F.col(id_column).cast("bigint").alias("id"), F.col(values_column).alias("values")), dimension, keep=keep)
        members = materialise(self._valid(True).select("id", "h").distinct(), "members")
        total = members.groupBy("id").agg(F.count("*").alias("c"), F.min("h").alias("h"))
        self.n, several = (x or 0 for x in total.agg(F.count("*"), F.count_if(F.col("c") > 1)).first())
        self._resolve = several > 0
        self.members = total.select("id", "h") if self._resolve else members
        limit = max(HOT_COPIES, self.n // MAX_HOT)
        self.hot = sorted(bytes(r.h) for r in self.members.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > limit).select("h").collect())
        if self.hot:
            self.copies = self._hot_members().join(F.broadcast(self._smallest()), ["id", "h"], "left_anti")
        return self

    def _hot_keys(self) -> DataFrame:
        return self.members.sparkSession.createDataFrame([(bytearray(h),) for h in self.hot], "h binary")

    def _hot_members(self) -> DataFrame:
        return self.members.join(F.broadcast(self._hot_keys()), "h").select("id", "h")

    def _smallest(self) -> DataFrame:
        """(id, h) of the ``keep`` smallest ids of every hot vector: at most keep * MAX_HOT rows.

        Ranked within each task first, so that no task ever sees all copies of a hot vector.
        """
        salted = self._hot_members().withColumn("salt", F.spark_partition_id())
        once = salted.withColumn("r", F.expr("row_number() over (partition by h, salt order by id)")).where(F.col("r") <= self.keep)
        return once.withColumn("r", F.expr("row_number() over (partition by h order by id)")).where(F.col("r") <= self.keep).select("id", "h")

    def vectors(self) -> DataFrame:
        """``id, vec``: repeated ids may still be repeated unchanged, as copies share every cell anyway."""
        if not self._resolve and not self.hot:
            return self._valid(False)
        rows = self._valid(True)
        if self._resolve:
            rows = rows.join(self.members, ["id", "h"], "left_semi")
        if self.hot:
            rows = rows.join(F.broadcast(self._hot_keys().withColumn("often", F.lit(True))), "h", "left").join(F.broadcast(self._smallest().withColumn("kept", F.lit(True))), ["id", "h"], "left").where("often is null or kept")
        return rows.select("id", "vec")

    def sample(self, rows: int = SAMPLE_ROWS, seed: int = 1) -> np.ndarray:
        """About ``rows`` vectors at most, chosen by a hash of the id; the same for every run and partitioning."""
        table = self._valid(False, hashed_below(rows / max(1, self.n), seed)).toArrow()
        if not table.num_rows:
            return np.empty((0, self.dimension), np.float32)
        order = np.argsort(table["id"].to_numpy(), kind="stable")[: rows + rows // 8]
        return unpack(table["vec"], self.dimension)[order]


def _means(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = points[np.sort(rng.choice(len(points), min(k, len(points)), replace=False))].copy()
    for _ in range(rounds):
        home = nearest(points, centres, 1)[0][:, 0]
        order = np.argsort(home, kind="stable")
        used, starts = np.unique(home[order], return_index=True)
        centres[used] = (np.add.reduceat(points[order], starts, axis=0) / np.diff(np.append(starts, len(points)))[:, None]).astype(np.float32)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray, k: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Indices and squared distances of the k nearest centres, nearest first, ties by index."""
    k = min(k, len(centres))
    half = 0.5 * np.einsum("ij,ij->i", centres, centres)
    where, far = np.empty((len(points), k), np.int64), np.empty((len(points), k), np.float32)
    for i in range(0, len(points), block):
        part = points[i : i + block]
        score = half - part @ centres.T
        if k == 1:
            best = np.argmin(score, axis=1)[:, None]
        else:
            best = np.sort(np.argpartition(score, k - 1, axis=1)[:, :k], axis=1)
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)
        where[i : i + block] = best
        far[i : i + block] = np.maximum(2 * np.take_along_axis(score, best, 1) + np.einsum("ij,ij->i", part, part)[:, None], 0)
    return where, far


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """Balanced centroids: k-means in two levels, then every cell with over twice its share is split in two.

    Two levels make the cost grow as n * sqrt(count). Splitting follows the sample's density, so a dense
    region gets as many cells as its share of the rows asks for.
    """
    rng = np.random.default_rng(seed)
    count = max(1, min(count, MAX_CENTROIDS, max(1, len(sample) // 4)))
    if count == 1 or len(sample) < 8:
        return sample.mean(axis=0, keepdims=True) if len(sample) else np.zeros((1, sample.shape[1]), np.float32)
    top = _means(sample, max(1, round(count**0.5)), rounds, rng)
    home = nearest(sample, top, 1)[0][:, 0]
    found = [_means(own, max(1, round(count * len(own) / len(sample))), rounds, rng) for j in range(len(top)) if len(own := sample[home == j])]
    centres = np.concatenate(found)
    share = 2 * len(sample) / count
    for _ in range(4):
        home = nearest(sample, centres, 1)[0][:, 0]
        size = np.bincount(home, minlength=len(centres))
        big = np.flatnonzero(size > share)
        if not len(big) or len(centres) >= MAX_CENTROIDS:
            break
        big = big[np.argsort(-size[big], kind="stable")][: MAX_CENTROIDS - len(centres)]
        parts = [_means(sample[home == j], 2, rounds, rng) for j in big]
        centres = np.concatenate([np.delete(centres, big, axis=0), *parts])
    return np.ascontiguousarray(_distinct(centres), dtype=np.float32)


def _distinct(centres: np.ndarray, least: float = 1e-3, block: int = 1024) -> np.ndarray:
    """Centroids without those that practically repeat an earlier one: who is near a dense place must find it as one cell."""
    half = 0.5 * np.einsum("ij,ij->i", centres, centres)
    kept = np.ones(len(centres), bool)
    for i in range(0, len(centres), block):
        part = centres[i : i + block]
        squared = 2 * (half[i : i + block, None] + half[None, :] - part @ centres.T)
        earlier = np.arange(len(centres))[None, :] < np.arange(i, i + len(part))[:, None]
        kept[i : i + block] = ~((squared < least * least) & earlier).any(axis=1)
    return centres[kept]


class CentroidGraph:
    """Layered proximity graph over the centroids, searched for whole batches of points at once.

    The upper layer has about sqrt(C) hubs. An edge leads from each of a centroid's ``links`` nearest hubs
    to the centroid, and between each centroid and its ``degree`` nearest centroids. A search scores the
    hubs, follows the edges of the ``width`` best, and then once more the edges of the best centroid found.
    """

    def __init__(self, centres: np.ndarray, links: int = 3, degree: int = 12, seed: int = 3):
        self.centres = centres
        count = len(centres)
        self.hubs = _means(centres, max(1, round(count**0.5)), 5, np.random.default_rng(seed))
        near = nearest(centres, self.hubs, links)[0]
        self.below = [np.flatnonzero((near == h).any(axis=1)) for h in range(len(self.hubs))]
        near = nearest(centres, centres, degree + 1)[0]
        self.beside = near if count > 1 else np.zeros((1, 1), np.int64)

    def search(self, points: np.ndarray, k: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Indices and distances of about the k nearest centroids; an unused place is -1 at infinity."""
        n, width = len(points), min(width, len(self.hubs))
        keep = max(k, 2)
        ids = np.full((n, keep), -1, np.int64)
        far = np.full((n, keep), np.inf, np.float32)
        half = 0.5 * np.einsum("ij,ij->i", self.centres, self.centres)
        entry = nearest(points, self.hubs, width)[0]
        for w in range(width):
            order = np.argsort(entry[:, w], kind="stable")
            bounds = np.searchsorted(entry[order, w], np.arange(len(self.hubs) + 1))
            for h in range(len(self.hubs)):
                rows, below = order[bounds[h] : bounds[h + 1]], self.below[h]
                if len(rows) and len(below):
                    score = half[below] - points[rows] @ self.centres[below].T
                    take = min(keep, len(below))
                    best = np.argpartition(score, take - 1, axis=1)[:, :take] if take < len(below) else np.broadcast_to(np.arange(len(below)), score.shape)
                    ids[rows], far[rows] = _merge(ids[rows], far[rows], below[best], np.take_along_axis(score, best, 1), keep)
        beside = self.beside[np.maximum(ids[:, 0], 0)]
        for i in range(0, n, 1024):
            part = beside[i : i + 1024]
            score = half[part] - np.einsum("nd,nkd->nk", points[i : i + 1024], self.centres[part])
            ids[i : i + 1024], far[i : i + 1024] = _merge(ids[i : i + 1024], far[i : i + 1024], part, score, keep)
        squares = np.einsum("ij,ij->i", points, points)[:, None]
        return ids[:, :k], np.sqrt(np.maximum(2 * far[:, :k] + squares, 0))


def _merge(ids: np.ndarray, far: np.ndarray, more: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` nearest of two candidate lists per row, each centroid once, nearest first."""
    ids, far = np.concatenate([ids, more], axis=1), np.concatenate([far, score], axis=1)
    by_id = np.argsort(ids, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, by_id, 1), np.take_along_axis(far, by_id, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    far = np.where(again, np.inf, far)
    order = np.argsort(far, axis=1, kind="stable")[:, :keep]
    return np.where(np.isinf(x := np.take_along_axis(far, order, 1)), -1, np.take_along_axis(ids, order, 1)), x


@dataclass(frozen=True)
class Layout:
    """How vectors are dealt into cells. ``store`` and ``seek`` are (cells at most, slack of the distance) of data and of queries."""

    dimension: int
    store: tuple[int, float]
    seek: tuple[int, float] = (0, 0.0)
    #: Rows a cell should hold before replication, and rows that a task may hold.
    cell_rows: int = 600
    task_rows: int = 16_384
    #: Blocks of ``task_rows`` that queries of a cell may visit before the cell is divided instead.
    visits: int = 1
    #: Axes of the space that distances are measured in, one a column; None for the vectors themselves.
    axes: np.ndarray | None = None
    half: bool = False
    #: Distance within which a centre always counts as near, so that vectors beside a very dense cell meet it.
    floor: float = 0.0
    #: Cosine to the centre from which a vector belongs to the mass of a cell that cannot be divided; None if queries visit all its blocks.
    mass: float | None = None

    @property
    def dtype(self) -> type:
        return np.float16 if self.half else np.float32

    @property
    def reach(self) -> int:
        return max(self.store[0], self.seek[0])

    def blocks(self, expected: np.ndarray, alike: np.ndarray | bool = False) -> np.ndarray:
        """How many blocks cells of so many rows are cut into, or _OPEN if they are divided."""
        many = np.maximum(1, np.ceil(expected / self.task_rows))
        return np.where((many <= self.visits) | alike, many, _OPEN).astype(np.int32)

    def copies(self, cells: int) -> int:
        """Of every vector so many are stored, at most."""
        return min(self.store[0], cells)

    def points(self, vectors: np.ndarray) -> np.ndarray:
        return vectors if self.axes is None else vectors @ self.axes


def _at_most(counts: np.ndarray, sample: int, rows: int) -> np.ndarray:
    """Rows of cells by their counts in a sample, three standard deviations on the safe side."""
    return (counts + 3 + 3 * np.sqrt(counts)) * (rows / max(1, sample)) if sample < rows else counts


def _emitted(layout: Layout, near: np.ndarray, far: np.ndarray, role: np.ndarray, ids: np.ndarray, vectors: np.ndarray, numbers: np.ndarray, blocks: np.ndarray, centres: np.ndarray | None = None):
    """A row for every cell a vector is sent to; ``blocks`` is _OPEN for cells that are divided further, else their number of blocks."""
    place = np.arange(near.shape[1])[None, :]
    chosen = [(near >= 0) & (place < most) & (far <= np.maximum(far[:, :1] * (1 + slack), layout.floor)) & ((role & bit) > 0)[:, None] for (most, slack), bit in ((layout.store, DATA), (layout.seek, QUERY))]
    row, col = np.nonzero(chosen[0] | chosen[1])
    cell, bits = near[row, col], chosen[0][row, col] * DATA + chosen[1][row, col] * QUERY
    many = blocks[cell]
    own = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(many, 1)
    divided = many > 1
    if layout.mass is None:
        visits = divided & ((bits & QUERY) > 0)
    else:
        inner = np.zeros(len(row), bool)
        if divided.any():
            inner[divided] = np.einsum("ij,ij->i", vectors[row[divided]], centres[cell[divided]]) >= layout.mass
        bits, visits = bits + inner * MASS, divided & ~inner
    # visitors go to every block, all others to one
    times = np.where(visits, many, 1)
    pick = np.repeat(np.arange(len(row)), times)
    block = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
    block = np.where(visits[pick], block, own[pick])
    bits = bits[pick]
    if layout.mass is None:
        bits = np.where(block == own[pick], bits, bits & ~DATA)
    block = np.where(many[pick] < 0, _OPEN, block)
    short = vectors.astype(layout.dtype)
    for i in range(0, len(pick), 8192):
        part = slice(i, i + 8192)
        at = row[pick[part]]
        yield pa.RecordBatch.from_arrays([pa.array(numbers[cell[pick[part]]]), pa.array(block[part].astype(np.int32)), pa.array(ids[at]), pa.array(bits[part].astype(np.int8)), pack(short[at])], names=["cell", "block", "id", "role", "vec"])


def _first_cells(shared, layout: Layout, blocks: np.ndarray):
    numbers = np.arange(len(blocks))

    def run(batches):
        for batch in batches:
            vectors = unpack(batch.column(1), layout.dimension)
            if len(vectors):
                role = DATA + QUERY * batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                near, far = shared.value.search(layout.points(vectors), layout.reach)
                yield from _emitted(layout, near, far, role, batch.column(0).to_numpy(), vectors, numbers, blocks)

    return run


_PLAN = "cell bigint, centres binary, whole binary, blocks array<int>"


def _fit_cell(layout: Layout):
    """Centroids of one open cell from a sample of its rows, and what becomes of each of their cells."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        vectors = unpack(table["vec"], layout.dimension, layout.dtype)[np.argsort(table["id"].to_numpy(), kind="stable")].astype(np.float32)
        rows = table["n"][0].as_py()
        points = layout.points(vectors)
        count = 1 if rows <= layout.task_rows else max(round(rows / layout.cell_rows), -(-4 * layout.store[0] * rows // layout.task_rows))
        centres = fit_centroids(points, count)
        home = nearest(points, centres, 1)[0][:, 0]
        size = np.bincount(home, minlength=len(centres))
        whole = np.zeros((len(centres), layout.dimension), np.float32)
        np.add.at(whole, home, vectors)
        whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-30)
        expected = _at_most(size, len(points), rows) * layout.copies(len(centres))
        # most rows in one cell again: they are too close together to be told apart
        blocks = layout.blocks(expected, size * 2 > len(points))
        return pa.table({"cell": [key[0].as_py()], "centres": pa.array([np.ascontiguousarray(centres, np.float32).tobytes()], pa.binary()), "whole": pa.array([whole.tobytes()], pa.binary()), "blocks": pa.array([blocks.tolist()], pa.list_(pa.int32()))})

    return run


def _next_cells(layout: Layout):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], pa.schema([("cell", pa.int64()), ("block", pa.int32()), ("id", pa.int64()), ("role", pa.int8()), ("vec", pa.binary())]))
        vectors = unpack(left["vec"], layout.dimension, layout.dtype).astype(np.float32)
        blocks = np.array(right["blocks"][0].as_py())
        centres, whole = (np.frombuffer(right[c][0].as_py(), np.float32).reshape(len(blocks), -1) for c in ("centres", "whole"))
        near, far = nearest(layout.points(vectors), centres, layout.reach)
        numbers = mixed(np.uint64(right["cell"][0].as_py() & (1 << 64) - 1) + np.arange(1, len(blocks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        return pa.Table.from_batches(list(_emitted(layout, near, np.sqrt(far), left["role"].to_numpy().astype(np.int64), left["id"].to_numpy(), vectors, numbers, blocks, whole)))

    return run


def spread(rows: DataFrame, graph: CentroidGraph, sample: np.ndarray, n: int, layout: Layout) -> DataFrame:
    """``(cell, block, id, role, vec)``: every row of ``rows`` (``id, vec, asks``) in the cells it is stored and sought in.

    ``graph`` and ``sample`` are the first centroids and what they were fitted on, ``n`` the rows of the whole
    collection. A cell that may hold more rows than a task should is divided by centroids of its own, again and again,
    with the same slack at every border. What cannot be divided, as most of it is in one place, is cut into blocks:
    data are dealt to them, and whoever may be near all of it visits every block.
    """
    spark = rows.sparkSession
    points = layout.points(sample)
    size = np.bincount(graph.search(points, 1)[0][:, 0], minlength=len(graph.centres))
    blocks = layout.blocks(_at_most(size, len(points), n) * layout.copies(len(size)))
    shared = spark.sparkContext.broadcast(graph)
    routed = rows.select("id", "vec", "asks").mapInArrow(_first_cells(shared, layout, blocks), ROUTED)
    if (blocks != _OPEN).all():
        return routed
    done = None
    while True:
        routed = materialise(routed, "routed")
        settled = routed.where(F.col("block") != _OPEN)
        done = settled if done is None else done.unionByName(settled)
        left = routed.where(F.col("block") == _OPEN)
        sizes = materialise(left.groupBy("cell").agg(F.count("*").alias("n")), "sizes")
        if not (stored_rows(sizes) if stored_rows(sizes) is not None else sizes.count()):
            return done
        # open cells are large, so a share of their rows is enough to choose from
        some = left.where(hashed_below(4 * CELL_SAMPLE / layout.task_rows, 2)).select("cell", "id", "vec")
        some = some.withColumn("r", F.expr("row_number() over (partition by cell order by xxhash64(id, 2), id)")).where(F.col("r") <= CELL_SAMPLE).drop("r")
        plan = materialise(some.join(sizes, "cell").groupBy("cell").applyInArrow(_fit_cell(layout), _PLAN), "plan")
        parts = sizes.select("cell", F.ceil(F.col("n") / ROUTE_ROWS).alias("parts"))
        dealt = split_join(left.drop("block"), parts, ["cell"], ROUTE_ROWS * 16, total=stored_rows(routed)).select("cell", "id", "role", "vec", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).alias("part"))
        of_plan = sizes.select(F.col("cell").alias("c"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / ROUTE_ROWS) - 1)).alias("p"))
        plans = plan.join(of_plan, F.col("cell") == F.col("c")).select(F.col("c").alias("cell"), F.col("p").alias("part"), "centres", "whole", "blocks")
        routed = dealt.groupBy("cell", "part").cogroup(plans.groupBy("cell", "part")).applyInArrow(_next_cells(layout), ROUTED)
