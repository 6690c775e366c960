"""Quality and speed of searches: recall, score errors, percentiles, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vector
from vecloom.session import materialise


def recall(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(query_id, expected, found, recall)``: the share of each query's expected ids among the actual ones.

    Order does not matter and repeated rows count once. Queries without expected rows are not in the result.
    """
    truth = expected.select("query_id", "vector_id").distinct()
    hit = actual.select("query_id", "vector_id").distinct().withColumn("hit", F.lit(1))
    joined = truth.join(hit, ["query_id", "vector_id"], "left").groupBy("query_id").agg(F.count("*").alias("expected"), F.count("hit").alias("found"))
    return joined.withColumn("recall", F.col("found") / F.col("expected"))


def recall_summary(per_query: DataFrame) -> DataFrame:
    """``(queries, mean_recall, min_recall)``; without queries the recalls are null."""
    return per_query.agg(F.count("*").alias("queries"), F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"))


def short_queries(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(queries, short)``: how many queries have fewer actual rows than expected ones."""
    a = expected.groupBy("query_id").agg(F.count("*").alias("e"))
    b = actual.groupBy("query_id").agg(F.count("*").alias("n"))
    return a.join(b, "query_id", "left").agg(F.count("*").alias("queries"), F.count_if(F.coalesce("n", F.lit(0)) < F.col("e")).alias("short"))


def ranked_match(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(query_id, same)``: whether both name the same id at every rank."""
    a = expected.select("query_id", "rank", F.col("vector_id").alias("e"))
    b = actual.select("query_id", "rank", F.col("vector_id").alias("a"))
    return a.join(b, ["query_id", "rank"], "full").groupBy("query_id").agg(F.bool_and(F.col("e").eqNullSafe(F.col("a"))).alias("same"))


def score_errors(results: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(query_id, rank, vector_id, error DOUBLE)``: how far each score is from the one computed anew.

    The error is null for an id without a vector.
    """
    q = queries.select("query_id", vector.normalize_l2("query").alias("q"))
    v = vectors.select("vector_id", vector.normalize_l2("values").alias("v")).dropDuplicates(["vector_id"])
    joined = results.select("query_id", "rank", "vector_id", "score").join(q, "query_id").join(v, "vector_id", "left")
    return joined.select("query_id", "rank", "vector_id", F.abs(F.col("score").cast("double") - vector.dot_product("q", "v").cast("double")).alias("error"))


def incomplete_results(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, problem)``: unexpected queries, ranks outside 0..k-1, repeated and missing ranks."""
    ranks = results.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.count_if((F.col("rank") < 0) | (F.col("rank") >= k)).alias("outside"))
    joined = queries.select("query_id", F.lit(True).alias("known")).distinct().join(ranks, "query_id", "full")
    problem = F.when(F.col("known").isNull(), "unexpected query").when(F.col("outside") > 0, "rank").when(F.col("n") > F.col("d"), "repeated rank").when(F.coalesce("d", F.lit(0)) < k, "missing rank")
    return joined.select("query_id", problem.alias("problem")).where("problem is not null")


def score_error_summary(errors: DataFrame) -> DataFrame:
    """``(results, max_error, missing)`` of :func:`score_errors`: the largest error, and how many ids have no vector."""
    return errors.agg(F.count("*").alias("results"), F.max("error").alias("max_error"), F.count_if(F.col("error").isNull()).alias("missing"))


def nearest_rank(share: float) -> tuple[str, float]:
    """The percentile that is the ceil(share * n)-th smallest value, at least the first."""
    return "nearest", share


def linear(share: float) -> tuple[str, float]:
    """The percentile at position (n - 1) * share, interpolated between its neighbours."""
    return "linear", share


#: Parts an interval of values is cut into, and rows of the chosen parts that one task may rank.
BINS, FEW = 1_024, 100_000


def percentiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]], few: int = FEW) -> DataFrame:
    """One row per group of ``by`` with a DOUBLE column per name of ``wanted``; exact, whatever a group's size.

    Every percentile is one or two order statistics. Each is closed in on by counting: the interval it lies in
    is cut into BINS parts, whose counts are added up within tasks before they are shuffled, and the part that
    holds the wanted rank is cut again until it holds one value or at most ``few`` rows, which are then ranked.
    So no task ever holds or sorts a group. Null and NaN values are ignored; null keys are a group; groups without
    values give no row. ``by`` may be empty.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    source = rows.select(F.hash(*by).alias("_h") if by else F.lit(0).alias("_h"), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    group = ["_h", *keys]
    same = lambda a, b: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in group))
    sizes = source.groupBy(*group).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    ranks = [F.struct(F.lit(name).alias("name"), F.lit(i).alias("part"), rank.cast("bigint").alias("rank")) for name, (kind, share) in wanted.items() for i, rank in enumerate(_ranks(kind, share))]
    # rank counts from 0 within the interval [low, high]
    target = materialise(sizes.select("*", F.explode(F.array(*ranks)).alias("t")).select(*group, "t.name", "t.part", "t.rank", "low", "high", F.col("n").alias("total"), F.col("n").alias("rows")), "targets")
    found = []
    while True:
        done = target.where("low = high").select(*group, "name", "part", "total", F.col("low").alias("x"))
        small = target.where((F.col("low") < F.col("high")) & (F.col("rows") <= few))
        ranges = small.select(*group, "low", "high").distinct()
        near = source.alias("s").join(ranges.alias("t"), same("s", "t") & F.expr("s.x between t.low and t.high")).select(*[f"t.{c}" for c in group], "t.low", "t.high", "s.x")
        ordered = near.groupBy(*group, "low", "high").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        few_rows = small.alias("a").join(ordered.alias("b"), same("a", "b") & F.expr("a.low = b.low and a.high = b.high")).select(*[f"a.{c}" for c in group], "name", "part", "total", F.expr("xs[cast(rank as int)]").alias("x"))
        found += [done, few_rows]
        left = target.where((F.col("low") < F.col("high")) & (F.col("rows") > few))
        if left.isEmpty():
            break
        ranges = left.select(*group, "low", "high").distinct()
        # halves keep high - low finite; equal parts of the interval, the last one closed
        place = F.least(F.lit(BINS - 1), F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS)).cast("int")
        near = source.alias("s").join(ranges.alias("t"), same("s", "t") & F.expr("s.x between t.low and t.high")).select(*[f"t.{c}" for c in group], "t.low", "t.high", "s.x")
        bins = near.withColumn("bin", place).groupBy(*group, "low", "high", "bin").agg(F.count("*").alias("rows"), F.min("x").alias("first"), F.max("x").alias("last"))
        bins = bins.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy(*group, "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        target = left.drop("rows").alias("a").join(bins.alias("b"), same("a", "b") & F.expr("a.low = b.low and a.high = b.high and rank >= before and rank < before + b.rows"))
        target = materialise(target.select(*[f"a.{c}" for c in group], "name", "part", (F.col("rank") - F.col("before")).alias("rank"), F.col("first").alias("low"), F.col("last").alias("high"), "total", F.col("b.rows").alias("rows")), "targets")
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)

    def of(name: str, kind: str, share: float) -> Column:
        at = lambda part: F.max(F.when((F.col("name") == name) & (F.col("part") == part), F.col("x")))
        if kind == "nearest":
            return at(0).alias(name)
        position = (F.max("total") - 1) * F.lit(share)
        return (at(0) + (at(1) - at(0)) * (position - F.floor(position))).alias(name)

    return every.groupBy(*group).agg(*[of(name, *w) for name, w in wanted.items()]).select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *wanted)


def _ranks(kind: str, share: float) -> list[Column]:
    """The order statistics of ``n`` values, from 0, that a percentile is made of."""
    n = F.col("n")
    if kind == "nearest":
        return [F.greatest(F.lit(1), F.ceil(n * F.lit(share))) - 1]
    return [F.floor((n - 1) * F.lit(share)), F.ceil((n - 1) * F.lit(share))]


def latency_summary(log: DataFrame, by: list[str], latency: str = "latency_us") -> DataFrame:
    """Requests, mean, nearest-rank and linear percentiles and requests a second of busy time, per group.

    Rows with a null latency are left out. Counts are pre-aggregated and percentiles found by
    :func:`percentiles`, so a group with any share of the rows is never in one task.
    """
    c = F.col(latency)
    log = log.where(c.isNotNull())
    plain = log.groupBy(*by).agg(F.count(c).alias("requests"), F.avg(c).alias("mean_us"), F.try_divide(F.count(c) * F.lit(1e6), F.sum(c)).alias("qps"))
    wanted = {f"p{round(p * 100)}_us": nearest_rank(p) for p in (0.5, 0.95, 0.99)} | {f"linear_p{round(p * 100)}_us": linear(p) for p in (0.5, 0.95, 0.99)}
    ranks = percentiles(log, by, latency, wanted)
    same = [plain[b].eqNullSafe(ranks[b]) for b in by]
    joined = plain.join(ranks, same) if by else plain.crossJoin(ranks)  # without groups both are one row
    return joined.select(*[plain[b] for b in by], "requests", "mean_us", *wanted, "qps")
