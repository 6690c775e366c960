"""Queries of the core operators, and the SQL that equals them on the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import text, vector
from vecloom.functions.checksums import request_digest
from vecloom.operators import dedup, evaluation, hnsw, knn, lookup, service_log
from vecloom.session import delete_path, materialise, read_table, scratch_path, shared_dir
from vecloom.limits import ResourceLimits
from vecloom.plans import graphs
from vecloom.plans.store import VectorStore
from vecloom.sources import csv, jsonl, manifest
from vecloom.streaming import durable

SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that equals it if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("""
SELECT delivery_id FROM (
  SELECT delivery_id, row_number() OVER (PARTITION BY client_operation_id, coalesce(dedup_epoch, 0)
                                         ORDER BY received_at NULLS LAST, delivery_id) AS n
  FROM add_vector_requests WHERE client_operation_id <> '') WHERE n > 1""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of an insert operation after its first."""
    return dedup.surplus_deliveries(read_table(spark, sf_dir, "add_vector_requests"), dedup.operation_key(), ["received_at"], "delivery_id")


@query("""
SELECT delivery_id, client_name, client_operation_id, dedup_epoch, id FROM (
  SELECT *, row_number() OVER (PARTITION BY client_operation_id, coalesce(dedup_epoch, 0)
                               ORDER BY received_at NULLS LAST, delivery_id) AS n
  FROM add_vector_requests) WHERE n = 1 OR client_operation_id IS NULL OR client_operation_id = ''""")
def p2_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery but the surplus ones."""
    rows = read_table(spark, sf_dir, "add_vector_requests").select("delivery_id", "client_name", "client_operation_id", "dedup_epoch", "id", "received_at")
    return dedup.exactly_once(rows, dedup.operation_key(), ["received_at"], "delivery_id").drop("received_at")


@query("""
WITH kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_operation_id, coalesce(dedup_epoch, 0)
                                              ORDER BY received_at NULLS LAST, delivery_id) AS n
                 FROM add_vector_requests WHERE received_at >= TIMESTAMP '2025-04-01' AND client_operation_id <> '') WHERE n = 1)
SELECT delivery_id FROM kept WHERE NOT EXISTS (
  SELECT 1 FROM add_vector_requests s WHERE s.received_at < TIMESTAMP '2025-04-01'
    AND s.client_operation_id = kept.client_operation_id AND coalesce(s.dedup_epoch, 0) = coalesce(kept.dedup_epoch, 0))""")
def p2_new_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First deliveries of a later period whose operation was not stored in the earlier one."""
    operation, epoch = dedup.operation_key()
    rows = read_table(spark, sf_dir, "add_vector_requests").select("delivery_id", "received_at", operation.alias("operation"), epoch.alias("epoch")).dropna(subset=["operation"])
    cut = F.lit("2025-04-01").cast("timestamp")
    return dedup.new_messages(rows.where(F.col("received_at") >= cut), rows.where(F.col("received_at") < cut), ["operation", "epoch"], ["received_at"], "delivery_id").select("delivery_id")


# --- vectors -----------------------------------------------------------------------------------------------

_UNIT = "[(x::DOUBLE * (1.0 / sqrt(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[]))))::FLOAT for x in {0}]"
#: Usable rows of the table vectors, each id once.
_VALID = f"""valid AS (
  SELECT id, {_UNIT.format('values')} AS v FROM (SELECT DISTINCT id, "values" AS values FROM vectors)
  WHERE len(values) = 64 AND len(list_filter(values, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(values, lambda x: x <> 0)) > 0)"""
_SCORE = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])::FLOAT"


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("values"), "label")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "vectors").select(F.col("id").alias("vector_id"), "values")


def _asking(vectors: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 100 as a query."""
    return vectors.where(F.col("vector_id") % 100 == 0).select(F.col("vector_id").alias("query_id"), F.col("values").alias("query"))


def _rounded(results: DataFrame) -> DataFrame:
    return results.withColumn("score", F.round(F.col("score").cast("double"), 5))


def _knn_sql(where: str = "TRUE", k: int = 10, more: str = "") -> str:
    return f"""
WITH unit AS (SELECT vec_id, label, {_UNIT.format('embedding')} AS v FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, e.vec_id AS vector_id, e.label, {_SCORE.format('q.v', 'e.v')} AS s
           FROM unit q JOIN unit e ON q.vec_id % 100 = 0 AND {where}),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vector_id) - 1)::INT AS rank,
                  vector_id, label, s FROM scored QUALIFY rank < {k})
{more or "SELECT query_id, rank, vector_id, round(s::DOUBLE, 5) AS score FROM ranked"}"""


@query(_knn_sql())
def knn_exact_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest embeddings of every hundredth one."""
    e = _embeddings(spark, sf_dir)
    return _rounded(knn.knn(_asking(e), e, 10, 64))


@query(_knn_sql("q.vec_id <> e.vec_id", 5))
def knn_exclude_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest other embeddings."""
    e = _embeddings(spark, sf_dir)
    return _rounded(knn.knn(_asking(e), e, 5, 64, exclude_self=True))


@query(_knn_sql("e.label = 3"))
def knn_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest embeddings among those of one label; the filter reaches the scan."""
    e = _embeddings(spark, sf_dir)
    return _rounded(knn.knn(_asking(e), e.where("label = 3"), 10, 64))


@query(_knn_sql("e.vec_id % 4 = 0"))
def erase_survivors_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest embeddings after three quarters of them were deleted."""
    e = _embeddings(spark, sf_dir)
    return _rounded(knn.knn(_asking(e), lookup.survivors(e, e.where("vector_id % 4 <> 0")), 10, 64))


@query(_knn_sql(k=1_000_000))
def knn_k_exceeds_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More neighbours than there are: all of them."""
    e = _embeddings(spark, sf_dir)
    return _rounded(knn.knn(_asking(e), e, 1_000_000, 64))


@query("SELECT vec_id AS query_id, 0::INT AS rank, vec_id AS vector_id, 0.0::DOUBLE AS score FROM embeddings WHERE FALSE")
def knn_k0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No neighbours: an empty result."""
    e = _embeddings(spark, sf_dir)
    return _rounded(knn.knn(_asking(e), e, 0, 64))


@query(
    _knn_sql(
        more=""", v AS (SELECT query_id, label, count(*) AS votes FROM ranked GROUP BY query_id, label)
SELECT query_id, label, votes FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) = 1"""
    )
)
def knn_vote_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent label among ten nearest embeddings."""
    e = _embeddings(spark, sf_dir)
    return knn.vote(knn.knn(_asking(e), e, 10, 64), e)


_REQUESTS = f"""
WITH {_VALID},
asked AS (SELECT query_id, k, expected_snapshot_id, {_UNIT.format('query')} AS q FROM search_requests
          WHERE k > 0 AND len(query) = 64 AND len(list_filter(query, lambda x: x IS NOT NULL AND isfinite(x))) = 64
            AND len(list_filter(query, lambda x: x <> 0)) > 0),
scored AS (SELECT query_id, k, id AS vector_id, {_SCORE.format('q', 'v')} AS s FROM asked JOIN valid ON TRUE),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vector_id) - 1)::INT AS rank,
                  vector_id, s, k FROM scored QUALIFY rank < k)
"""


@query(_REQUESTS + "SELECT query_id, rank, vector_id, round(s::DOUBLE, 5) AS score FROM ranked")
def search_requests_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every logged search against all valid vectors, each with its own k."""
    return _rounded(knn.knn(read_table(spark, sf_dir, "search_requests"), _vectors(spark, sf_dir), "k", 64))


@query(
    _REQUESTS
    + """, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY document_id NULLS FIRST, chunk_id NULLS FIRST, text NULLS FIRST, source NULLS FIRST) AS n FROM chunks) WHERE n = 1)
SELECT query_id, rank, r.vector_id, round(s::DOUBLE, 5) AS score, document_id, chunk_id, text, source
FROM ranked r LEFT JOIN one USING (vector_id)"""
)
def semantic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the results of every logged search, each with its own k."""
    found = knn.knn(read_table(spark, sf_dir, "search_requests"), _vectors(spark, sf_dir), "k", 64)
    return _rounded(lookup.with_chunks(found, read_table(spark, sf_dir, "chunks"), strict=False))


@query("""
SELECT coalesce(v.vector_id, c.vector_id) AS vector_id, CASE WHEN c.vector_id IS NULL THEN 'left' ELSE 'right' END AS side
FROM (SELECT DISTINCT id AS vector_id FROM vectors) v FULL JOIN (SELECT DISTINCT vector_id FROM chunks) c ON v.vector_id = c.vector_id
WHERE (v.vector_id IS NULL) <> (c.vector_id IS NULL)""")
def id_set_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without a chunk and chunks without a vector."""
    return lookup.id_mismatch(_vectors(spark, sf_dir), read_table(spark, sf_dir, "chunks"))


@query("""
SELECT id AS vector_id, round(sqrt(list_inner_product("values"::DOUBLE[], "values"::DOUBLE[])), 6) AS norm,
       abs(list_inner_product("values"::DOUBLE[], "values"::DOUBLE[]) - 1) <= 1e-3 AS unit
FROM vectors WHERE len("values") > 0 AND len(list_filter("values", lambda x: x IS NOT NULL AND isfinite(x))) = len("values")""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every stored vector with finite components, and whether it is 1."""
    v = _vectors(spark, sf_dir).where((F.size("values") > 0) & vector.all_finite("values"))
    return v.select("vector_id", F.round(vector.l2_norm("values"), 6).alias("norm"), vector.is_unit("values").alias("unit"))


@query(f"""
SELECT vec_id AS vector_id, generate_subscripts(v, 1)::INT - 1 AS place, round(unnest(v)::DOUBLE, 6) AS component
FROM (SELECT vec_id, {_UNIT.format('embedding')} AS v FROM embeddings)""")
def vector_normalized_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of every embedding at length 1."""
    e = _embeddings(spark, sf_dir).select("vector_id", F.posexplode(vector.normalize_l2("values")).alias("place", "c"))
    return e.select("vector_id", "place", F.round(F.col("c").cast("double"), 6).alias("component"))


@query("""
SELECT error, count(*) AS vectors FROM (
  SELECT CASE WHEN "values" IS NULL OR len("values") <> 64 THEN 'dimension'
              WHEN len(list_filter("values", lambda x: x IS NOT NULL AND isfinite(x))) < 64 THEN 'not finite'
              WHEN len(list_filter("values", lambda x: x <> 0)) = 0 THEN 'zero' END AS error FROM vectors)
GROUP BY error""")
def vector_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break which rule for vectors; null for the usable ones."""
    return _vectors(spark, sf_dir).select(vector.vector_error("values", 64).alias("error")).groupBy("error").agg(F.count("*").alias("vectors"))


@query("SELECT id AS vector_id, count(*) AS copies FROM vectors GROUP BY id HAVING count(*) > 1")
def vector_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that occur more than once."""
    return _vectors(spark, sf_dir).groupBy("vector_id").agg(F.count("*").alias("copies")).where("copies > 1")


@query(f"""
WITH unit AS (SELECT vec_id, label, {_UNIT.format('embedding')} AS v FROM embeddings),
s AS (SELECT q.label AS query_label, e.label, {_SCORE.format('q.v', 'e.v')}::DOUBLE AS s FROM unit q JOIN unit e ON q.vec_id % 100 = 0)
SELECT query_label, label, count(*) AS pairs, round(avg(s), 5) AS mean_score, round(max(s), 5) AS best_score FROM s GROUP BY ALL""")
def label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and best similarity between labels, of every hundredth embedding to all."""
    e = _embeddings(spark, sf_dir)
    asked = e.where("vector_id % 100 = 0").select(F.col("vector_id").alias("query_id"), F.col("values").alias("query"), "label")
    found = knn.label_scores(asked, e, 64)
    return found.select(F.col("query_label").cast("int").alias("query_label"), F.col("label").cast("int").alias("label"), "pairs", F.round(F.col("total") / F.col("pairs"), 5).alias("mean_score"), F.round(F.col("best").cast("double"), 5).alias("best_score"))


# --- evaluation --------------------------------------------------------------------------------------------

@query(
    _knn_sql(
        more="""SELECT query_id, count(*) AS expected, count(*) FILTER (label % 2 = 0) AS found,
       count(*) FILTER (label % 2 = 0) / count(*) AS recall FROM ranked GROUP BY query_id"""
    )
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the ten nearest embeddings that a search among even labels finds."""
    e = _embeddings(spark, sf_dir)
    return evaluation.recall(knn.knn(_asking(e), e, 10, 64), knn.knn(_asking(e), e.where("label % 2 = 0"), 10, 64))


@query(
    _knn_sql(
        more="""SELECT count(*) AS queries, avg(r) AS mean_recall, min(r) AS min_recall
FROM (SELECT query_id, count(*) FILTER (label % 2 = 0) / count(*) AS r FROM ranked GROUP BY query_id)"""
    )
)
def recall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and least recall of the same search."""
    return evaluation.recall_summary(recall_at_k(spark, sf_dir))


@query(_knn_sql(more="SELECT query_id, rank, vector_id, 0.0::DOUBLE AS error FROM ranked"))
def score_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far scores are from those computed anew as expressions: nowhere by 1e-6."""
    e = _embeddings(spark, sf_dir)
    errors = evaluation.score_errors(knn.knn(_asking(e), e, 10, 64), _asking(e), e)
    return errors.withColumn("error", F.round("error", 6))


@query(_knn_sql(more="SELECT DISTINCT query_id, query_id % 200 = 0 AS same FROM ranked"))
def ranked_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a result that was changed for every second query names the same ids in order."""
    e = _embeddings(spark, sf_dir)
    exact = knn.knn(_asking(e), e, 10, 64)
    changed = exact.withColumn("vector_id", F.when((F.col("query_id") % 200 != 0) & (F.col("rank") == 3), -1).otherwise(F.col("vector_id")))
    return evaluation.ranked_match(exact, changed)


_LATENCY = """count({0}) AS requests, round(avg({0}), 4) AS mean_us,
  quantile_disc({0}, 0.5) AS p50_us, quantile_disc({0}, 0.95) AS p95_us, quantile_disc({0}, 0.99) AS p99_us,
  round(quantile_cont({0}, 0.5), 4) AS linear_p50_us, round(quantile_cont({0}, 0.95), 4) AS linear_p95_us, round(quantile_cont({0}, 0.99), 4) AS linear_p99_us,
  round(count({0}) * 1e6 / nullif(sum({0}), 0), 4) AS qps"""


def _latency(log: DataFrame, by: list[str], column: str) -> DataFrame:
    out = evaluation.latency_summary(log, by, column)
    return out.select(*by, "requests", F.round("mean_us", 4).alias("mean_us"), *[F.col(f"p{p}_us").cast("bigint").alias(f"p{p}_us") for p in (50, 95, 99)], *[F.round(f"linear_p{p}_us", 4).alias(f"linear_p{p}_us") for p in (50, 95, 99)], F.round("qps", 4).alias("qps"))


@query(f"SELECT method, index_type, {_LATENCY.format('latency_us')} FROM (SELECT DISTINCT * FROM service_log) WHERE latency_us IS NOT NULL GROUP BY ALL")
def latency_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency percentiles and throughput per method and kind of index, repeated log rows once."""
    log = service_log.distinct_records(read_table(spark, sf_dir, "service_log"))
    return _latency(log.where("latency_us is not null"), ["method", "index_type"], "latency_us")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of event values."""
    return evaluation.percentiles(read_table(spark, sf_dir, "events"), ["event_type"], "value", {f"p{p}": evaluation.nearest_rank(p / 100) for p in (50, 95, 99)})


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles of event values."""
    found = evaluation.percentiles(read_table(spark, sf_dir, "events"), ["event_type"], "value", {f"p{p}": evaluation.linear(p / 100) for p in (50, 95, 99)})
    return found.select("event_type", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (50, 95, 99)])


# --- texts -------------------------------------------------------------------------------------------------

_PLAIN = r"""trim(regexp_replace(coalesce(text, ''), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"""
_WINDOWS = f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS source, string_split({_PLAIN}, ' ') AS words FROM documents WHERE {_PLAIN} <> ''),
s AS (SELECT doc_id, source, words, unnest(range(0, greatest(1, 1 + ceil((len(words) - 120) / 100.0)::BIGINT)))::INT AS chunk_id FROM w),
c AS (SELECT doc_id::VARCHAR AS document_id, chunk_id, array_to_string(words[chunk_id * 100 + 1 : chunk_id * 100 + 120], ' ') AS text, source,
             len(words[chunk_id * 100 + 1 : chunk_id * 100 + 120]) AS n FROM s)
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text", "source")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.word_windows(_documents(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit(""))), 120, 20)


@query(_WINDOWS + "SELECT document_id, chunk_id, text, source FROM c")
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of 120 words of every document."""
    return _chunks(spark, sf_dir).select("document_id", "chunk_id", "text", "source")


@query(_WINDOWS + "SELECT source, count(*) AS chunks, count(DISTINCT document_id) AS documents, sum(n)::BIGINT AS words FROM c GROUP BY source")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, documents and words per source; counted per document first, so that a large source is no large group."""
    per = _chunks(spark, sf_dir).groupBy("source", "document_id").agg(F.count("*").alias("c"), F.sum(F.size(F.split("text", " "))).alias("w"))
    return per.groupBy("source").agg(F.sum("c").alias("chunks"), F.count("*").alias("documents"), F.sum("w").alias("words"))


@query(_WINDOWS + ", p AS (SELECT a.document_id, a.chunk_id, string_split(a.text, ' ')[-20:] = string_split(b.text, ' ')[1:20] AS same FROM c a JOIN c b ON a.document_id = b.document_id AND b.chunk_id = a.chunk_id + 1) SELECT same, count(*) AS joins FROM p GROUP BY same")
def chunk_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each window begins with the last 20 words of the one before."""
    c = _chunks(spark, sf_dir).select("document_id", "chunk_id", F.split("text", " ").alias("w"))
    following = c.select("document_id", (F.col("chunk_id") - 1).alias("chunk_id"), F.slice("w", 1, 20).alias("head"))
    return c.join(following, ["document_id", "chunk_id"]).select((F.slice("w", -20, 20) == F.col("head")).alias("same")).groupBy("same").agg(F.count("*").alias("joins"))


@query()
def chunk_vector_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of every document with their stable ids."""
    return text.chunk_rows(_documents(spark, sf_dir), 120, 20).select("vector_id", "document_id", "chunk_id")


# --- requests, logs, manifests -----------------------------------------------------------------------------

#: A request's own bits as text: unlike numbers, 0.0 and -0.0 differ, and so do not NaNs.
_BITS = "list_transform(\"values\", lambda x: coalesce(x, 'nan'::FLOAT))::VARCHAR"
_STATUS = f"""
WITH s AS (SELECT delivery_id AS seq, coalesce(client_operation_id, '') AS operation_id, coalesce(dedup_epoch, 0) AS epoch, id, received_at, len("values") AS size, {_BITS} AS bits FROM add_vector_requests),
stored AS (SELECT epoch, operation_id, id AS old_id, bits AS old_bits FROM (SELECT *, row_number() OVER (PARTITION BY epoch, operation_id ORDER BY received_at NULLS LAST, seq) AS n
           FROM s WHERE received_at < TIMESTAMP '2025-04-01' AND operation_id <> '') WHERE n = 1),
m AS (SELECT coalesce(max(epoch), 0) AS current FROM stored)
"""


@query(
    _STATUS
    + """SELECT seq, CASE WHEN operation_id = '' OR strlen(operation_id) > 256 OR id IS NULL OR coalesce(size, 0) <> 64 THEN 'INVALID_REQUEST'
  WHEN epoch > current THEN 'FUTURE_EPOCH' WHEN epoch < greatest(0, current - 3) THEN 'EXPIRED_EPOCH'
  WHEN old_id = id AND old_bits IS NOT DISTINCT FROM bits THEN 'REPLAY' WHEN old_id IS NOT NULL THEN 'CONFLICT'
  WHEN epoch < current THEN 'CLOSED_EPOCH' ELSE 'CANDIDATE' END AS outcome
FROM s LEFT JOIN stored USING (epoch, operation_id), m"""
)
def dedup_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every insert request is to a log that stored the operations of before April, with a window of four epochs up to their last."""
    operation, epoch = dedup.operation_key()
    source = read_table(spark, sf_dir, "add_vector_requests")
    rows = source.select(F.col("delivery_id").alias("seq"), operation.alias("operation_id"), epoch.alias("epoch"), F.col("id").alias("vector_id"), request_digest("values").alias("digest"), vector.vector_error("values", 64).alias("error"), "received_at")
    early = rows.where(F.col("received_at") < F.lit("2025-04-01").cast("timestamp"))
    kept = dedup.first_deliveries(early.drop("digest"), [F.col("epoch"), F.col("operation_id")], ["received_at"], "seq")
    stored = early.join(kept, "seq")
    current = early.where("operation_id is not null").agg(F.max("epoch")).first()[0] or 0
    return durable.classify(rows, stored, current, 4)


@query("""
SELECT coalesce(dedup_epoch, 0) AS epoch, count(*) AS operations, sum(80 + 8 + strlen(client_operation_id) + 4 * 64)::BIGINT AS bytes
FROM (SELECT DISTINCT coalesce(dedup_epoch, 0) AS dedup_epoch, client_operation_id FROM add_vector_requests WHERE client_operation_id <> '') GROUP BY 1""")
def epoch_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations and bytes each deduplication epoch uses of its quota."""
    operation, epoch = dedup.operation_key()
    keys = read_table(spark, sf_dir, "add_vector_requests").select(operation.alias("operation_id"), epoch.alias("epoch")).dropna().distinct()
    return service_log.epoch_usage(keys, 64)


@query("""
WITH e AS (SELECT coalesce(dedup_epoch, 0) AS epoch, client_operation_id FROM add_vector_requests WHERE client_operation_id <> '')
SELECT epoch, count(*) AS deliveries FROM e WHERE epoch BETWEEN (SELECT greatest(0, max(epoch) - 2) FROM e) AND (SELECT max(epoch) FROM e) GROUP BY epoch""")
def epoch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries in the window of the last three epochs."""
    operation, epoch = dedup.operation_key()
    rows = read_table(spark, sf_dir, "add_vector_requests").select(operation.alias("operation_id"), epoch.alias("epoch")).dropna()
    current = rows.agg(F.max("epoch")).first()[0] or 0
    return service_log.retained(rows, current, 3).groupBy("epoch").agg(F.count("*").alias("deliveries"))


@query("""
WITH c AS (SELECT log_id AS n, count(*) AS k FROM service_log WHERE log_id IS NOT NULL GROUP BY 1)
SELECT n AS next, CASE WHEN k > 1 THEN 'repeated' ELSE 'gap' END AS problem FROM c
WHERE k > 1 OR (n <> (SELECT min(n) FROM c) AND NOT EXISTS (SELECT 1 FROM c p WHERE p.n = c.n - 1))""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of log records that occur again or do not follow their predecessor."""
    return service_log.log_gaps(read_table(spark, sf_dir, "service_log"), "log_id")


@query(
    f"""
WITH RECURSIVE s AS (SELECT delivery_id, coalesce(client_operation_id, '') AS op, coalesce(dedup_epoch, 0) AS epoch, id, received_at, coalesce(len("values"), 0) AS size, {_BITS} AS bits,
  coalesce(len("values") = 64 AND len(list_filter("values", lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter("values", lambda x: x <> 0)) > 0, FALSE) AS usable FROM add_vector_requests),
m AS (SELECT coalesce(nullif(max(epoch), 0), 1) AS current FROM s),
t AS (SELECT *, CASE WHEN op = '' OR strlen(op) > 256 OR id IS NULL OR size <> 64 THEN 'INVALID_REQUEST' WHEN epoch < greatest(0, current - 63) THEN 'EXPIRED_EPOCH' WHEN epoch < current THEN 'CLOSED_EPOCH' END AS early FROM s, m),
c AS (SELECT row_number() OVER (ORDER BY received_at NULLS LAST, delivery_id) AS n, op, id, bits, usable FROM t WHERE early IS NULL),
r AS (SELECT 0::BIGINT AS n, []::STRUCT(op VARCHAR, id BIGINT, bits VARCHAR)[] AS kept, '' AS outcome
  UNION ALL SELECT n, CASE WHEN outcome = 'NEW' THEN list_append(kept, {{'op': op, 'id': id, 'bits': bits}}) ELSE kept END, outcome FROM (
    SELECT n, kept, op, id, bits, CASE WHEN len(old) > 0 THEN CASE WHEN old[1].id = id AND old[1].bits = bits THEN 'REPLAY' ELSE 'CONFLICT' END
      WHEN len(list_filter(kept, lambda x: x.id = id)) > 0 THEN 'DUPLICATE_VECTOR' WHEN NOT usable THEN 'INVALID_VECTOR' ELSE 'NEW' END AS outcome
    FROM (SELECT c.n, c.op, c.id, c.bits, c.usable, r.kept, list_filter(r.kept, lambda x: x.op = c.op) AS old FROM r JOIN c ON c.n = r.n + 1)))
SELECT outcome, count(*) AS requests FROM (SELECT early AS outcome FROM t WHERE early IS NOT NULL UNION ALL SELECT outcome FROM r WHERE n > 0) GROUP BY outcome"""
)
def durable_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every insert request committed to a new log in order of arrival: outcomes and how many of each."""
    operation, epoch = dedup.operation_key()
    rows = read_table(spark, sf_dir, "add_vector_requests").select(operation.alias("operation_id"), epoch.alias("epoch"), F.col("id").alias("vector_id"), "values", "received_at", "delivery_id")
    current = rows.agg(F.max("epoch")).first()[0] or 1
    path = f"{shared_dir(spark)}/vecloom-log-{uuid.uuid4().hex}"
    log = durable.DurableLog(spark, path, 64, durable.Policy(max(1, current), 64, 1 << 40, 1 << 50), max_batch=20_000)
    outcomes: dict[str, int] = {}
    for i, part in enumerate(durable.arrival_slices(rows, log.max_batch)):
        for o in log.commit_batch(part.select("seq", "operation_id", "epoch", "vector_id", "values"), str(i)):
            outcomes[o.outcome] = outcomes.get(o.outcome, 0) + 1
    delete_path(spark, path)
    return spark.createDataFrame(sorted(outcomes.items()), "outcome string, requests bigint")


@query("""
SELECT status, count(*) AS requests, grouping(status) = 1 AS total FROM (SELECT DISTINCT * FROM service_log) WHERE status IS NOT NULL GROUP BY ROLLUP (status)""")
def rpc_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per status, and in total."""
    return service_log.status_counts(service_log.distinct_records(read_table(spark, sf_dir, "service_log")))


@query("""
SELECT method, count(*) AS requests, count(*) FILTER (status <> 'OK') AS errors, count(*) FILTER (status = 'RESOURCE_EXHAUSTED') AS rejected,
       avg((status = 'RESOURCE_EXHAUSTED')::DOUBLE) AS rejection_rate
FROM (SELECT DISTINCT * FROM service_log) WHERE method IS NOT NULL AND status IS NOT NULL GROUP BY method""")
def rpc_method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and rejections per method."""
    return service_log.method_summary(service_log.distinct_records(read_table(spark, sf_dir, "service_log")))


@query("""
SELECT node, count(*) AS records, max(gap) / 1e6 AS longest_gap_s FROM (
  SELECT node, epoch_us(arrived_at) - epoch_us(lag(arrived_at) OVER (PARTITION BY node ORDER BY arrived_at)) AS gap
  FROM (SELECT DISTINCT * FROM service_log) WHERE arrived_at IS NOT NULL) GROUP BY node""")
def node_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest time without a record of each node."""
    return service_log.inter_arrival(service_log.distinct_records(read_table(spark, sf_dir, "service_log")))


@query("""
SELECT log_id, strftime(logged_at, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_ms(logged_at) % 1000)::VARCHAR, 3, '0') || 'Z' AS timestamp, severity, event,
       nullif(request_id, '') AS request_id, nullif(method, '') AS method, nullif(status, '') AS status, latency_us FROM service_log""")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows in the form the structured logger writes: ISO times, empty fields null."""
    log = read_table(spark, sf_dir, "service_log")
    return log.select("log_id", F.date_format("logged_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "severity", "event", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("request_id", "method", "status")], "latency_us")


@query("""
SELECT snapshot_id, generation, CASE
  WHEN index_type IS NULL OR index_type NOT IN ('flat', 'hnsw') THEN 'index_type'
  WHEN NOT coalesce(CASE index_type WHEN 'flat' THEN format_version = 1 ELSE format_version BETWEEN 1 AND 3 END, FALSE) THEN 'format_version'
  WHEN NOT coalesce(dimension > 0, FALSE) THEN 'dimension' WHEN NOT coalesce(vector_count >= 0, FALSE) THEN 'vector_count'
  WHEN NOT coalesce(file_size BETWEEN 56 AND 1099511627776, FALSE) THEN 'file_size'
  WHEN NOT coalesce(regexp_full_match(sha256, '[0-9a-f]{64}'), FALSE) THEN 'sha256'
  WHEN NOT coalesce(snapshot_id = 'sha256:' || sha256, FALSE) THEN 'snapshot_id'
  WHEN strlen(coalesce(embedding_revision, '')) > 256 THEN 'embedding_revision' END AS error
FROM snapshot_manifests""")
def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule each snapshot manifest breaks."""
    return read_table(spark, sf_dir, "snapshot_manifests").select("snapshot_id", "generation", manifest.manifest_error().alias("error"))


@query("""
SELECT query_id, CASE WHEN coalesce(expected_snapshot_id, '') = '' THEN 'any' WHEN NOT regexp_full_match(expected_snapshot_id, 'sha256:[0-9a-f]{64}') THEN 'malformed'
  WHEN expected_snapshot_id IN (SELECT snapshot_id FROM snapshot_manifests WHERE snapshot_id IS NOT NULL) THEN 'known' ELSE 'unknown' END AS expected FROM search_requests""")
def expected_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the snapshot a search expects exists."""
    known = read_table(spark, sf_dir, "snapshot_manifests").select(F.col("snapshot_id").alias("expected_snapshot_id")).distinct().withColumn("known", F.lit(True))
    e = F.col("expected_snapshot_id")
    kind = F.when(F.coalesce(e, F.lit("")) == "", "any").when(~manifest.canonical_id(e), "malformed").when(F.col("known"), "known").otherwise("unknown")
    return read_table(spark, sf_dir, "search_requests").join(known, "expected_snapshot_id", "left").select("query_id", kind.alias("expected"))


# --- proximity graphs --------------------------------------------------------------------------------------

_GRAPH = hnsw.GraphConfig(64, heuristic=True)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(hnsw.build(_embeddings(spark, sf_dir), _GRAPH, 4), "graph")


@query()
def hnsw_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten approximate neighbours of every hundredth embedding by proximity graphs."""
    return _rounded(hnsw.search(_index(spark, sf_dir), _asking(_embeddings(spark, sf_dir)), 10, _GRAPH))


@query()
def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the graphs against the exact result."""
    e = _embeddings(spark, sf_dir)
    found = hnsw.search(_index(spark, sf_dir), _asking(e), 10, _GRAPH)
    return evaluation.recall_summary(evaluation.recall(knn.knn(_asking(e), e, 10, 64), found))


@query()
def hnsw_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, levels and degrees of the graphs."""
    return hnsw.stats(_index(spark, sf_dir))


@query("SELECT 0::INT AS shard, 0::INT AS layer, 0::INT AS node, 0::INT AS other, '' AS problem WHERE FALSE")
def hnsw_edge_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graphs that break a rule: none."""
    return hnsw.broken_edges(_index(spark, sf_dir))


@query("SELECT vec_id AS vector_id FROM embeddings WHERE vec_id % 3 = 0")
def hnsw_live_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live ids after two thirds of the nodes were deleted and the graphs built anew."""
    e = _embeddings(spark, sf_dir)
    return hnsw.live_ids(hnsw.rebuild(hnsw.erase(_index(spark, sf_dir), e.where("vector_id % 3 <> 0")), _GRAPH))


@query("SELECT count(*) AS nodes, count(*) FILTER (vec_id % 3 = 0) AS live, count(*) FILTER (vec_id % 3 <> 0) AS deleted FROM embeddings")
def hnsw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, live and deleted ones after two thirds were marked as deleted."""
    e = _embeddings(spark, sf_dir)
    return hnsw.stats(hnsw.erase(_index(spark, sf_dir), e.where("vector_id % 3 <> 0"))).select("nodes", "live", "deleted")


@query("SELECT vec_id AS vector_id FROM embeddings WHERE vec_id % 4 <> 1")
def hnsw_insert_live_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live ids of a stored graph that half of the embeddings were inserted into after the others, and a quarter deleted."""
    e = _embeddings(spark, sf_dir)
    store = graphs.GraphStore(spark, _scratch(spark), _GRAPH, 4)
    store.insert(e.where("vector_id % 2 = 0"))
    store.insert(e.where("vector_id % 2 = 1"))
    store.erase(e.where("vector_id % 4 = 1"))
    return hnsw.live_ids(store.index())


# --- sources and sinks, there and back -----------------------------------------------------------------------

def _scratch(spark: SparkSession) -> str:
    """A folder that is removed when the process ends, as intermediate tables are."""
    return scratch_path(spark, "scratch")


_STORED = f"WITH {_VALID} SELECT id AS vector_id, generate_subscripts(v, 1)::INT - 1 AS place, round(unnest(v)::DOUBLE, 6) AS component FROM valid"


def _unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).where(vector.vector_error("values", 64).isNull() & F.col("vector_id").isNotNull()).distinct()
    return v.select("vector_id", vector.normalize_l2("values").alias("values"))


def _components(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vector_id").cast("bigint").alias("vector_id"), F.posexplode("values").alias("place", "c")).select("vector_id", "place", F.round(F.col("c").cast("double"), 6).alias("component"))


@query(_STORED)
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid vectors written as JSON lines and read back by the strict reader."""
    path = _scratch(spark)
    jsonl.write_vectors(_unit_vectors(spark, sf_dir), path)
    return _components(jsonl.read_vectors(spark, path))


@query(_STORED)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid vectors written as CSV and read back."""
    path = _scratch(spark)
    csv.write_vectors(_unit_vectors(spark, sf_dir).withColumnRenamed("vector_id", "id"), path, 64)
    return _components(csv.read_vectors(spark, path).withColumnRenamed("id", "vector_id"))


@query(_STORED)
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid vectors put into a vector store in one batch, and its rows."""
    rows = materialise(_unit_vectors(spark, sf_dir), "rows")
    store = VectorStore(spark, _scratch(spark), 64, max_batch=2_000_000_000, limits=ResourceLimits(vectors=1 << 40, index_bytes=1 << 60))
    store.add_batch(rows)
    return _components(store.rows())


@query("""
SELECT coalesce(dedup_epoch, 0) AS epoch, client_operation_id AS operation_id, id AS vector_id, row_number() OVER (ORDER BY received_at NULLS LAST, delivery_id) AS lsn FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at NULLS LAST, delivery_id) AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY client_operation_id ORDER BY received_at NULLS LAST, delivery_id) AS o FROM add_vector_requests
    WHERE dedup_epoch = 1 AND client_operation_id <> '' AND id IS NOT NULL AND len("values") = 64
      AND len(list_filter("values", lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter("values", lambda x: x <> 0)) > 0) WHERE o = 1) WHERE v = 1""")
def durable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's records after a restart: the first delivery of every operation and vector of the first epoch, in order of arrival."""
    operation, epoch = dedup.operation_key()
    rows = read_table(spark, sf_dir, "add_vector_requests").where("dedup_epoch = 1 and client_operation_id <> ''")
    rows = rows.select(operation.alias("operation_id"), epoch.alias("epoch"), F.col("id").alias("vector_id"), "values", "received_at", "delivery_id")
    path, policy = _scratch(spark), durable.Policy(1, 64, 1 << 40, 1 << 50)
    log = durable.DurableLog(spark, path, 64, policy, max_batch=20_000)
    for i, part in enumerate(durable.arrival_slices(rows, log.max_batch)):
        log.commit_batch(part.select("seq", "operation_id", "epoch", "vector_id", "values"), str(i))
    again = durable.DurableLog(spark, path, 64, policy)
    return again.records().select("epoch", "operation_id", "vector_id", "lsn")
