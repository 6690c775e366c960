"""Queries of the problems tagged llm, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import abuse, clusters, leaks, near_duplicates, neighbours, pieces, tokens
from vecloom.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector that lies in a cluster, with the cluster's most typical member."""
    return clusters.similarity_clusters(read_table(spark, sf_dir, "vectors")).select("id", "typical_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 6,000 code points and chunks over 120 words as overlapping pieces."""
    kind = F.col("kind")
    texts = _texts(spark, sf_dir)
    documents = pieces.split_oversized(texts.where(kind == "document"), "characters", pieces.DOCUMENT_LIMIT, pieces.DOCUMENT_OVERLAP)
    chunks = pieces.split_oversized(texts.where((kind == "chunk") & (pieces.text_size("words") > pieces.CHUNK_LIMIT)).distinct(), "words", pieces.CHUNK_LIMIT, pieces.CHUNK_OVERLAP)
    return documents.unionByName(chunks).withColumnsRenamed({"kind": "record_kind", "key": "record_key"})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and chunks that come out in several pieces."""
    return p3_pieces(spark, sf_dir).where("chunk_id = 1").select("record_kind", "record_key").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the other's five most similar vectors, at cosine >= 0.8."""
    return neighbours.similar_pairs(read_table(spark, sf_dir, "vectors"), k=5, least=0.8)


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 100, searched among all."""
    near = neighbours.nearest_vectors(read_table(spark, sf_dir, "vectors"), k=10, queries=F.col("id") % 100 == 0, replicas=2, probes=16, query_ratio=0.5)
    return near.select(F.col("id").alias("query_id"), F.posexplode(F.arrays_zip("near", "score")).alias("rank", "n")).select("query_id", "rank", F.col("n.near").alias("vector_id"), F.round(F.col("n.score").cast("double"), 5).alias("score"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("key"), "text")
    return documents.unionByName(read_table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("kind"), F.col("vector_id").alias("key"), "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and pairs of chunks that share at least 0.7 of their word triples."""
    return near_duplicates.duplicate_pairs(_texts(spark, sf_dir)).withColumnRenamed("kind", "record_kind")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and chunk that recurs, with its group and its number of links."""
    return near_duplicates.duplicate_groups(_texts(spark, sf_dir)).withColumnRenamed("kind", "record_kind")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokens.token_ids(read_table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 13 consecutive words of a test item."""
    found = leaks.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), length=13)
    return found.select("doc_id", "item_id").distinct()


def p7_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which runs of at least 5 words cover half of a test item, in whatever order."""
    return leaks.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), length=5, least_coverage=0.5)


def _abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an abusive, hateful or sexually explicit passage."""
    return _abuse(spark, sf_dir).where("score > 0").select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return _abuse(spark, sf_dir)


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of abusive documents of each source."""
    return abuse.rates(_abuse(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


_UNIT = "[(x::DOUBLE * (1.0 / sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[]))))::FLOAT for x in v]"
#: Cosines between all valid vectors, each id once: exact, so for small tables only.
_COSINES = f"""
WITH u AS (SELECT id, {_UNIT} AS v FROM (SELECT DISTINCT id, "values" AS v FROM vectors)
  WHERE id IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT q.id AS a, e.id AS b, list_inner_product(q.v::DOUBLE[], e.v::DOUBLE[])::FLOAT AS s FROM u q JOIN u e ON q.id <> e.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) - 1 AS rank FROM s)
"""
_TRIPLES = r"""
WITH t AS (SELECT 'document' AS kind, doc_id AS key, text FROM documents UNION ALL SELECT 'chunk', vector_id, text FROM chunks),
w AS (SELECT DISTINCT kind, key, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t WHERE key IS NOT NULL),
g AS (SELECT kind, key, hash(text) AS h, list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS g FROM w WHERE len(w) >= 30),
e AS (SELECT kind, key, h, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.kind, a.key AS ka, b.key AS kb, a.h AS ha, b.h AS hb, a.n AS na, b.n AS nb, count(*) AS c
      FROM e a JOIN e b ON a.kind = b.kind AND a.x = b.x AND a.key < b.key GROUP BY ALL)
"""

SQL = {
    "p3_found": r"""
SELECT 'document' AS record_kind, doc_id AS record_key FROM documents WHERE length(text) > 6000
UNION SELECT 'chunk', vector_id FROM chunks
WHERE len(regexp_extract_all(text, '[^\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) > 120""",
    "p4_found": _COSINES + "SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE rank < 5 AND s >= 0.8::FLOAT",
    "p4_neighbours": _COSINES + "SELECT a AS query_id, rank::INT AS rank, b AS vector_id, round(s::DOUBLE, 5) AS score FROM r WHERE rank < 10 AND a % 100 = 0",
    "p5_found": _TRIPLES + "SELECT DISTINCT kind AS record_kind, ka AS key_a, kb AS key_b FROM p WHERE 10 * c >= 7 * (na + nb - c)",
    "p5_groups": _TRIPLES.replace("WITH t", "WITH RECURSIVE t").split("e AS")[0]
    + """n AS (SELECT *, row_number() OVER () AS i FROM (SELECT DISTINCT kind, key, list_sort(g) AS g FROM g)),
e AS (SELECT i, kind, len(g) AS n, unnest(g) AS x FROM n),
l AS (SELECT a.i AS a, b.i AS b FROM e a JOIN e b ON a.kind = b.kind AND a.x = b.x AND a.i <> b.i GROUP BY a.i, b.i, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*))),
r AS (SELECT i AS a, i AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a),
s AS (SELECT r.root AS i, min(n.key) AS grp FROM r JOIN n ON n.i = r.a GROUP BY r.root),
c AS (SELECT a AS i, count(*) AS links FROM l GROUP BY a)
SELECT kind AS record_kind, key, min(grp) AS "group", sum(links)::BIGINT AS links FROM n JOIN c USING (i) JOIN s USING (i) GROUP BY kind, key""",
    "p7_found": r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '\\[a-zA-Z@]+\*?', ' ', 'g')), '[a-z0-9]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '\\[a-zA-Z@]+\*?', ' ', 'g')), '[a-z0-9]+') AS w FROM documents),
ig AS (SELECT item_id, unnest([array_to_string(w[k : k + 12], ' ') for k in range(1, len(w) - 11)]) AS g FROM i WHERE len(w) >= 13),
dg AS (SELECT doc_id, unnest([array_to_string(w[k : k + 12], ' ') for k in range(1, len(w) - 11)]) AS g FROM d WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
