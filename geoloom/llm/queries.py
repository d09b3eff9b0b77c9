"""The registered queries of the corpus operators: each applies its operator, with production
parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, embed_dedup, exact_dedup, lm, mixing, ngram_join, quality, sharding, spelling, tokencount, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def vocabulary() -> str:
    """The public vocabulary file that op9 and op13 are stated for; it isn't part of this repository."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components at 4-word shingles and Jaccard 0.85."""
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_score(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.cosine_near_dedup(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position: when the first pass takes the document; position_2: the second."""
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, passes=2)
    due = lambda i: F.try_element_at("positions", F.lit(i))
    return mix.select("doc_id", "size", "source_size", "target", "taken", due(1).alias("position"), due(2).alias("position_2"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MiB of text, so that tables of every size are split."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), limit_bytes=1 << 20)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_roundtrip(table(spark, sf_dir, "documents"), vocabulary())


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, url_filter.DEFAULT_RULES)
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, size=64, scale=256, seed="2")


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"), least=7, least_count=2, delete_every=31, times=10)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary(), limit=512)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality": op4_quality,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_bpe": op9_bpe,
    "op10_url_filter": op10_url_filter,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_token_counts": op13_token_counts,
    "pipeline": pipeline,
}



def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """op11 in SQL: distances from inner products, the number of the nearest centroid in the last digits."""
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v ORDER BY c LIMIT {k})",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v.x) AS x,
  min(CAST(list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT) * 64 + c) AS m FROM v, c{n} AS c GROUP BY r)"""
        )
        if n < rounds:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(g.x, c.x) AS x FROM c{n} AS c LEFT JOIN (SELECT c, list(t ORDER BY i) AS x FROM
  (SELECT m % 64 AS c, i, floor(sum(x[i]) / count(*)) AS t FROM a{n}, (SELECT unnest(range(1, 65)) AS i) GROUP BY m % 64, i) GROUP BY c) AS g ON c.c = g.c)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(m % 64 AS INTEGER) AS cluster, m // 64 AS distance, CAST(sum(m // 64) OVER (PARTITION BY m % 64) AS BIGINT) AS cluster_inertia,
  CAST(sum(m // 64) OVER () AS BIGINT) AS inertia, sha256(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN c.x], ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS c ON m % 64 = c.c"""


#: DuckDB SQL; what is missing here is tested against brute force, a round trip or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": _clustering_sql(),
    "op3_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
""",
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST(('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text,''))), ':17')), 1, 15)) AS BIGINT) AS key, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, round(least(cap, coalesce(weight * (SELECT max(level) FROM f WHERE cap > weight * level), cap)), 6) AS target,
  CASE k % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS a, CASE k % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS b FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.a, t.b, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.tie, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CAST(greatest(0, least(size, floor(target) - ahead)) AS BIGINT) AS taken_1, CAST(greatest(0, least(size, floor(target) - ahead - source_size)) AS BIGINT) AS taken_2,
  CASE WHEN target > 0 THEN ahead / target * ((a + b) / 2) END AS due_1, CASE WHEN target > 0 THEN (ahead + source_size) / target * ((a + b) / 2) END AS due_2 FROM p)
SELECT doc_id, size, source_size, target, taken_1 + taken_2 AS taken,
  CASE WHEN taken_1 > 0 THEN round(CASE WHEN a = b THEN due_1 / a ELSE (sqrt(greatest(0, a * a + 2 * (b - a) * due_1)) - a) / (b - a) END, 9) + 0 END AS position,
  CASE WHEN taken_2 > 0 THEN round(CASE WHEN a = b THEN due_2 / a ELSE (sqrt(greatest(0, a * a + 2 * (b - a) * due_2)) - a) / (b - a) END, 9) + 0 END AS position_2 FROM q
""",
    "op10_url_filter": r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path, row_number() OVER () AS k FROM pages),
r(rh, rp, v) AS (VALUES ('net','/','block'),('example.net','/en/','allow'),('example.com','/de/','block'),('org','/fr/','allow')),
m AS (SELECT p.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN rh IS NULL THEN 0 ELSE 1 END DESC, length(rh || rp) DESC, v DESC, rh || rp) AS n
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
""",
    # a row's depth is the number of its open prefixes
    "op8_sharding": """
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text,'')) AS BIGINT) AS n_bytes,
  CAST(('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR),''), ':', coalesce(text,''))), 1, 15)) AS BIGINT) AS h FROM documents),
l AS (SELECT d.*, level, d.h >> (60 - level) AS prefix FROM d, (SELECT CAST(range AS INTEGER) AS level FROM range(0, 40)) g),
n AS (SELECT level, prefix FROM l GROUP BY level, prefix HAVING sum(n_bytes) > 1048576 AND min(h) < max(h)),
e AS (SELECT doc_id, h, CAST(count(n.level) AS INTEGER) AS depth FROM l LEFT JOIN n ON l.level = n.level AND l.prefix = n.prefix GROUP BY doc_id, h),
s AS (SELECT d.doc_id, d.n_bytes, e.depth, CASE WHEN e.depth = 0 THEN '' ELSE lpad(bin(d.h), 60, '0')[1:e.depth] END AS shard FROM d JOIN e ON d.doc_id = e.doc_id AND d.h = e.h)
SELECT doc_id, n_bytes, shard, depth, CAST(sum(n_bytes) OVER (PARTITION BY shard) AS BIGINT) AS shard_bytes, count(*) OVER (PARTITION BY shard) AS shard_rows FROM s
""",
}
