"""One registered query per operator of this package, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jouleframe.llm import bpe, brown, exact_dedup, licenses, mixing, near_dedup, negatives, neighbours, packing, pages, secrets, toxicity, whitening
from jouleframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op10_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST)
"""


def production_weights() -> dict[str, Column]:
    """Domains, languages, and equal sources; made when a session is there to hold expressions."""
    return {
        "domain": F.expr("CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END"),
        "lang": F.expr("CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END"),
        "source": F.lit(1),
    }


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, a document in up to four epochs."""
    picked = mixing.mix(table(spark, sf_dir, "documents"), F.floor(F.sum("tokens") / 2), production_weights(), max_epochs=4, seed=7)
    return picked.select("doc_id", "domain", "lang", "source", "epoch", "tokens", "taken")


def _share_sql(nodes: str, parent: str, budget: str, level: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
  SELECT *, CAST(part + CASE WHEN NOT is_full AND weight > 0 AND part < cap
      AND sum(CASE WHEN NOT is_full AND weight > 0 THEN 1 ELSE 0 END) OVER ({by} ORDER BY full_at, {level} ROWS UNBOUNDED PRECEDING)
          <= {budget} - sum(part) OVER ({by}) THEN 1 ELSE 0 END AS BIGINT) AS got
  FROM (SELECT *, least(CAST(CASE WHEN is_full THEN cap WHEN opened = 0 THEN 0
            ELSE floor(CAST(left_over AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(opened AS DOUBLE)) END AS BIGINT), cap) AS part
  FROM (SELECT *, CAST({budget} - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS BIGINT) AS left_over,
               CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) AS BIGINT) AS opened
  FROM (SELECT *, weight > 0 AND CAST(cap AS DOUBLE) * CAST(w AS DOUBLE) <= (CAST({budget} AS DOUBLE) - CAST(used AS DOUBLE)) * CAST(weight AS DOUBLE) AS is_full
  FROM (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY full_at, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
               sum(weight) OVER ({by} ORDER BY full_at, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w
  FROM (SELECT *, CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) AS full_at FROM {nodes})))))"""


def mixing_sql(fraction: str, max_epochs: int, seed: int, documents: str = "documents") -> str:
    """CTEs up to ``picked``: one row per document and epoch."""
    return f"""
d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)', 1) = '' THEN 'd'
        ELSE 'd' || (CAST(right(regexp_extract(coalesce(source, ''), '([0-9]+)', 1), 1) AS INTEGER) % 4) END AS domain,
   CAST(greatest(1, ceil(strlen(coalesce(text, '')) / 4)) AS BIGINT) AS tokens FROM {documents}),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {max_epochs} AS BIGINT) AS cap FROM d GROUP BY ALL),
n1 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS weight,
   (SELECT CAST(least({fraction}, sum(cap)) AS BIGINT) FROM leaf) AS b FROM leaf GROUP BY domain),
s1 AS ({_share_sql('n1', '', 'b', 'domain')}),
n2 AS (SELECT domain, lang, CAST(sum(leaf.cap) AS BIGINT) AS cap, CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight,
   any_value(s1.got) AS b FROM leaf JOIN s1 USING (domain) GROUP BY domain, lang),
s2 AS ({_share_sql('n2', 'domain', 'b', 'lang')}),
n3 AS (SELECT domain, lang, source, leaf.cap, leaf.tokens, 1 AS weight, s2.got AS b FROM leaf JOIN s2 USING (domain, lang)),
s3 AS ({_share_sql('n3', 'domain, lang', 'b', 'source')}),
plan AS (SELECT domain, lang, source, got // tokens AS full_epochs, got % tokens AS rest FROM s3),
x AS (SELECT * FROM d JOIN plan USING (domain, lang, source)),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY
     md5('{seed}:' || full_epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, tokens
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM x),
picked AS (
  SELECT doc_id, domain, lang, source, CAST(unnest(range(full_epochs)) AS INTEGER) AS epoch, tokens, tokens AS taken FROM x
  UNION ALL
  SELECT doc_id, domain, lang, source, CAST(full_epochs AS INTEGER), tokens, CAST(least(tokens, rest - place) AS BIGINT) FROM placed WHERE place < rest)"""


ORACLES["op9_mix_sources"] = f"WITH {mixing_sql('(SELECT floor(sum(tokens) / 2) FROM leaf)', 4, 7)} SELECT * FROM picked"


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


@query
def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "cluster_id", "cluster_size", "kept")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query
def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scored(table(spark, sf_dir, "documents"))


@query
def op11_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: identifiers divisible by 100. Labels whose identifier is divisible by 7 are moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS own,
         CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
  FROM v AS a JOIN v AS r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""
