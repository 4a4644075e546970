"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from . import fm_dedup, language, mixing, neighbours, packing, quality, secrets, sharding, simhash, suffix_dedup
from .common import table


def op1_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark, sf_dir):
    return language.report(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.report(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    return fm_dedup.report(table(spark, sf_dir, "documents"))


#: DuckDB has neither CRC-32 nor XXH64 nor Spark's hash, and no trained models, so only these are given in SQL.
ORACLES: dict[str, str] = {
    "op3_mixing": r"""WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS h, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
 w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM s),
 c AS (SELECT *, CAST(source_size * 3 AS DOUBLE) / w AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total,
  coalesce(sum(source_size * 3) OVER e, 0) AS caps, sum(w) OVER () - coalesce(sum(w) OVER e, 0) AS rest FROM w
  WINDOW e AS (ORDER BY CAST(source_size * 3 AS DOUBLE) / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT max(CASE WHEN CAST(total - caps AS DOUBLE) / CAST(rest AS DOUBLE) <= ratio THEN CAST(total - caps AS DOUBLE) / CAST(rest AS DOUBLE) END) AS level FROM c),
 t AS (SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE), w * coalesce(level, 0.0)) AS target FROM c, l),
 r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  count(*) OVER (PARTITION BY doc_id, d.source, h) AS n, row_number() OVER (PARTITION BY doc_id, d.source, h) AS k,
  CAST('0x' || substr(md5('mix-2:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || h), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 p AS (SELECT *, CAST(floor(rate) + CAST(k <= floor(n * (rate - floor(rate)) + u) AS INTEGER) AS BIGINT) AS copies FROM r)
 SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM p""",
}
QUERIES = {f.__name__: f for f in (op1_sharding, op2_suffix_dedup, op3_mixing, op4_quality_rules, op5_neighbours, op6_language_id, op7_simhash, op8_packing, op9_secret_scans, op10_substring_dedup)}
