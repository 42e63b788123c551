"""Genotype, position and trait views of the driver tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GENO = """
SELECT CAST(l_suppkey AS INT) AS taxon_id, CAST(l_partkey % 200 AS INT) AS site_id,
 CAST(CASE WHEN min(l_orderkey*7 + l_linenumber) % 10 = 0 THEN 15 ELSE ((l_partkey % 200) % 3 + (CASE WHEN min(l_orderkey*7 + l_linenumber) % 10 < 4 THEN 1 ELSE 0 END)) % 4 END AS INT) AS a1,
 CAST(CASE WHEN min(l_orderkey*7 + l_linenumber) % 10 = 0 THEN 15 ELSE ((l_partkey % 200) % 3 + (CASE WHEN max(l_orderkey*3 + l_linenumber) % 10 < 4 THEN 1 ELSE 0 END)) % 4 END AS INT) AS a2
FROM {lineitem} GROUP BY l_suppkey, l_partkey % 200
"""
POSITIONS = """
SELECT CAST(p.site AS INT) AS site_id, CAST(1 + floor(p.site / 50) AS INT) AS chrom, CAST(1000 + (p.site % 50) * 137 + p.site % 7 AS INT) AS pos,
 concat('S_', CAST(p.site AS STRING)) AS snp_id FROM (SELECT DISTINCT l_partkey % 200 AS site FROM {lineitem}) p
"""
TRAITS = """
SELECT CAST(s_suppkey AS INT) AS taxon_id, s_name AS taxon, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE round(s_acctbal,2) END AS t1, CAST(s_nationkey AS INT) AS f1 FROM {supplier}
"""

#: Common table expressions that every oracle query begins with.
WITH = f"""WITH geno AS ({GENO.format(lineitem="lineitem")}),
positions AS ({POSITIONS.format(lineitem="lineitem")}),
traits AS ({TRAITS.format(supplier="supplier")}),
gametes AS (SELECT site_id, taxon_id, a1 AS allele FROM geno WHERE a1 < 14 UNION ALL SELECT site_id, taxon_id, a2 FROM geno WHERE a2 < 14),
allele_n AS (SELECT site_id, allele, CAST(count(*) AS BIGINT) AS n FROM gametes GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, allele) AS rk FROM allele_n),
site AS (SELECT g.site_id, max(CASE WHEN rk = 1 THEN allele END) AS major, CAST(coalesce(max(CASE WHEN rk = 1 THEN n END), 0) AS BIGINT) AS major_n,
  max(CASE WHEN rk = 2 THEN allele END) AS minor, CAST(coalesce(max(CASE WHEN rk = 2 THEN n END), 0) AS BIGINT) AS minor_n, CAST(coalesce(sum(n), 0) AS BIGINT) AS gametes
  FROM (SELECT DISTINCT site_id FROM geno) g LEFT JOIN ranked r ON r.site_id = g.site_id GROUP BY g.site_id),
site_calls AS (SELECT site_id, CAST(count(*) AS BIGINT) AS taxa, CAST(sum(CASE WHEN a1 = 15 AND a2 = 15 THEN 0 ELSE 1 END) AS BIGINT) AS called,
  CAST(sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) AS BIGINT) AS hets FROM geno GROUP BY site_id)
"""


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in ("lineitem", "supplier") if "{" + t + "}" in query}
    return spark.sql(query, **tables)


def geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calls: taxon_id, site_id, a1, a2."""
    return _sql(spark, sf_dir, GENO)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, POSITIONS)


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TRAITS)
