"""Queries of sites by place, orders, depths, round trips through the text formats and sequence expressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encoding
from ..functions.tables import shared_dir
from ..operators import pairs, sites, traits
from ..sources import text
from .genotype_queries import r9
from .quality_queries import _HOM, _IBS, _LD
from .registry import query
from .views import WITH, geno, positions
from .views import traits as trait_view

_CALLS = "SELECT taxon_id, site_id, a1, a2 FROM geno WHERE "


@query("sites_at_positions", WITH + _CALLS + "site_id IN (SELECT p.site_id FROM positions p JOIN (SELECT DISTINCT chrom, pos FROM positions WHERE pos % 3 = 0) l ON l.chrom = p.chrom AND l.pos = p.pos)")
def sites_at_positions(spark, d):
    p = positions(spark, d)
    return sites.sites_at_positions(geno(spark, d), p, p.where("pos % 3 = 0").select("chrom", "pos")).select("taxon_id", "site_id", "a1", "a2")


@query("sites_by_index", WITH + ", o AS (SELECT site_id, row_number() OVER (ORDER BY chrom, pos, site_id) - 1 AS i FROM positions) " + _CALLS + "site_id IN (SELECT site_id FROM o WHERE i IN (0, 7, 50, 199, 9999))")
def sites_by_index(spark, d):
    listed = spark.createDataFrame([(i,) for i in (0, 7, 50, 199, 9999)], "index long")
    return sites.sites_by_index(geno(spark, d), positions(spark, d), listed).select("taxon_id", "site_id", "a1", "a2")


@query("filter_sites_by_neighbor_ld", WITH + _HOM + ", e AS (SELECT site_i AS site_id, abs(r) AS r FROM corr WHERE r IS NOT NULL AND site_j - site_i BETWEEN 10 AND 29 UNION ALL SELECT site_j, abs(r) FROM corr WHERE r IS NOT NULL AND site_j - site_i BETWEEN 10 AND 29) " + _CALLS + "site_id IN (SELECT site_id FROM e GROUP BY 1 HAVING avg(r) >= 0.1)")
def filter_sites_by_neighbor_ld(spark, d):
    return sites.sites_by_neighbor_ld(geno(spark, d), 20, 0.1).select("taxon_id", "site_id", "a1", "a2")


@query("traits_by_kind", WITH + "SELECT taxon_id, 't1' AS trait, t1 AS value FROM traits")
def traits_by_kind(spark, d):
    kinds = spark.createDataFrame([("t1", "data"), ("f1", "factor")], "trait string, kind string")
    return sites.traits_by_kind(traits.long_form(trait_view(spark, d), ["t1", "f1"]), kinds, ["data", "covariate"])


@query("rename_taxa", WITH + "SELECT taxon_id, CASE WHEN taxon_id % 5 = 0 THEN concat('line_', CAST(taxon_id AS VARCHAR)) ELSE taxon END AS taxon, t1, f1 FROM traits")
def rename_taxa(spark, d):
    t = trait_view(spark, d)
    return sites.rename_taxa(t, t.where("taxon_id % 5 = 0").select(F.col("taxon").alias("name"), F.concat(F.lit("line_"), "taxon_id").alias("accepted")))


@query("tables_by_chromosome", WITH + "SELECT CAST(chrom AS INT) AS chrom, taxon_id, g.site_id, a1, a2 FROM geno g JOIN positions p ON p.site_id = g.site_id")
def tables_by_chromosome(spark, d):
    path = shared_dir(spark, "by-chromosome")
    sites.write_by_chromosome(geno(spark, d), positions(spark, d), path)
    return spark.read.parquet(path).select(F.col("chrom").cast("int").alias("chrom"), "taxon_id", "site_id", "a1", "a2")


@query("join_on_id", WITH + "SELECT coalesce(a.taxon_id, b.taxon_id) AS taxon_id, a.t1, a.f1, b.t1 AS t1_2, b.taxon FROM (SELECT taxon_id, t1, f1 FROM traits WHERE taxon_id % 3 > 0) a FULL JOIN (SELECT taxon_id, t1, taxon FROM traits WHERE taxon_id % 2 = 0) b ON a.taxon_id = b.taxon_id")
def join_on_id(spark, d):
    t = trait_view(spark, d)
    return sites.join_on_id(t.where("taxon_id % 3 > 0").select("taxon_id", "t1", "f1"), t.where("taxon_id % 2 = 0").select("taxon_id", "t1", "taxon"), "taxon_id")


@query("distances_without", WITH + _IBS + " SELECT taxon_i, taxon_j, round(dist, 9) AS dist FROM dist WHERE taxon_i % 7 > 0 AND taxon_j % 7 > 0")
def distances_without(spark, d):
    g = geno(spark, d)
    gone = g.select("taxon_id").distinct().where("taxon_id % 7 = 0")
    return sites.distances_without(pairs.ibs(g), gone).withColumn("dist", r9("dist"))


@query("percentile_steps", WITH + """, v AS (SELECT 'called' AS name, CAST(called AS DOUBLE) AS value FROM site_calls UNION ALL SELECT 'maf', CAST(minor_n AS DOUBLE) / gametes FROM site WHERE gametes > 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM v)
  SELECT name, CAST(k AS INT) AS step, round(value, 9) AS value FROM o JOIN range(0, 21) r(k) ON o.i = least(n - 1, k * n // 20)""")  # fmt: skip
def percentile_steps(spark, d):
    from ..operators.summary import site_stats

    return sites.percentile_steps(site_stats(geno(spark, d)), ["called", "maf"]).withColumn("value", r9("value"))


def depths(spark, d):
    return geno(spark, d).select("taxon_id", "site_id", F.array(*[(F.pmod(F.col("taxon_id") * (k + 3) + F.col("site_id") * (k + 1), F.lit(7)) * (F.col("a1") == k).cast("int")).cast("int") for k in range(4)]).alias("depth"))


_DEPTH = ", dp AS (SELECT taxon_id, site_id, CASE WHEN a1 < 4 THEN (taxon_id * (a1 + 3) + site_id * (a1 + 1)) % 7 ELSE 0 END AS r FROM geno) "


@query("depth_by_taxon", WITH + _DEPTH + "SELECT taxon_id, CAST(sum(r) AS BIGINT) AS reads, CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS covered FROM dp GROUP BY 1")
def depth_by_taxon(spark, d):
    return sites.depth_by(depths(spark, d), "taxon_id")


@query("depth_by_site", WITH + _DEPTH + "SELECT site_id, CAST(sum(r) AS BIGINT) AS reads, CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS covered FROM dp GROUP BY 1")
def depth_by_site(spark, d):
    return sites.depth_by(depths(spark, d), "site_id")


@query("taxa_groups", WITH + "SELECT value, count(*) AS taxa FROM (SELECT concat('n', CAST(f1 AS VARCHAR)) AS value FROM traits UNION ALL SELECT concat('r', CAST(f1 % 5 AS VARCHAR)) FROM traits) GROUP BY 1")
def taxa_groups(spark, d):
    group = F.array(F.concat(F.lit("n"), "f1"), F.concat(F.lit("r"), F.col("f1") % 5))
    return sites.taxa_groups(trait_view(spark, d).select("taxon", F.create_map(F.lit("group"), group).alias("anno")), "group")


@query("state_counts", WITH + "SELECT site_id, count(DISTINCT least(a1, a2) * 16 + greatest(a1, a2)) AS states, count(DISTINCT least(a1, a2) * 16 + greatest(a1, a2)) = count(*) AS \"unique\" FROM geno WHERE NOT (a1 = 15 AND a2 = 15) GROUP BY 1")
def state_counts(spark, d):
    return sites.state_counts(geno(spark, d))


@query("polymorphic_windows", WITH + """, o AS (SELECT chrom, pos, CAST(minor_n AS DOUBLE) / gametes AS maf, row_number() OVER (PARTITION BY chrom ORDER BY pos, s.site_id) - 1 AS i, count(*) OVER (PARTITION BY chrom) AS n FROM site s JOIN positions p ON p.site_id = s.site_id WHERE minor_n > 0),
  w AS (SELECT k * 5 AS start FROM range(0, 100) r(k))
  SELECT chrom, CAST(start AS INT) AS start, min(pos) AS first_pos, max(pos) AS last_pos, round(avg(maf), 9) AS mean_maf FROM o JOIN w ON i BETWEEN start AND start + 9 WHERE start + 10 <= n GROUP BY chrom, start""")  # fmt: skip
def polymorphic_windows(spark, d):
    r = sites.polymorphic_windows(geno(spark, d), positions(spark, d), 10, 5)
    return r.select("chrom", F.col("start").cast("int").alias("start"), "first_pos", "last_pos", r9("mean_maf").alias("mean_maf"))


@query("misplaced_sites", WITH + ", m AS (SELECT site_id, chrom, CASE WHEN site_id % 9 = 0 THEN pos - 400 ELSE pos END AS pos FROM positions), o AS (SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY site_id) AS before FROM m) SELECT site_id, chrom, pos, before FROM o WHERE pos < before")
def misplaced_sites(spark, d):
    return sites.misplaced(positions(spark, d).withColumn("pos", F.when(F.col("site_id") % 9 == 0, F.col("pos") - 400).otherwise(F.col("pos"))))


@query("taxa_in_order", WITH + "SELECT taxon_id, taxon, row_number() OVER (ORDER BY taxon) AS place FROM traits")
def taxa_in_order(spark, d):
    return sites.in_order(trait_view(spark, d).select("taxon_id", "taxon"), "taxon")


@query("natural_order", WITH + r"SELECT snp_id, row_number() OVER (ORDER BY array_to_string([CASE WHEN regexp_matches(p, '^\d') THEN lpad(p, 20, '0') ELSE p END for p in regexp_extract_all(snp_id, '(\d+|\D+)')], '')) AS place FROM positions")
def natural_order(spark, d):
    return sites.in_order(positions(spark, d).select("snp_id"), "snp_id", natural=True)


@query("ranked_ld", WITH + _LD + ", o AS (SELECT site_i, site_j, round(r2, 9) AS r2 FROM ld WHERE r2 IS NOT NULL) SELECT site_i, site_j, r2, row_number() OVER (ORDER BY r2 DESC, site_i, site_j) AS place FROM o")
def ranked_ld(spark, d):
    return sites.ranked_ld(pairs.ld(geno(spark, d)).select("site_i", "site_j", r9("r2").alias("r2")))


@query("association_by_sums", WITH + """, v AS (SELECT taxon_id, t1 - (SELECT avg(t1) FROM traits) AS y FROM traits WHERE t1 IS NOT NULL),
  g AS (SELECT site_id, least(a1, a2) * 16 + greatest(a1, a2) AS call, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM geno g JOIN v ON v.taxon_id = g.taxon_id WHERE a1 < 14 AND a2 < 14 GROUP BY 1, 2),
  t AS (SELECT site_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS m FROM g GROUP BY 1), x AS (SELECT *, q - s * s / n AS total, m - s * s / n AS model FROM t)
  SELECT 't1' AS trait, site_id, n, k - 1 AS df, n - k AS error_df, round(CASE WHEN k > 1 AND n > k AND total - model > 1e-9 THEN model / (k - 1) / ((total - model) / (n - k)) END, 6) AS f, round(CASE WHEN total > 0 THEN model / total END, 6) AS r2 FROM x""")  # fmt: skip
def association_by_sums(spark, d):
    r = sites.association_by_sums(geno(spark, d), traits.long_form(trait_view(spark, d), ["t1"]))
    return r.withColumns({"f": F.round("f", 6), "r2": F.round("r2", 6)})


def named_calls(spark, d):
    t = trait_view(spark, d).select("taxon_id", "taxon")
    return geno(spark, d).join(t, "taxon_id").join(positions(spark, d), "site_id").select("taxon", "snp_id", F.col("chrom").cast("string").alias("chrom"), "pos", "a1", "a2")


#: Formats hold every cell, so cells that the view lacks come back as missing.
_CELLS = WITH + """, n AS (SELECT taxon, snp_id, CAST(chrom AS VARCHAR) AS chrom, pos, p.site_id, t.taxon_id FROM traits t CROSS JOIN positions p WHERE t.taxon_id IN (SELECT taxon_id FROM geno)),
  cells AS (SELECT taxon, snp_id, chrom, pos, coalesce(a1, 15) AS a1, coalesce(a2, 15) AS a2 FROM n LEFT JOIN geno g ON g.taxon_id = n.taxon_id AND g.site_id = n.site_id) """
_SORTED = _CELLS + "SELECT taxon, snp_id, chrom, pos, least(a1, a2) AS a1, greatest(a1, a2) AS a2 FROM cells"


@query("hapmap_round_trip", _SORTED)
def hapmap_round_trip(spark, d):
    path = shared_dir(spark, "hapmap")
    text.write(named_calls(spark, d), path, "hapmap")
    return text.read(spark, path, "hapmap").select("taxon", "snp_id", "chrom", "pos", F.least("a1", "a2").alias("a1"), F.greatest("a1", "a2").alias("a2"))


@query("hapmap_diploid_round_trip", _CELLS + "SELECT taxon, snp_id, chrom, pos, a1, a2 FROM cells")
def hapmap_diploid_round_trip(spark, d):
    path = shared_dir(spark, "hapmap2")
    text.write_hapmap(named_calls(spark, d), path, diploid=True)
    return text.read_hapmap(spark, path)


@query("vcf_round_trip", _CELLS + "SELECT taxon, snp_id, chrom, pos, a1, a2 FROM cells")
def vcf_round_trip(spark, d):
    path = shared_dir(spark, "vcf")
    text.write(named_calls(spark, d), path, "vcf")
    return text.read(spark, path, "vcf").drop("depth")


@query("vcf_depth_round_trip", _CELLS + """, dp AS (SELECT g.taxon_id, g.site_id, string_agg(CAST((g.taxon_id + g.site_id + r.allele) % 7 AS VARCHAR), ',' ORDER BY rk) AS depth FROM geno g JOIN ranked r ON r.site_id = g.site_id GROUP BY 1, 2)
  SELECT n.taxon, n.snp_id, n.chrom, n.pos, coalesce(a1, 15) AS a1, coalesce(a2, 15) AS a2, coalesce(depth, '') AS depth FROM n LEFT JOIN geno g ON g.taxon_id = n.taxon_id AND g.site_id = n.site_id LEFT JOIN dp ON dp.taxon_id = n.taxon_id AND dp.site_id = n.site_id""")  # fmt: skip
def vcf_depth_round_trip(spark, d):
    """Depths of an allele are told by the numbers of taxon, site and allele. The format is guessed by the first lines."""
    path = shared_dir(spark, "calls-with-depth")
    t = trait_view(spark, d).select("taxon_id", "taxon")
    depth = F.array(*[((F.col("taxon_id") + F.col("site_id") + k) % 7).cast("int") for k in range(6)])
    c = geno(spark, d).withColumn("depth", depth).join(t, "taxon_id").join(positions(spark, d), "site_id").select("taxon", "snp_id", F.col("chrom").cast("string").alias("chrom"), "pos", "a1", "a2", "depth")
    text.write(c, path, "vcf")
    return text.read(spark, path).withColumn("depth", F.array_join("depth", ","))


def _all_cells(spark, d):
    c = named_calls(spark, d)
    every = c.select("taxon").distinct().withColumn("k", F.lit(1)).join(c.select("snp_id", "chrom", "pos").distinct().withColumn("k", F.lit(1)), "k").drop("k")
    return every.join(c, ["taxon", "snp_id", "chrom", "pos"], "left").fillna(15, ["a1", "a2"])


@query("plink_round_trip", _CELLS + "SELECT replace(taxon, ' ', '_') AS taxon, snp_id, chrom, pos, a1, a2 FROM cells")
def plink_round_trip(spark, d):
    ped, map_ = shared_dir(spark, "ped"), shared_dir(spark, "map")
    text.write_plink(_all_cells(spark, d).withColumn("taxon", F.replace("taxon", F.lit(" "), F.lit("_"))), ped, map_)
    return text.read_plink(spark, ped, map_)


def sequences(spark, d, tasks=None):
    p = spark.read.parquet(f"{d.rstrip('/')}/part.parquet")
    p = p.repartition(tasks, "p_partkey") if tasks else p
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.translate(F.concat(F.md5("p_name"), F.md5("p_type")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("sequence"))


_SEQ = "WITH q AS (SELECT concat('p', CAST(p_partkey AS VARCHAR)) AS name, translate(concat(md5(p_name), md5(p_type)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence FROM part) "


@query("fasta_round_trip", _SEQ + "SELECT name, sequence FROM q")
def fasta_round_trip(spark, d):
    path = shared_dir(spark, "fasta")
    text.write(sequences(spark, d), path, "fasta")
    return text.read(spark, path, "fasta")


@query("phylip_round_trip", _SEQ + "SELECT name, sequence FROM q")
def phylip_round_trip(spark, d):
    path = shared_dir(spark, "phylip")
    text.write(sequences(spark, d), path, "phylip")
    return text.read(spark, path, "phylip")


@query("fastq_round_trip", _SEQ + "SELECT name AS read_id, sequence AS seq, repeat('I', 64) AS qual FROM q")
def fastq_round_trip(spark, d):
    path = shared_dir(spark, "fastq")
    text.write(sequences(spark, d).select(F.col("name").alias("read_id"), F.col("sequence").alias("seq"), F.repeat(F.lit("I"), F.lit(64)).alias("qual")), path, "fastq")
    return text.read(spark, path, "fastq")


@query("distances_round_trip", WITH + _IBS + ", b AS (SELECT taxon_i, taxon_j, dist FROM dist UNION ALL SELECT taxon_j, taxon_i, dist FROM dist UNION ALL SELECT DISTINCT taxon_id, taxon_id, CAST(0 AS DOUBLE) FROM geno) SELECT CAST(taxon_i AS VARCHAR) AS taxon_i, CAST(row_number() OVER (PARTITION BY taxon_i ORDER BY taxon_j) - 1 AS INT) AS \"column\", round(dist, 9) AS dist FROM b")
def distances_round_trip(spark, d):
    path = shared_dir(spark, "distances")
    text.write(pairs.ibs(geno(spark, d)), path, "distances")
    return text.read(spark, path, "distances").withColumn("dist", r9("dist"))


@query("traits_round_trip", WITH + "SELECT CAST(taxon_id AS VARCHAR) AS taxon, 't1' AS trait, t1 AS value FROM traits UNION ALL SELECT CAST(taxon_id AS VARCHAR), 'f1', CAST(f1 AS DOUBLE) FROM traits")
def traits_round_trip(spark, d):
    path = shared_dir(spark, "traits")
    text.write(traits.long_form(trait_view(spark, d), ["t1", "f1"]).withColumn("taxon", F.col("taxon_id").cast("string")), path, "traits")
    return text.read(spark, path, "traits").select("taxon", "trait", "value")


@query("report_round_trip", WITH + "SELECT taxon_id, taxon, t1, f1 FROM traits")
def report_round_trip(spark, d):
    path = shared_dir(spark, "report")
    text.write_report(trait_view(spark, d), path)
    return text.read_report(spark, path, types="taxon_id int, taxon string, t1 double, f1 int")


@query("packed_sequences", _SEQ + """, w AS (SELECT name, sequence, i, substr(sequence, CAST(1 + 31 * i AS INT), 31) AS s FROM q, range(0, 3) r(i) WHERE 31 * i < length(sequence))
  SELECT name, CAST(i AS INT) AS word, list_sum([CAST(instr('ACGT', s[CAST(k AS INT)]) - 1 AS HUGEINT) * (CAST(1 AS HUGEINT) << CAST(2 * (length(s) - k) AS INT)) for k in range(1, length(s) + 1)])::BIGINT AS bits, sequence FROM w""")  # fmt: skip
def packed_sequences(spark, d):
    """Rows are dealt to all cores, as the parts' file is small for its work."""
    s = sequences(spark, d, 4 * spark.sparkContext.defaultParallelism).withColumn("w", encoding.packed_sequence("sequence"))
    s = s.withColumn("sequence", encoding.unpacked_sequence("w", F.length("sequence")))
    return s.select("name", F.posexplode_outer("w").alias("word", "bits"), "sequence").where("word IS NOT NULL")  # a plain posexplode has the words made before the dealing too


@query("sequence_checksums", _SEQ + "SELECT name, md5(sequence) AS md5, sha256(sequence) AS sha256 FROM q")
def sequence_checksums(spark, d):
    return sequences(spark, d).select("name", F.md5("sequence").alias("md5"), F.sha2("sequence", 256).alias("sha256"))


@query("string_parts", "WITH q AS (SELECT p_partkey, concat('/data/', p_brand, '/', replace(p_name, ' ', '.')) AS path, p_name FROM part) SELECT p_partkey, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN contains(replace(p_name, ' ', '.'), '.') THEN list_last(string_split(replace(p_name, ' ', '.'), '.')) ELSE '' END AS suffix, CASE WHEN len(string_split(p_name, 'e')) > 2 THEN length(string_split(p_name, 'e')[1]) + length(string_split(p_name, 'e')[2]) + 2 ELSE 0 END AS second_e FROM q")
def string_parts(spark, d):
    p = spark.read.parquet(f"{d.rstrip('/')}/part.parquet").select("p_partkey", "p_name", F.concat(F.lit("/data/"), "p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("."))).alias("path"))
    folder, name, suffix = encoding.file_parts("path")
    return p.select("p_partkey", folder.alias("folder"), name.alias("name"), suffix.alias("suffix"), encoding.nth_place("p_name", "e", 2).cast("long").alias("second_e"))


@query("model_criteria", "SELECT f, n, k, round(n * ln(f / n) + 2 * k, 6) AS aic, round(n * ln(f / n) + 2 * k + 2 * k * (k + 1) / CAST(n - k - 1 AS DOUBLE), 6) AS aicc, round(n * ln(f / n) + k * ln(n), 6) AS bic FROM (SELECT sum(o_totalprice) AS f, count(*) AS n, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS k FROM orders GROUP BY o_orderpriority)")
def model_criteria(spark, d):
    o = spark.read.parquet(f"{d.rstrip('/')}/orders.parquet").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("f"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderstatus").alias("k"))
    aic, aicc, bic = encoding.model_criteria("f", "n", "k")
    return o.select("f", "n", "k", F.round(aic, 6).alias("aic"), F.round(aicc, 6).alias("aicc"), F.round(bic, 6).alias("bic"))
