"""The queries that apply each operator to its whole table, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, exact_dedup, html_extraction, language, license_scan, mixing, near_dedup, packing, periodic_runs, sharding, token_counts, vector_codes, warc
from .common import finished, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _whole(spark: SparkSession, name: str, make) -> DataFrame:
    """The written result of an operator; the tables that it made on the way are removed."""
    with scratch(spark):
        return finished(make(), name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of host paths, a row a host, stays until the result has been read."""
    return html_extraction.extract(_table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, "op2_license_scan", lambda: license_scan.scan(_table(spark, sf_dir, "documents")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, "op3_mixing", lambda: mixing.mix(_table(spark, sf_dir, "documents")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, "op4_exact_dedup", lambda: exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, "op5_embedding_dedup", lambda: embedding_dedup.near_dedup(_table(spark, sf_dir, "embeddings")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store is the output and stays."""
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, "op7_warc", lambda: warc.archive(_table(spark, sf_dir, "pages")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, "op8_packing", lambda: packing.pack(_table(spark, sf_dir, "documents"), vocabulary()))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a row a language is written."""
    return language.identify(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, "op10_near_dedup", lambda: near_dedup.near_groups(_table(spark, sf_dir, "documents")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, "op11_vector_codes", lambda: vector_codes.compress(_table(spark, sf_dir, "embeddings")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is written on the way. Documents of a tenth of the ids are repeated in part first, as the query is defined."""
    return periodic_runs.digests(_table(spark, sf_dir, "documents"), periodic_runs.repeated)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is written on the way."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_html_extraction, op2_license_scan, op3_mixing, op4_exact_dedup, op5_embedding_dedup, op6_sharding, op7_warc, op8_packing, op9_language_id, op10_near_dedup, op11_vector_codes, op12_periodic_runs, op13_token_counts, pipeline)
}

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {s}) & 31 AS INT), 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)



def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Lloyd over distinct parts: c0 has the first codebooks, a the assignments of a round, s their sums, c the codebooks after it."""
    ok = "embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"
    steps = [
        f"v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings WHERE {ok})",
        f"p AS (SELECT r, vec_id, label, part, list_slice(e, part * (len(e) // {parts}) + 1, (part + 1) * (len(e) // {parts})) AS val FROM v, range({parts}) AS t(part))",
        "d AS (SELECT part, val, count(*) AS n FROM p GROUP BY part, val)",
        f"c0 AS (SELECT part, r - 1 AS k, val FROM p WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT d.part, d.val, d.n, min({{'e': CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(d.val, c.val)]) AS BIGINT), 'k': c.k}}) AS best
            FROM d JOIN c{i} c ON d.part = c.part GROUP BY d.part, d.val, d.n)""")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT part, best.k AS k, j, CAST(sum(n * val[j]) AS BIGINT) AS s, CAST(sum(n) AS BIGINT) AS m FROM (SELECT *, unnest(range(1, len(val) + 1)) AS j FROM a{i}) GROUP BY part, best.k, j)")
            steps.append(f"""c{i + 1} AS (SELECT c.part, c.k, coalesce(u.val, c.val) AS val FROM c{i} c LEFT JOIN
                (SELECT part, k, list((s - (s % m + m) % m) // m ORDER BY j) AS val FROM s{i} GROUP BY part, k) u ON u.part = c.part AND u.k = c.k)""")
    return f"""
        WITH {", ".join(steps)},
          books AS (SELECT sha256(string_agg(array_to_string(val, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM c{rounds}),
          w AS (SELECT r, vec_id, label, string_agg(printf('%02x', best.k), '' ORDER BY p.part) AS code, CAST(sum(best.e) AS BIGINT) AS error
                FROM p JOIN a{rounds} a ON a.part = p.part AND a.val = p.val GROUP BY r, vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM w, books
    """


ORACLE_SQL = {
    "op11_vector_codes": _codes_sql(),
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_embedding_dedup": """
        WITH RECURSIVE
          v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
                  AND len([x for x in embedding if x <> 0]) > 0),
          links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                    WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
          reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
          root AS (SELECT u, min(v) AS c FROM reach GROUP BY u),
          deg AS (SELECT u, count(*) AS n FROM links GROUP BY u)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, c AS component_id, e.vec_id = c AS kept
        FROM embeddings e JOIN root ON root.u = e.vec_id LEFT JOIN deg ON deg.u = e.vec_id
    """,
    "op7_warc": f"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h0 FROM pages),
             d AS (SELECT page_id, url, CAST(octet_length(encode(h0)) AS BIGINT) AS payload_bytes, sha1(h0) AS h,
                          max(page_id) OVER (PARTITION BY h0) AS first FROM p)
        SELECT page_id, url, payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to, true AS whole
        FROM d
    """,
}
