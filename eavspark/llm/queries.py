"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eavspark.llm import embed_dedup, gif, langid, mixing, ngram_join, packing, quality, substring, token_store, warc
from eavspark.llm.shared import new_path, release


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path)
    release(spark)
    return token_store.digest(spark, path)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    release(spark)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.features(gif.store(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_langid": op2_langid,
    "op3_packing": op3_packing,
    "op4_embed_dedup": op4_embed_dedup,
    "op5_substring": op5_substring,
    "op6_quality": op6_quality,
    "op7_token_store": op7_token_store,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_gif": op10_gif,
    "pipeline": pipeline,
}

ORACLES = {
    "op1_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
        c AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY 1),
        k AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY 1)
        SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, doc_id = class_id AS kept FROM c LEFT JOIN k USING (doc_id)
    """,
    "op4_embed_dedup": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        f AS (SELECT r, vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v
              WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        u AS (SELECT r, vec_id, label, n, list_transform(e, lambda x: x / n) AS e FROM f WHERE n > 0),
        p AS (SELECT a.r AS a, b.r AS b, CASE WHEN len(a.e) = len(b.e) THEN list_inner_product(a.e, b.e) ELSE 0 END AS c FROM u a JOIN u b ON a.label = b.label AND a.r < b.r),
        l AS (SELECT a, b FROM p WHERE c >= 0.98),
        d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        w AS (SELECT r, r AS o FROM v UNION SELECT w.r, d.b FROM w JOIN d ON w.o = d.a),
        c AS (SELECT w.r, min(v.vec_id) AS component_id FROM w JOIN v ON w.o = v.r GROUP BY 1),
        k AS (SELECT a AS r, count(*) AS n FROM d GROUP BY 1)
        SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (r) LEFT JOIN k USING (r)
    """,
    "op9_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p),
        n AS (SELECT *, list_transform(range(0, 4), lambda k: CAST('0x' || hex[10 * k + 1:10 * k + 10] AS BIGINT)) AS parts FROM h)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               array_to_string(flatten(list_transform(parts, lambda v: list_transform(range(7, -1, -1), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((v >> CAST(5 * j AS INT)) & 31 AS INT) + 1]))), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM n
    """,
    "op8_mixing": r"""
        WITH d AS (
          SELECT row_number() OVER (ORDER BY doc_id) AS row_id, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
          FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, 2 * source_size AS cap FROM s),
        l AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
        v AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0))
                        / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
              FROM l WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size,
                     coalesce(least(CAST(cap AS DOUBLE), weight * (SELECT level FROM v WHERE level * weight <= cap ORDER BY ratio, source NULLS LAST LIMIT 1)), CAST(cap AS DOUBLE)) AS target
              FROM v),
        q AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (SELECT q.*, copy, CASE WHEN target > 0 THEN CAST(before + size + copy * source_size AS DOUBLE) / target ELSE 0 END AS finish
              FROM q, (VALUES (0), (1)) AS c(copy)),
        g AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, source NULLS FIRST, copy, shuffle, doc_id, row_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM p)
        SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
               CAST(sum(greatest(0, least(size, (SELECT CAST(floor(sum(target) + 1e-6) AS BIGINT) FROM t) - sent))) AS BIGINT) AS taken
        FROM g GROUP BY row_id, doc_id
    """,
}
