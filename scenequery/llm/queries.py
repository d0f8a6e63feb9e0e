"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenequery.llm import common


def op1_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequery.llm import warc

    return warc.report(common.table(common.session(spark), sf_dir, "pages"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequery.llm import katz

    return katz.report(common.table(common.session(spark), sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequery.llm import mixing

    return mixing.report(common.table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequery.llm import pii

    return pii.report(common.table(spark, sf_dir, "documents"))


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequery.llm import syncmers

    return syncmers.report(common.table(spark, sf_dir, "documents"))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequery.llm import line_chunks

    return line_chunks.report(common.table(spark, sf_dir, "documents"))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequery.llm import quality

    common.session(spark)
    return quality.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scenequery.llm import tokens

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    docs = common.table(common.session(spark), sf_dir, "documents")
    return tokens.read(tokens.write(docs, tokenizer, end_id=2))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequery.llm import minhash

    return minhash.report(common.table(common.session(spark), sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequery.llm import decontaminate

    common.session(spark)
    return decontaminate.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc_records, op2_katz, op3_mixing, op4_personal_data, op5_syncmers, op7_line_chunks, op6_quality_gam, op8_token_sequences, op9_near_duplicates, op10_decontaminate)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
     f AS (SELECT digest, n, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY ALL),
     r AS (SELECT p.*, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (digest, n))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
       CAST(CASE WHEN refers_to IS NULL THEN greatest(1, ceil(n / 65536.0)) ELSE 0 END AS INTEGER) AS n_chunks, true AS digest_ok FROM r
"""

NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
     e AS (SELECT i, j FROM c JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * m >= 80 * (x.n + y.n - m)),
     both_ways AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
     comp(v, label) USING KEY (v) AS (SELECT DISTINCT i, i FROM both_ways UNION SELECT b.i, min(k.label) FROM comp k JOIN both_ways b ON b.j = k.v JOIN recurring.comp o ON o.v = b.i WHERE k.label < o.label GROUP BY b.i)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(label, doc_id) AS component_id, coalesce(label, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp ON v = doc_id
"""

LEAK_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
     b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
     k AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
     o AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM k) l WHERE len(w) >= n)),
     h AS (SELECT doc_id, i, n, item FROM o JOIN k USING (s, n)),
     p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM h) GROUP BY doc_id),
     t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def oracle_sql() -> dict:
    """SQL says the contracts of these three plainly; the others' models, tokenizer and hashes it has not."""
    return {"op1_warc_records": WARC_SQL, "op9_near_duplicates": NEAR_SQL, "op10_decontaminate": LEAK_SQL}
