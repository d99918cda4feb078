"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import table


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tapeworks.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm import quality

    docs = table(spark, sf_dir, "documents")
    space = quality.learn(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    scored = quality.with_quality(docs, space, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.mixing import TARGETS, mixed

    return mixed(table(spark, sf_dir, "documents"), TARGETS).select("doc_id", "source", "mix_block", "mix_slot", "mix_place")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.html import extract

    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.avi import with_features, with_media

    return with_features(with_media(table(spark, sf_dir, "documents"), keep=["doc_id"]), keep=["doc_id", "n_bytes"])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.with_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.decontaminate import leak_report

    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.urls import RULES, UrlModel, judge, labelled_urls

    return judge(table(spark, sf_dir, "pages"), RULES, UrlModel(labelled_urls(spark)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.warc import archive, dealt, read_records

    return read_records(dealt(archive(table(spark, sf_dir, "pages"))), payloads=False).drop("html", "url")


QUERIES = {"op1_quality": op1_quality, "op2_mixing": op2_mixing, "op3_html_text": op3_html_text, "op4_avi_media": op4_avi_media, "op5_near_duplicates": op5_near_duplicates, "op6_token_counts": op6_token_counts, "op7_toxicity": op7_toxicity, "op8_decontamination": op8_decontamination, "op9_url_filter": op9_url_filter, "op10_warc": op10_warc}

_DOC_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_DOC_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_DOC_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, w[k:k + least(len(w), 10) - 1] AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(x) AS n FROM iw),
dw AS (
  SELECT r, k, n, w[k:k + n - 1] AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, k, n, item_id FROM dw JOIN iw USING (x)),
per AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM hits) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN per USING (r) LEFT JOIN names USING (r)""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS newest FROM q WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN newest IS NULL OR page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM q LEFT JOIN g USING (payload_digest)""",
}
