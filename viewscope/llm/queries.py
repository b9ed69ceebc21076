"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from viewscope.llm import (
    collision_hash, fill_middle, filter_audit, jaccard_join, langid, license_scan, mtree, packing, quality,
    sentencepiece_bpe, suffix_dedup, tokenfiles, url_rules,
)
from viewscope.llm.common import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register
def op2_mtree(spark, sf_dir):
    return mtree.top_inner_products(table(spark, sf_dir, "embeddings"))


ORACLES["op2_mtree"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20"""


@register
def op3_quality(spark, sf_dir):
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op4_sentencepiece(spark, sf_dir):
    return sentencepiece_bpe.encode_digests(table(spark, sf_dir, "documents"))


@register
def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@register
def op6_token_files(spark, sf_dir):
    return tokenfiles.token_files(table(spark, sf_dir, "documents"))


@register
def op7_language(spark, sf_dir):
    return langid.predict_languages(table(spark, sf_dir, "documents"))


@register
def op8_collision_hash(spark, sf_dir):
    return collision_hash.nearest_vectors(table(spark, sf_dir, "embeddings"))


@register
def op9_ngram_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op10_url_rules(spark, sf_dir):
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


@register
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = filter_audit.ORACLE


@register
def op12_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


ORACLES["op12_license_scan"] = license_scan.ORACLE


@register
def op13_fill_middle(spark, sf_dir):
    return fill_middle.fill_in_middle_digests(table(spark, sf_dir, "documents"))


ORACLES["op13_fill_middle"] = fill_middle.ORACLE
