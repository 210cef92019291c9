"""The queries opN_<name>: thin wrappers with production parameters over whole tables, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import backoff_lm, norm_kmeans, prefix_bpe, source_divergence
from ledgerloom.llm.avi_clips import media_digests
from ledgerloom.llm.best_fit_pack import pack
from ledgerloom.llm.common import documents
from ledgerloom.llm.fair_mix import taken_words
from ledgerloom.llm.fair_toxicity import toxicity
from ledgerloom.llm.fuzzy_lines import line_classes
from ledgerloom.llm.lpt_shards import shard
from ledgerloom.llm.lsm_dedup import exact_dedup
from ledgerloom.llm.ranked_ids import ranked_ids
from ledgerloom.llm.simhash_golay import simhash_components

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_fair_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def op2_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, documents(spark, sf_dir), shards=8)


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark, documents(spark, sf_dir), words=4, bits=4).select("doc_id", "fingerprint", "component_id")


def op5_lsm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, documents(spark, sf_dir), keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(spark, documents(spark, sf_dir))


def op6_ranked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_ids(spark, documents(spark, sf_dir), WORD_TOKENIZER)


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(spark, documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, repeats=2)


def op8_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(spark, documents(spark, sf_dir), order=3, smoothing=4.0)


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(spark, documents(spark, sf_dir)).drop("row")


def op10_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir), BYTE_TOKENIZER, capacity=1024)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(spark, documents(spark, sf_dir), least=3, top=200)


def op12_norm_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_kmeans.cluster(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, dims=64, scale=256, seed="2")


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.round_trip(spark, documents(spark, sf_dir), BYTE_TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fair_toxicity": op1_fair_toxicity,
    "op2_lpt_shards": op2_lpt_shards,
    "op3_avi_clips": op3_avi_clips,
    "op4_simhash_golay": op4_simhash_golay,
    "op5_lsm_dedup": op5_lsm_dedup,
    "op6_ranked_ids": op6_ranked_ids,
    "op7_fair_mix": op7_fair_mix,
    "op8_backoff_lm": op8_backoff_lm,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_best_fit_pack": op10_best_fit_pack,
    "op11_source_divergence": op11_source_divergence,
    "op12_norm_kmeans": op12_norm_kmeans,
    "op13_prefix_bpe": op13_prefix_bpe,
    "pipeline": corpus_pipeline.run,
}


def kmeans_sql(rounds: int) -> str:
    """The rounds of op12 written out, one step a table."""
    nearest = """
        a{0} AS MATERIALIZED (
            SELECT any_value(v.vec_id) AS vec_id, any_value(v.q) AS q, min(list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))) * 64 + c.cluster) AS m
            FROM v CROSS JOIN c{0} c GROUP BY v.n)"""
    move = """
        c{1} AS MATERIALIZED (
            SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{0} c LEFT JOIN (
                SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q
                FROM (SELECT m % 64 AS cluster, i, sum(q[i]) AS s, count(*) AS n FROM a{0} CROSS JOIN range(1, 65) t(i) GROUP BY ALL) GROUP BY cluster) m USING (cluster))"""
    steps = [x for r in range(rounds) for x in (nearest.format(r), move.format(r, r + 1))] + [nearest.format(rounds)]
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, q FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40),
        {",".join(steps)}
        SELECT a.vec_id, (a.m % 64)::INT AS cluster, (a.m // 64)::BIGINT AS distance, (sum(a.m // 64) OVER (PARTITION BY a.m % 64))::BIGINT AS cluster_inertia, (sum(a.m // 64) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.m % 64"""


#: SQL can't express the others within reason: they are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op5_lsm_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)
    """,
    "op11_source_divergence": """
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
            FROM documents),
        w AS MATERIALIZED (SELECT n, lang, source, unnest(terms) AS term FROM d),
        kept AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY lang, term HAVING count(DISTINCT n) >= 3),
        langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS total FROM kept GROUP BY lang),
        own AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN own USING (lang, source) GROUP BY ALL),
        p AS MATERIALIZED (
            SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 1)) // (g.total + l.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 1)) // (l.total + l.v) AS q
            FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
        r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r
        QUALIFY part = 'pair' OR rank <= 200
    """,
    "op12_norm_kmeans": kmeans_sql(rounds=5),
}
