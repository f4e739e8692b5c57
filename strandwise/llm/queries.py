"""The registered queries: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import table
from .divergence import audit
from .exact_dedup import exact_dedup
from .language_id import identify, learn_languages
from .lm_score import lm_score
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack
from .quality import judge_quality, learn_quality
from .token_output import segment_digests, write_token_rows
from .topk import top_k
from .toxicity import learn_toxicity, score_toxicity
from .url_filter import UrlModel, filter_urls, labelled_urls
from .whitening import whiten

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def fold(doc_id: str, parts: int) -> F.Column:
    """Remainder of crc32(doc_id as text). It is null for a null id, whose row is neither learned from nor held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def held_out(doc_id: str, parts: int, remainder: int) -> F.Column:
    return F.coalesce(fold(doc_id, parts) == remainder, F.lit(False)).alias("held_out")


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs.where(fold("doc_id", 3) != 1))
    return identify(docs, model).select("doc_id", held_out("doc_id", 3, 1), "lang_pred", "score", "known", "recognised")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_digests(write_token_rows(table(spark, sf_dir, "documents"), vocabulary(), end_id=2))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score(table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
    return scored.select("doc_id", held_out("doc_id", 10, 0), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id", held_out("doc_id", 3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").alias("n_offending")
    )


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=(85, 100))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES, UrlModel.train(labelled_urls()))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_output": op4_token_output,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_exact_topk": op8_exact_topk,
    "op9_near_dedup": op9_near_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_quality_rules": op11_quality_rules,
    "op12_whitening": op12_whitening,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op6_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, md5(concat('mix', coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))) AS key,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
            FROM documents
        ),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (
            SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
                   2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total
            FROM s
        ),
        r AS (
            SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM w
        ),
        t AS (
            SELECT source, source_size,
                   least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM r WHERE level < cap / weight) * weight, cap)) AS target
            FROM r
        ),
        p AS (
            SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
                + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - start)))::BIGINT AS taken
        FROM p
    """,
    "op8_exact_topk": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
            FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, rank::INT AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
    """,
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents
        ),
        w AS (SELECT id, lang, source, unnest(t) AS term FROM d),
        k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
        l AS (SELECT DISTINCT lang FROM d),
        v AS (SELECT lang, count(term) AS v FROM l LEFT JOIN k USING (lang) GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT gn.lang, gn.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS p
            FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term
        ),
        q AS (
            SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2) // (any_value(total) + 2 * any_value(v)) AS q
            FROM p JOIN (SELECT lang, sum(total) AS total FROM gn GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term
        ),
        pair AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(any_value(f), 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (
                SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f
                FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
            ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
            GROUP BY ALL
        ),
        term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
            FROM (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM term)
        ) WHERE part = 'pair' OR rank <= 10
    """,
}
