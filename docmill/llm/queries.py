"""The query of each operator over its whole table, and the SQL that says what it returns, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, dedup, linededup, neardup, packing, ppm, quality, toxicity, transducer
from .common import documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(documents(spark, sf_dir))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(documents(spark, sf_dir), width=4)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(documents(spark, sf_dir))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_exact_dedup, op3_minhash_near_dedup, op4_quality, op5_toxicity, op6_token_counts, op7_byte_bpe, op8_line_dedup, op9_nearest_neighbours, op10_lm_scores)}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLES = {
    "op3_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
        g AS (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY 1, 2),
        e AS (SELECT rep, n, unnest(s) AS x FROM g),
        p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        r AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
        c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
        SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(c.root, g.rep, d.doc_id) AS component_id, d.doc_id = coalesce(c.root, g.rep, d.doc_id) AS kept
        FROM s d LEFT JOIN g ON g.s = list_sort(d.s) LEFT JOIN c ON c.node = g.rep
    """,
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.t) AS text_sha256 FROM t JOIN g ON t.t = g.t
    """,
}
