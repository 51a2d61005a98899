"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_middle, html_wrapper, impact_search, mixing, secret_scan, sentencepiece_codec, simhash_dedup, substring_dedup, toxicity, vector_codes, vector_dedup, vector_search, wavelet_output


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is on this machine; executors hold it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_report(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_text(_table(spark, sf_dir, "pages"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_output.token_output(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.linked_vectors(_table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compression_report(_table(spark, sf_dir, "embeddings"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_report(_table(spark, sf_dir, "documents"))


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_sentencepiece, op2_html_text, op3_token_output, op4_vector_search, op5_vector_dedup, op6_substring_dedup, op7_toxicity, op8_secret_scan, op9_simhash_dedup, op10_mixing, op11_vector_codes, op12_fill_middle, op13_impact_search)
    return {f.__name__: f for f in made}


#: Exact links by comparing all pairs of a label, and their components.
OP5_SQL = """WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component FROM r GROUP BY a),
n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, component AS component_id, vec_id = component AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a"""

#: Windows of 35 words compared as text.
OP6_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, list_aggregate(w[i:i + 34], 'string_agg', ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
r AS (SELECT s FROM x GROUP BY s HAVING count(*) > 1),
m AS (SELECT DISTINCT doc_id, i + k AS i FROM x JOIN r USING (s), range(35) AS o(k)),
g AS (SELECT doc_id, list(i) AS gone FROM m GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(list_aggregate(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), 'string_agg', ' '), '')) AS kept_sha256
FROM k"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_vector_dedup": OP5_SQL,
        "op6_substring_dedup": OP6_SQL,
        "op8_secret_scan": secret_scan.oracle_sql(),
        "op10_mixing": mixing.oracle_sql(),
        "op11_vector_codes": vector_codes.oracle_sql(),
        "op12_fill_middle": fill_middle.oracle_sql(),
        "op13_impact_search": impact_search.oracle_sql(),
    }
