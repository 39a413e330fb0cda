"""The queries of this subpackage, each an operator over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parlance.llm.byte_bpe import coding_digests
from parlance.llm.chat_format import DIGESTS_SQL, chat_digests
from parlance.llm.jaccard_join import jaccard_components
from parlance.llm.lexical_search import SEARCH_SQL, search
from parlance.llm.line_crf import quality
from parlance.llm.mixing import mixture_report
from parlance.llm.ngram_lm import lm_scores
from parlance.llm.order_minhash import fingerprints
from parlance.llm.packing import pack_documents
from parlance.llm.suffix_dedup import removal_digests
from parlance.llm.toxicity import toxicity
from parlance.llm.vector_codes import CODES_SQL, code_digests
from parlance.llm.vp_search import vector_neighbours


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_read(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_read(spark, sf_dir, "documents"))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(_read(spark, sf_dir, "conversations"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(_read(spark, sf_dir, "documents"))


def op7_vp_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neighbours(_read(spark, sf_dir, "embeddings"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(_read(spark, sf_dir, "documents"))


def op10_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digests(_read(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_lm,
        op2_order_minhash,
        op3_toxicity_chain,
        op4_ngram_jaccard_join,
        op5_chat_format,
        op6_suffix_array_dedup,
        op7_vp_tree_neighbours,
        op8_best_fit_packing,
        op9_source_mixing,
        op10_line_crf_quality,
        op11_vector_codes,
        op12_byte_bpe,
        op13_lexical_search,
    )
}

#: DuckDB SQL of those queries that SQL can express over whole tables.
ORACLES = {
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(list_slice(w, i, i + 4), ' ') ELSE array_to_string(w, ' ') END AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id WHERE r.low < e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.low), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op5_chat_format": DIGESTS_SQL,
    "op7_vp_tree_neighbours": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
    AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) t
WHERE rank <= 5
""",
    "op11_vector_codes": CODES_SQL,
    "op13_lexical_search": SEARCH_SQL,
}
