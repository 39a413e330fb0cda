"""A training corpus from raw documents: toxic ones go, near copies and repeated passages go, sources are mixed and packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; what it returns is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import mixing, packing, shared, suffix_dedup, toxicity
from parlance.llm.jaccard_join import jaccard_components


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject; it learns from those labelled rows that docs still has.

    Every row is judged by its own text, repeated ones alike; null and empty texts have none of the chain's features. A
    null doc_id is judged, but not learnt from. All columns stay; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; of rows with its doc_id and text, the one that
    comes first by its other columns (in their order, null first).

    Rows without a doc_id can't be named as a group's document, and stay. A doc_id with different texts stays with all of
    them if one of them is a group's document. Null and empty texts are groups of their own. An empty table stays empty.
    """
    groups, name = jaccard_components(docs), shared.namer(docs.columns)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias(name("stay"))).distinct()
    named = docs.where("doc_id is not null").join(stay, F.col("doc_id") == F.col(name("stay")), "left_semi")
    # By aggregation, so that a row that is there very often is one before it is shuffled.
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias(name("first"))
    once = named.groupBy("doc_id", "text").agg(first) if rest else named.distinct()
    once = once.select(*(F.col(c) if c in ("doc_id", "text") else F.col(name("first"))[c].alias(c) for c in docs.columns))
    return once.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings that earlier ones (or they themselves) have already; one that loses its whole text goes."""
    had = shared.namer(docs.columns)("had")
    out = suffix_dedup.remove_repeats(docs.withColumn(had, F.coalesce(F.length("text") > 0, F.lit(False))))
    out = out.where(~F.col(had) | (F.length("text") > 0)).drop(had)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, each as often as the mix takes it; see mixing.mixed_documents() for nulls, ties and repeated rows."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; see packing.pack_documents() for nulls, ties and repeated rows."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no classifier chain; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.table(docs, name)
    return docs
