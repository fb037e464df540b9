"""The corpus pipeline: quality rules, language ID, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightloom.llm import langid, linededup, packing, quality, shingles
from freightloom.llm.common import fresh, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep; null, empty and very short texts go, repeated rows go or stay together, long
    texts are judged whole, an empty table stays empty."""
    return quality.judged(docs).where("kept").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labelled ones that aren't held out. Texts without
    a letter go; without labels all do. Repeated rows go or stay together, an empty table stays empty."""
    model = langid.fitted(docs, ~langid.held_out())
    return langid.identified(docs, model).where(~F.col("rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier passage; n_chars follows the text."""
    done = linededup.deduped(docs).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Documents link where the
    Jaccard similarity of their five-word shingles is 0.8 or more: SimHash links first, then those that three bits
    don't reach."""
    groups = shingles.grouped(docs)
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("key"), "print")
    first = groups.groupBy("group").agg(F.min(order).alias("first")).select("first.*")
    # The same plain keys for the join and for repeated rows, so that the texts are shuffled once.
    keys = [fresh(docs, c) for c in ("_null", "_key", "_print")]
    stay = written(first.select(F.col("last").alias(keys[0]), F.coalesce("key", F.lit(0)).alias(keys[1]), F.col("print").alias(keys[2])))
    rows = docs.withColumns(dict(zip(keys, (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64("text")))))
    return rows.join(stay.hint("merge"), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of all documents: a null or empty text is its end alone, long texts are cut, repeated rows
    are packed each, an empty table gives no pieces."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: Tokenizing and estimation aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
