"""Corpus pipeline over ``documents``: from raw texts to packed sequences.

STAGES names the stages in their order.  Each function takes (spark, docs,
sf_dir) and returns a DataFrame: the columns of its input, all but the last
stage, which returns the pieces of packed sequences.  ``run`` writes each
stage's rows to the shared checkpoint folder and reads them for the next, so a
lost executor costs no finished stage.

Defined results, besides those of the operators: an empty table passes through
all stages; rows that repeat an id and its text count as one from the third
stage on, rows that repeat an id with unlike texts stay; a row with a null doc_id
cannot be told from others by a group and stays; a text of which nothing is
left stays as an empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tavola.llm import language, ngram_join, packing, quality, repeats
from tavola.llm.common import prepare, read_table, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
NEAR_WORDS, NEAR_PERCENT = 5, 80    # near-duplicates: shingles of five words, similarity 0.8
PASSAGE_BYTES = 200                 # repeated passages, below the length of 50 words


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not told clearly."""
    prepare(spark)
    model = language.fit(docs.select("text", "lang"))
    told = docs.withColumn("_language", language.predict(F.col("text"), model))
    return told.where("NOT _language.rejected").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail, or whose host fails, the quality rules."""
    prepare(spark)
    verdicts = quality.host_verdicts(quality.with_counts(docs.select("source", "text")).drop("text"))
    judged = quality.judge(quality.with_counts(docs), verdicts)
    return judged.where("kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id and text hash, of each group of
    near-duplicates; rows of one id and different texts are different documents."""
    prepare(spark)
    version = F.xxhash64("text")
    classes = ngram_join.connect(docs.select("doc_id", "text", version.alias("version")),
                                 words=NEAR_WORDS, percent=NEAR_PERCENT, version="version")
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("version") == F.col("component_version"))
    stay = written(classes.where(first).select(F.col("doc_id").alias("_stay"), F.col("version").alias("_version"))
                   .distinct(), "stay")
    one = Window.partitionBy("doc_id", version).orderBy("source", "lang")
    kept = (docs.join(stay, (F.col("doc_id") == F.col("_stay")) & (version == F.col("_version")), "left_semi")
            .withColumn("_row", F.row_number().over(one)).where("_row = 1"))
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that stand more than once in the corpus."""
    prepare(spark)
    cut = repeats.remove_repeats(docs, length=PASSAGE_BYTES)
    text = F.when(F.col("n_removed") > 0, repeats.readable(F.col("kept"))).otherwise(F.col("text"))
    return (cut.withColumn("text", text)
            .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                        .otherwise(F.col("n_chars"))).select(*docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    prepare(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("ngram_join", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
