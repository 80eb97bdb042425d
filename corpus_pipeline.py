"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it back as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataport.llm.decontamination import decontaminate
from strataport.llm.language_id import identify
from strataport.llm.line_dedup import dedup_lines
from strataport.llm.ngram_join import join_ngrams
from strataport.llm.packing import pack
from strataport.llm.shared import mark, release, written

#: Below this pooled probability a text is in none of the learned languages.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay: those with ``und`` or a score under LEAST_SCORE go, and so do null and empty
    texts. Their lang column stays as it is."""
    out = identify(docs)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut from the texts (n_chars follows); documents of which no line is
    left go."""
    out = dedup_lines(docs)
    left = out.where(F.size("removed_lines") < F.greatest("n_lines", F.lit(1)))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the least id stays; documents with a null id stay. Rows of
    one id stay or go together."""
    gone = join_ngrams(docs).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a test item occurs go."""
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where(~F.col("contaminated")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs, keep=["doc_id"])


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language identification, the network in it and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage wrote on its way goes once its result is written."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since, (path,))
    return STAGES[-1][1](spark, docs, sf_dir)
