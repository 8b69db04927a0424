"""Text preparation from documents to packed sequences, one Spark stage after the other.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut
from lithoframe.llm import language, mixing, ngram_join, packing, toxicity
from lithoframe.llm.common import remainder, table

#: SQL can't express compression, trained weights or tokenizers; the tests hold each stage against brute force.
ORACLE_SQL = None

#: Texts are read, and handed to Python, a few megabytes at a time instead of thousands of rows, whatever their length.
FEW_AT_A_TIME = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def few_at_a_time(stage: Callable) -> Callable:
    """The stage in a session set to small batches; they are used when its result is written, so they stay set. What the caller has set stays."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in FEW_AT_A_TIME.items():
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    return run


@few_at_a_time
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart clearly."""
    model = language.learn(docs, remainder("doc_id", 4) != 2)
    found = language.identify(docs, model, prefix="_language_")
    return found.filter(~F.col("_language_rejected")).select(docs.columns)


@few_at_a_time
def inoffensive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    found = toxicity.score(docs, toxicity.learn(docs, labels), prefix="_toxicity_")
    return found.filter(F.col("_toxicity_predicted") == 0).select(docs.columns)


@few_at_a_time
def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return ngram_join.first_of_each(docs)


@few_at_a_time
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    drawn = mixing.mix(docs, prefix="_mix_")
    return drawn.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("_mix_copies")))).select(docs.columns)


@few_at_a_time
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs)


STAGES = [("language_id", identified), ("toxicity", inoffensive), ("ngram_join", different), ("pareto_mix", mixed),
          ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
