"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import decontaminate, lang_id, line_dedup, mixing, simhash
from helixlake.llm.common import table, write_shared

MIN_LANGUAGE_SCORE = 0.5
#: Documents are long: fewer go to Python at once than Spark would send, which bounds what tasks hold besides the heap.
BATCH_ROWS = "2000"
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(stage):
    """A stage that has its session send BATCH_ROWS rows to Python at once."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(_BATCHES, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@in_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language more likely than all others together, go."""
    seen = lang_id.identify(docs)
    return seen.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


@in_batches
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but one; n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


@in_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles have a Jaccard similarity of 0.8 or more the smallest doc_id stays."""
    return simhash.drop_similar(docs, words=5, similarity=0.8).select(*docs.columns)


@in_batches
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


@in_batches
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mix of sources."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID and decontamination can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None
