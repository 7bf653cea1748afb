"""The corpus pipeline: toxicity, near copies, benchmark decontamination, mixing, token files, each over whole tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixsieve.llm import decontaminate, mixing, nearcopies, tokens, toxicity
from pixsieve.llm.common import free_name, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Rows that a Python worker is handed at once, and the setting that says so: whole documents pass through, so fewer than
#: Spark's default. The first stage sets it for all that follow, since they run when their rows are written; run() sets it back.
BATCH_ROWS, SETTING = "2000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from the labels of these documents, does not reject."""
    spark.conf.set(SETTING, BATCH_ROWS)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return nearcopies.one_each(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix's training order, a document as often as the mix takes it."""
    return mixing.mix(docs).select(*COLUMNS)


def in_file_order(docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """The rows with the number of their file and their place in it: the order in which the stage before has written them. Rows
    that come from no files are numbered as they stand."""
    names = free_name(docs, "file_number"), free_name(docs, "file_row")
    number = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    try:
        placed = docs.withColumns({names[0]: number, names[1]: F.col("_metadata.row_index")})
    except AnalysisException:
        placed = docs.withColumns({names[0]: F.lit(0), names[1]: F.monotonically_increasing_id()})
    return placed, names


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document of the mix in its token files, which stand in the mix's training order."""
    placed, order = in_file_order(docs)
    return tokens.tokenised(placed, order=order)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written as Parquet and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(SETTING)
    try:
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(SETTING, before)


#: No SQL: toxicity is a trained model and near copies are a similarity join.
ORACLE_SQL = None
