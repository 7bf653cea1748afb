"""Helpers of the corpus operators: tables cut off in the shared folder, block counts, whole-text columns."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixsieve.llm.words import powers

#: Text that one block (one group of documents handled together by one Python call) holds on average.
BLOCK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a temporary one only in local mode without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of df written as a table in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def block_count(docs: DataFrame, text: Column, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks so that one holds block_bytes of text on average: grows with the corpus, 1 at least."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def give_back() -> None:
    """Hands freed memory back to the system. Allocators keep it otherwise, and Spark keeps the workers: each one that waits
    would hold what its largest task took, beside the JVM and the workers of the next stages."""
    powers.cache_clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


Batches = Iterator[pa.RecordBatch]


def light(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task's function over batches that gives its memory back when it ends."""

    def own(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return own


def light_group(run: Callable) -> Callable:
    """The same for a function over a group."""

    def own(key, part):
        out = run(key, part)
        give_back()
        return out

    return own


def light_cogroup(run: Callable) -> Callable:
    """The same for a function over two groups of a key."""

    def own(key, left, right):
        out = run(key, left, right)
        give_back()
        return out

    return own


def remainder(id_name: str = "doc_id", n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_name).cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_key(text: Column) -> Column:
    """16 bytes that name a text: the first half of its SHA-256. The same in every evaluation, whatever deals the rows."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def row_key(id_name: str, text: Column) -> Column:
    """16 bytes that name a row's id and text; rows equal in both share it."""
    return text_key(F.concat(F.coalesce(F.col(id_name).cast("string"), F.lit("null")), F.lit("|"), text))


def one_row_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of those that share the key column, any: they are equal in id and text."""
    number = free_name(rows, "row_number")
    window = Window.partitionBy(key).orderBy(F.lit(0))
    return rows.withColumn(number, F.row_number().over(window)).where(F.col(number) == 1).drop(number)
