"""Directory listing and file admission."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixsieve.running import SPAN, running
from pixsieve.sources.files import qualified, shared_folder

EXTENSIONS = (".jpg", ".jpeg")
MAX_FILE = 0xFFFFFFFF
#: File systems that tasks open by themselves, as the sink of files does.
OPENED = ("file", "hdfs", "s3", "gs", "abfs")
#: Files of one task and bytes of them, on average.
TASK_FILES, TASK_BYTES = 1 << 12, 1 << 25


def _glob(exts: Sequence[str]) -> str:
    """Case-insensitive glob, so that the listing itself drops other files."""
    def fold(e: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)

    return "{" + ",".join(f"*{fold(e)}" for e in exts) + "}"


def read_files(
    spark: SparkSession, root: str, *, recursive: bool = False, exts: Sequence[str] = EXTENSIONS, extract_all: bool = False,
    with_empty: bool = True,
) -> DataFrame:
    """path, modificationTime, length, content of a directory; select without content to skip reading it.

    The directory is listed once, on whatever file system the root names (without a scheme: the cluster's default one).
    ``recursive`` folders are listed level by level and read by tasks, so that the driver holds no file's name, where tasks can
    open the file system (``OPENED``); one task lists one folder. Else Spark's binary source lists and reads, and the driver
    holds the listing. That source leaves out files of zero bytes, which a batch has to report; ``with_empty`` adds them,
    without their time.
    """
    if recursive and (place := _folder(spark, root)):
        return _read_tree(spark, *place, None if extract_all else tuple(exts), with_empty)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if not extract_all:
        reader = reader.option("pathGlobFilter", _glob(exts))
    files = reader.load(root)
    if not with_empty:
        return files
    empty = listed(files).join(files.select("path"), "path", "left_anti")
    return files.unionByName(empty.select(
        "path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content")))


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def _folder(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """URI of a folder that tasks can open and its path as Spark's sources write it; none for single files, patterns and other systems."""
    uri = qualified(spark, root).rstrip("/")
    if uri.split(":", 1)[0] not in OPENED or re.search(r"[*?{}\[\]\\]", uri):
        return None
    system, base = _opened(uri)
    if system.get_file_info(base).type != fs.FileType.Directory:
        return None
    return uri, "file:" + base if uri.startswith("file:") else uri


def _hidden(name: str) -> bool:
    """Names that Spark's listing passes over."""
    kept = name.startswith(("_common_metadata", "_metadata"))
    return not kept and (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _read_tree(spark: SparkSession, uri: str, shown: str, exts: Sequence[str] | None, with_empty: bool) -> DataFrame:
    """The files below a folder: each level of folders is listed by tasks into a table, whose folders are the next level."""
    base = _opened(uri)[1]
    ends = None if exts is None else tuple(e.lower() for e in exts)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _opened(uri)[0]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [i for i in system.get_file_info(fs.FileSelector(base + folder)) if i.type in (fs.FileType.File, fs.FileType.Directory) and not _hidden(i.base_name)]
                found = [i for i in found if i.type == fs.FileType.Directory or ends is None or i.base_name.lower().endswith(ends)]
                for at in range(0, len(found), TASK_FILES):
                    some = found[at : at + TASK_FILES]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([i.path[len(base):] for i in some], pa.string()), pa.array([i.type == fs.FileType.Directory for i in some], pa.bool_()),
                        pa.array([i.mtime for i in some], pa.timestamp("us", "UTC")), pa.array([i.size or 0 for i in some], pa.int64()),
                    ], names=["name", "folder", "modificationTime", "length"])

    def contents(names: pa.Array) -> pa.Array:
        system = _opened(uri)[0]

        def read(name: str) -> bytes:
            with system.open_input_stream(base + name) as stream:
                return stream.read()

        return pa.array([read(n) for n in names.to_pylist()], pa.binary())

    contents.__annotations__ = {"names": pa.Array, "return": pa.Array}
    table, level, folders = shared_folder(spark), 0, spark.range(1).select(F.lit("").alias("name"))
    while level == 0 or not folders.isEmpty():
        tasks = max(1, min(folders.count(), spark.sparkContext.defaultParallelism * 4))
        place = f"{table}/level={level}"
        folders.repartition(tasks).mapInArrow(entries, "name string, folder boolean, modificationTime timestamp, length long").write.parquet(place)
        folders, level = spark.read.parquet(place).where("folder").select("name"), level + 1
    found = spark.read.parquet(table).where("NOT folder")
    if not with_empty:
        found = found.where("length > 0")
    size = found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    dealt = found.repartition(max(1, -(-size.files // TASK_FILES), -(-size.bytes // TASK_BYTES)))
    read = F.arrow_udf(contents, "binary")
    return dealt.select(
        F.concat(F.lit(shown), "name").alias("path"), F.when(F.col("length") > 0, F.col("modificationTime")).alias("modificationTime"), "length",
        read("name").alias("content"))


def listed(files: DataFrame) -> DataFrame:
    """path of every file that a file source has listed, empty ones too; the listing stays in the JVM, where Spark holds it anyway."""
    spark = files.sparkSession
    strings = spark._jvm.org.apache.hadoop.util.StringUtils
    # the way from an array to a list that needs no call per name; URLs hold no line ends
    paths = strings.getStringCollection(strings.join("\n", files._jdf.inputFiles()), "\n")
    names = DataFrame(spark._jsparkSession.createDataset(paths, spark._jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    # a listing gives names as URLs, the binary source plain ones, without an empty authority; a plus sign stands for itself
    plain = F.regexp_replace("value", r"^([A-Za-z][\w+.-]*):///", "$1:/")
    return names.select(F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))).alias("path"))


def plan_batch(
    files: DataFrame, root: str, dst_root: str, *, recursive: bool = True, exts: Sequence[str] = EXTENSIONS, extract_all: bool = False
) -> DataFrame:
    """Admitted files with their output and report paths: path, dst_path, log_path.

    Extensions are compared without case; extracting from everything switches that filter off.
    """
    rel = F.substring(F.col("path"), len(root) + 2, 1 << 30)
    picked = files.where(F.startswith("path", F.lit(root + "/"))).withColumn("__rel", rel)
    if not recursive:
        picked = picked.where(~F.contains("__rel", F.lit("/")))
    if not extract_all:
        ext = F.lower(F.regexp_extract("__rel", r"(\.[^./]*)$", 1))
        picked = picked.where(ext.isin([e.lower() for e in exts]))
    dst = F.concat(F.lit(dst_root + "/"), F.col("__rel"))
    return picked.withColumns({"dst_path": dst, "log_path": F.concat(dst, F.lit(".txt"))}).drop("__rel")


def size_status(length: Column) -> Column:
    return F.when(length == 0, "empty").when(length > MAX_FILE, "too_large").otherwise("ok")


def batch_progress(files: DataFrame, order: str, span: int = SPAN) -> DataFrame:
    """Add i, n and percent in the order of an integer file number; no task sees the whole list."""
    whole = files.withColumn("__all", F.lit(0))
    at = running(whole, ["__all"], order, {"i": ("sum", F.lit(1).cast("bigint"))}, span=span).drop("__all")
    # the total is the index of the last file: one row, read off the numbered rows
    last = at.groupBy(F.lit(0).alias("__one")).agg(F.max("i").alias("n"))
    return at.withColumn("__one", F.lit(0)).join(F.broadcast(last), "__one").drop("__one").withColumn("percent", F.col("i") * 100.0 / F.col("n"))
