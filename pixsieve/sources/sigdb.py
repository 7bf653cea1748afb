"""Versioned user signature tables: load and store.

A stored table is a folder of snapshots and a pointer to the one that counts. A store writes a new snapshot and then
switches the pointer by one rename, so a table may be stored to the place it was read from, and a store that dies leaves
the table as it was. Files of the older binary kind are read by a walk and become rows like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixsieve.operators import walks
from pixsieve.sources.files import qualified

KNOWN_VERSIONS = ("01", "02", "03")
FIELDS = ("sig_id", "editor_class", "make", "model", "quality", "csig", "csig_rot", "subsampling", "sw_trim", "sw_disp")


def load_versions(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Union user tables by file version; unknown versions are rejected.

    Version 01 has no rotated signature, so that column is filled with an empty string. All other
    text columns that a version lacks become empty strings too.
    """
    known = [df.withColumn("version", F.lit(v)) for v, df in sorted(parts.items()) if v in KNOWN_VERSIONS]
    if not known:
        raise ValueError(f"no readable table version among {sorted(parts)}")
    out = known[0]
    for df in known[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    text = [c for c in FIELDS if c in out.columns and c not in ("sig_id",)]
    missing = [F.lit("").alias(c) for c in FIELDS if c not in out.columns]
    return out.select(
        "sig_id", "version", F.lit(True).alias("valid"), *[F.coalesce(c, F.lit("")).alias(c) for c in text], *missing
    )


def storable(sigs: DataFrame) -> DataFrame:
    """User rows that a store keeps: the valid ones."""
    return sigs.where(F.col("is_user") & F.col("valid"))


POINTER = "_CURRENT"
SNAPSHOT = "snapshot-"
#: Editor classes by their number in a binary table: fixed values of the format.
EDITORS = ("unset", "camera", "software", "unsure")


def _system(spark: SparkSession, target: str):
    """Hadoop's file context of a table's folder, and the folder."""
    jvm, folder = spark._jvm, qualified(spark, target.rstrip("/"))
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()), folder


def current(spark: SparkSession, target: str) -> str | None:
    """The folder of the snapshot that counts, None where nothing was stored yet."""
    jvm, system, folder = _system(spark, target)
    pointer = jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}")
    if not system.util().exists(pointer):
        return None
    stream = system.open(pointer)
    try:
        name = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()
    return f"{folder}/{name}"


def load(spark: SparkSession, target: str) -> DataFrame:
    """The rows of the current snapshot. Later stores don't change a table that is loaded, as long as they keep its snapshot."""
    place = current(spark, target)
    if place is None:
        raise ValueError(f"no signature table was stored in {target}")
    return spark.read.parquet(place)


def store(sigs: DataFrame, target: str, kept: int = 2) -> None:
    """The valid user rows as the table's new snapshot, also where ``sigs`` is read from the one before.

    Of older snapshots the last ``kept`` stay, for those that still read them.
    """
    spark = sigs.sparkSession
    folder = _system(spark, target)[2]
    before = current(spark, target)
    number = int(before.rsplit(SNAPSHOT, 1)[1].split("-")[0]) + 1 if before else 0
    name = f"{SNAPSHOT}{number:010d}-{uuid.uuid4().hex}"
    storable(sigs).write.parquet(f"{folder}/{name}")
    _switch(spark, folder, name)
    _prune(spark, folder, name, kept)


def _switch(spark: SparkSession, folder: str, name: str) -> None:
    """Writes the pointer beside the old one and renames it over that in one step."""
    jvm, system, _ = _system(spark, folder)
    new, pointer = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}") for x in (f"{POINTER}-{uuid.uuid4().hex}", POINTER))
    stream = new.getFileSystem(spark._jsc.hadoopConfiguration()).create(new)
    try:
        stream.write(name.encode())
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    system.rename(new, pointer, over)


def _prune(spark: SparkSession, folder: str, name: str, kept: int) -> None:
    jvm, system, _ = _system(spark, folder)
    found = system.util().listStatus(jvm.org.apache.hadoop.fs.Path(folder))
    older = sorted(s.getPath().getName() for s in found if s.getPath().getName().startswith(SNAPSHOT) and s.getPath().getName() < name)
    for old in older[: max(0, len(older) - kept)]:
        system.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}"), True)


def read_binary(files: DataFrame, header: str) -> DataFrame:
    """Rows of binary tables (path, content) that begin with this header text: path, version, seq, valid and the fields.

    A record at which the file breaks off is not valid.
    """
    records = walks.signature_records(F.col("content"), F.lit(header), F.lit(",".join(KNOWN_VERSIONS)))
    rows = files.select("path", F.explode(records).alias("r")).select("path", "r.*")
    name = F.coalesce(F.get(F.array(*map(F.lit, EDITORS)), F.col("editor")), F.lit("unset"))
    fields = [c for c in FIELDS if c not in ("sig_id", "editor_class")]
    return rows.select("path", "version", "seq", F.col("complete").alias("valid"), name.alias("editor_class"), *fields)
