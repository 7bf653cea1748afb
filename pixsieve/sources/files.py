"""Files as files: a sink that writes one file per name, staged and committed, and the folder that executors share.

Spark's own sinks name their files themselves. Here a row is (name, content); rows that follow each other under one name
make one file. A task writes into a staging folder of its own attempt. When all tasks are through, the files move to their
names; when one fails for good, the staging folder goes and the target is as it was. What a lost or repeated attempt left
behind is never moved. An overwrite clears the target only at that point. A driver that dies while files move leaves the
moved ones and no _SUCCESS; the next run replaces them.

Executors open the target by its URI (file, hdfs, s3, gs, abfs), as the driver's Hadoop settings qualify it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGING = "_staging-"
DONE = "_SUCCESS"
MOVERS = 16
#: Moves that one mover makes at once.
MOVES = 1 << 6


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI: without a scheme it lies on the cluster's default file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = p.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    return "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def shared_folder(spark: SparkSession) -> str:
    """A new folder name where all executors can write: under spark.checkpoint.dir, a temporary one only in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{qualified(spark, folder)}/files-{uuid.uuid4().hex}"


def checked_name(name: str | None) -> str:
    """A name below the target: no root, no way up, nothing hidden from a listing."""
    parts = name.split("/") if name else [""]
    if any(p in ("", ".", "..") or p[0] in "_." for p in parts):
        raise ValueError(f"not a file name below the target: {name!r}")
    return name


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class FileWriter(DataSourceArrowWriter):
    """Writes (name, content) batches of one task; commits or drops what all tasks have staged."""

    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite, self.job = target.rstrip("/"), overwrite, uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        system, base = fs.FileSystem.from_uri(self.target)
        return system, base, f"{base}/{STAGING}{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, _, staging = self._open()
        folder = f"{staging}/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        stream, current, begun, folders = None, None, set(), set()
        try:
            for batch in iterator:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                    if stream is None or name != current:
                        if stream is not None:
                            stream.close()
                        if checked_name(name) in begun:
                            raise ValueError(f"the rows of {name!r} do not follow each other")
                        begun.add(name)
                        place = f"{folder}/{name}"
                        above = place.rsplit("/", 1)[0]
                        if above not in folders:
                            system.create_dir(above, recursive=True)
                            folders.add(above)
                        stream, current = system.open_output_stream(place), name
                    if content.is_valid:
                        stream.write(content.as_buffer())
        finally:
            if stream is not None:
                stream.close()
        return Staged(folder, len(begun))

    def _staged(self, system: fs.FileSystem, messages: list[Staged | None]) -> Iterator[list[tuple[str, str]]]:
        """(place, name) of the files of one task after the other."""
        for message in messages:
            if message is not None and message.files:
                found = system.get_file_info(fs.FileSelector(message.folder, recursive=True))
                yield [(info.path, info.path[len(message.folder) + 1:]) for info in found if info.type == fs.FileType.File]

    def commit(self, messages: list[Staged | None]) -> None:
        """Looks through the tasks' files one task at a time: the driver keeps eight bytes a file, to find names of two tasks."""
        system, base, staging = self._open()
        hashes = [np.fromiter((hash(name) for _, name in moves), np.int64, len(moves)) for moves in self._staged(system, messages)]
        every = np.sort(np.concatenate([np.zeros(0, np.int64), *hashes]))
        del hashes
        doubtful = set(every[1:][every[1:] == every[:-1]].tolist())
        names = set()
        for moves in self._staged(system, messages) if doubtful else ():
            for name in (name for _, name in moves if hash(name) in doubtful):
                if name in names:  # Spark aborts the write
                    raise ValueError(f"two tasks wrote {name!r}")
                names.add(name)

        def moved(some: list[tuple[str, str]]) -> None:
            for place, name in some:
                system.move(place, f"{base}/{name}")

        system.create_dir(base, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(base)):
                if old.base_name != f"{STAGING}{self.job}":
                    (system.delete_dir if old.type == fs.FileType.Directory else system.delete_file)(old.path)
        with ThreadPoolExecutor(MOVERS) as pool:
            for moves in self._staged(system, messages):
                for above in sorted({f"{base}/{name}".rsplit("/", 1)[0] for _, name in moves}):
                    system.create_dir(above, recursive=True)
                list(pool.map(moved, (moves[at : at + MOVES] for at in range(0, len(moves), MOVES))))
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)
        with system.open_output_stream(f"{base}/{DONE}") as done:
            done.write(f"{len(every)} files\n".encode())

    def abort(self, messages: list[Staged | None]) -> None:
        system, _, staging = self._open()
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pixsieve_files"

    def schema(self) -> str:
        return "name STRING, content BINARY"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, target: str, overwrite: bool = False) -> None:
    """Rows (name, content) as files under target; a file is as many rows as follow each other in one task.

    Names may have folders; a name that leaves the target, begins with _ or . or is written by two tasks ends the
    write, and the target stays as it was. Without ``overwrite`` files of other names stay and those of the same name are
    replaced. No rows leave a target without files.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    rows.select(rows["name"].cast("string"), rows["content"].cast("binary")).write.format(FileSink.name()).mode(
        "overwrite" if overwrite else "append"
    ).save(qualified(spark, target))
