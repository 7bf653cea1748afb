"""Many needles at once: a table of them becomes one automaton, and every content is walked once.

The automaton goes through a content piece by piece and keeps its state from one piece to the next, so needles across a
piece's end are found and no content is held as text as a whole. It reports every occurrence, nested and overlapping ones
too. The plan is the same for two needles and ten thousand; a table of more bytes than one automaton should hold is walked
slab by slab, one scan each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Needle bytes of one automaton: it has a node a byte at most, some 50 bytes each.
SLAB_BYTES = 1 << 20
#: Content that is turned into text at once, and hits that go on together.
PIECE = 1 << 20
HITS = 1 << 16


@lru_cache(maxsize=2)
def automaton(needles: tuple[bytes, ...]):
    """Over bytes as Latin-1 characters; a needle's value is its number and its length."""
    found = ahocorasick.Automaton()
    for i, n in enumerate(needles):
        found.add_word(n.decode("latin-1"), (i, len(n)))
    found.make_automaton()
    return found


def occurrences(needles: tuple[bytes, ...], content: memoryview) -> Iterator[tuple[int, int]]:
    """(number of the needle, place of its first byte) in the order of their last bytes."""
    if not needles:
        return
    walk = automaton(needles).iter("")
    for at in range(0, len(content), PIECE):
        walk.set(str(content[at : at + PIECE], "latin-1"), False)
        for last, (i, size) in walk:
            yield i, last - size + 1


def _walked(files: DataFrame, needles: tuple[bytes, ...], keep: tuple[str, ...]) -> DataFrame:
    names = ["path", *keep]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*names).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = pa.array(needles, pa.binary())
        for batch in batches:
            rows, numbers, places = [], [], []

            def hits() -> pa.RecordBatch:
                row = pa.array(np.array(rows, np.int64))
                columns = [batch.column(c).take(row) for c in range(len(names))]
                return pa.RecordBatch.from_arrays([*columns, every.take(pa.array(numbers, pa.int64())), pa.array(places, pa.int64())], names=[*names, "needle", "pos"])

            for row, content in enumerate(batch.column(len(names))):
                if not content.is_valid:
                    continue
                for number, place in occurrences(needles, memoryview(content.as_buffer())):
                    rows.append(row)
                    numbers.append(number)
                    places.append(place)
                    if len(rows) == HITS:
                        yield hits()
                        rows, numbers, places = [], [], []
            yield hits()

    return files.select(*names, F.col("content").cast("binary")).mapInArrow(run, ", ".join([*fields, "needle binary", "pos long"]))


def find_needles(files: DataFrame, needles: DataFrame, *keep: str) -> DataFrame:
    """All occurrences of all needles (a table with a column needle) in all files: path, keep..., needle, pos.

    Equal needles are one, whose owners a join by needle names; null and empty needles are nowhere; null contents hold none.
    The driver gets the needles of one slab at a time, SLAB_BYTES on average.
    """
    distinct = needles.select(F.col("needle").cast("binary").alias("needle")).where("length(needle) > 0").distinct()
    total = distinct.agg(F.sum(F.length("needle").cast("bigint"))).first()[0] or 0
    slabs = max(1, -(-total // SLAB_BYTES))
    found = []
    for slab in range(slabs):
        own = distinct.where(F.pmod(F.xxhash64("needle"), F.lit(slabs)) == slab).toArrow()["needle"].to_pylist()
        found.append(_walked(files, tuple(sorted(own)), keep))
    return reduce(DataFrame.unionByName, found)


def first_listed(texts: DataFrame, markers: DataFrame) -> DataFrame:
    """path and marker for texts (path, text) that hold any marker of a table (rank, marker): the one of lowest rank.

    Containment is case-sensitive; an empty marker is in no text. Of equal ranks the first by its bytes wins.
    """
    listed = markers.select("rank", "marker", F.encode("marker", "UTF-8").alias("needle"))
    hits = find_needles(texts.select("path", F.encode("text", "UTF-8").alias("content")), listed).select("path", "needle").distinct()
    return hits.join(listed, "needle").groupBy("path").agg(F.min(F.struct("rank", "marker"))["marker"].alias("marker"))
