"""Byte patches over files, as disjoint winning segments.

Every patch covers [start, start + length) of its file; where patches overlap, the highest ordinal wins. A sweep over the
patches' edges keeps the covering ones in a heap and gives the segments of which one patch wins every byte, so the cost
goes by the number of patches, not by their bytes. The sweep sees numbers only, and a file's patches span by span, so that
neither long patches nor a much patched file meet in one task; the winners then fetch their bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixsieve.bitmaps import may_hold

#: Bytes of a file whose patches are swept together.
SPAN = 1 << 24
SEGMENTS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("begin", "stop", "start", "ordinal", "size")]))


def sweep(patches: list[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(begin, stop, start, ordinal, size) of patches, cut to a span, to the disjoint segments that they win, in order.

    Of equal ordinals the patch that starts last wins, then the longest.
    """
    edges = sorted({e for begin, stop, *_ in patches for e in (begin, stop)})
    coming = sorted(patches, reverse=True)
    covering, last = [], None
    for at, following in zip(edges, edges[1:]):
        while coming and coming[-1][0] == at:
            _, stop, start, ordinal, size = coming.pop()
            heapq.heappush(covering, (-ordinal, -start, -size, stop))
        while covering and covering[0][3] <= at:
            heapq.heappop(covering)
        if not covering:
            continue
        own = -covering[0][1], -covering[0][0], -covering[0][2]
        if last and last[1] == at and last[2:] == own:
            last = (last[0], following, *own)
        else:
            if last:
                yield last
            last = (at, following, *own)
    if last:
        yield last


def _swept(patches: pa.Array) -> pa.Array:
    names = [f.name for f in SEGMENTS.elementType.fields]
    columns, ends = [[] for _ in names], [0]
    for own in patches.to_pylist():
        for segment in sweep([tuple(p[n] for n in names) for p in own]):
            for column, value in zip(columns, segment):
                column.append(value)
        ends.append(len(columns[0]))
    found = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)


_swept.__annotations__ = {"patches": pa.Array, "return": pa.Array}


def winning_segments(patches: DataFrame) -> DataFrame:
    """path, begin, stop, start, ordinal, size: disjoint segments and the patch that wins each.

    patches: path, ordinal, start, data. Empty and null data and null starts or ordinals cover nothing. A segment ends
    with its span of 16 MiB at the latest.
    """
    size = F.length("data").cast("bigint")
    start = F.col("start").cast("bigint")
    each = patches.where("path IS NOT NULL AND start IS NOT NULL AND ordinal IS NOT NULL AND length(data) > 0").select(
        "path", start.alias("start"), F.col("ordinal").cast("bigint").alias("ordinal"), size.alias("size"),
        F.explode(F.sequence(F.floor(start / SPAN), F.floor((start + size - 1) / SPAN))).alias("span"),
    )
    begin = F.greatest("start", F.col("span") * SPAN)
    stop = F.least(F.col("start") + F.col("size"), (F.col("span") + 1) * SPAN)
    own = F.struct(begin.alias("begin"), stop.alias("stop"), "start", "ordinal", "size")
    spans = each.groupBy("path", "span").agg(F.collect_set(own).alias("patches"))
    swept = F.arrow_udf(_swept, SEGMENTS)
    return spans.select("path", F.inline(swept("patches")))


def segment_bytes(patches: DataFrame) -> DataFrame:
    """path, begin, data: the winning segments with their bytes, disjoint within a path.

    Of patches equal in path, ordinal, start and length the one of the greatest bytes wins.
    """
    key = ["path", "start", "ordinal", "size"]
    own = patches.select("path", F.col("start").cast("bigint").alias("start"), F.col("ordinal").cast("bigint").alias("ordinal"), F.length("data").cast("bigint").alias("size"), "data")
    cut = F.substring("data", (F.col("begin") - F.col("start") + 1).cast("int"), (F.col("stop") - F.col("begin")).cast("int"))
    return winning_segments(patches).join(own, key).select("path", "begin", cut.alias("data"))


def patched_bytes(patches: DataFrame) -> DataFrame:
    """path, off, value: the byte that wins at every patched offset. For looking at few bytes: a row per byte."""
    each = segment_bytes(patches).select("path", "begin", "data", F.explode(F.sequence(F.lit(0), F.length("data") - 1)).alias("i"))
    value = F.conv(F.hex(F.substring("data", F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
    return each.groupBy("path", (F.col("begin") + F.col("i")).alias("off")).agg(F.max(value).alias("value"))


def apply_patches(files: DataFrame, patches: DataFrame, clean: bool = False) -> DataFrame:
    """Content with all patches laid over it in ordinal order; ``clean`` returns it untouched.

    Only winning segments reach a file, so its list holds no more bytes than its patches cover. Files that no patch names
    stay in their scanning task (told apart by a bitmap over the paths). Bytes past either end of the file are not added; a
    null content stays null.
    """
    if clean:
        return files
    key = lambda: F.xxhash64("path")
    marked = may_hold(files, key(), patches.select(key().alias("h")))
    bare, touched = marked.where("NOT __may").drop("__may"), marked.where("__may").drop("__may")
    # equal patches may give one segment twice: in the order of their bytes the greatest is laid last
    per = segment_bytes(patches).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("begin", "data"))).alias("__laid"))
    names = files.columns
    at = names.index("content")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, segments in zip(batch.column(at), batch.column(len(names)), strict=True):
                if not segments.is_valid or not content.is_valid:
                    out.append(content.as_py())
                    continue
                body = np.frombuffer(content.as_buffer(), np.uint8).copy()
                begins, data = segments.values.field("begin").to_numpy(), segments.values.field("data")
                for begin, own in zip(begins.tolist(), data, strict=True):
                    own = np.frombuffer(own.as_buffer(), np.uint8)
                    a, b = max(begin, 0), min(begin + len(own), len(body))
                    if a < b:
                        body[a:b] = own[a - begin : b - begin]
                out.append(body.tobytes())
            columns = [pa.array(out, pa.binary()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    laid = touched.join(per, "path", "left").select(*names, "__laid").mapInArrow(lay, files.schema)
    return bare.select(*names).unionByName(laid)
