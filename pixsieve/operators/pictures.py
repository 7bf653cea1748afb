"""Pictures inside layered documents: channel rows as units of their own, expanded, audited and put together to pixels.

The walk over a document only reads the tables of row lengths and gives each channel's row places. A row then leaves its
file as (place, bytes), a few hundred bytes as a rule, and is expanded wherever Spark puts it: a picture of any size is as
many rows as it has lines and channels. A row whose expanded width is not the picture's is marked, and the others stay good.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixsieve.operators import blocks
from pixsieve.operators.carving import container_kind

RAW, RUNS = 0, 1
#: The picture of all layers together, in place of a layer's number.
MERGED = -1
#: Channel ids that hold a mask: their size is the mask's, so their rows are not those of the layer.
MASKS = (0xFFFE, 0xFFFD)

CHANNELS = T.ArrayType(T.StructType([
    T.StructField("layer", T.IntegerType()), T.StructField("chan", T.IntegerType()), T.StructField("method", T.IntegerType()),
    T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("depth", T.IntegerType()),
    T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("lens", T.ArrayType(T.IntegerType())),
]))


def row_bytes(width: int, depth: int) -> int:
    return (width * depth + 7) // 8


def channel_places(data: bytes):
    """(layer, chan, method, width, height, depth, offsets, lengths) of every channel, with an entry for each row up to the one at
    which the file ends.

    Reads what is there and stops at the first thing that is not: a layer section that ends too early gives the channels
    before that place. Layers come first, then the merged picture.
    """
    if len(data) < 30 or data[:6] != b"8BPS\x00\x01":
        return
    channels, height, width, depth = struct.unpack_from(">HIIH", data, 12)
    pos = 26
    for _ in range(2):  # colour mode data, resources
        if pos + 4 > len(data):
            return
        pos += 4 + int.from_bytes(data[pos : pos + 4], "big")
    if pos + 4 > len(data):
        return
    section = int.from_bytes(data[pos : pos + 4], "big")
    if section >= 6:
        yield from _layer_channels(data, pos + 4, min(pos + 4 + section, len(data)), depth)
    yield from _plane_set(data, pos + 4 + section, MERGED, list(range(channels)), width, height, depth)


def _layer_channels(data: bytes, at: int, stop: int, depth: int):
    size, count = struct.unpack_from(">Ih", data, at)
    if not size:
        return
    pos, layers = at + 6, []
    for layer in range(abs(count)):
        if pos + 18 > stop:
            return
        top, left, bottom, right, n = struct.unpack_from(">iiiiH", data, pos)
        pos += 18
        if pos + 6 * n + 16 > stop:
            return
        own = [struct.unpack_from(">HI", data, pos + 6 * c) for c in range(n)]
        pos += 6 * n + 12
        pos += 4 + int.from_bytes(data[pos : pos + 4], "big")
        layers.append((layer, max(right - left, 0), max(bottom - top, 0), own))
    for layer, width, height, own in layers:
        for chan, held in own:
            if pos + held > stop:
                return
            if chan not in MASKS and held >= 2:
                yield from _plane_set(data[: pos + held], pos, layer, [chan], width, height, depth)
            pos += held


def _plane_set(data: bytes, at: int, layer: int, chans: list[int], width: int, height: int, depth: int):
    """Channels that share one compression word, one behind the other."""
    if at + 2 > len(data) or not width or not height:
        return
    method = int.from_bytes(data[at : at + 2], "big")
    at += 2
    if method == RAW:
        size = row_bytes(width, depth)
        for chan in chans:
            rows = min(height, max(0, len(data) - at) // size + 1)
            yield layer, chan, method, width, height, depth, at + size * np.arange(rows), np.full(rows, size)
            at += size * height
    elif method == RUNS:
        table = np.frombuffer(data, ">u2", max(0, min(len(chans) * height, (len(data) - at) // 2)), at).astype(np.int64)
        base = at + 2 * len(chans) * height
        for i, chan in enumerate(chans):
            lengths = table[i * height : (i + 1) * height]
            offsets = base + np.cumsum(lengths) - lengths
            inside = offsets <= len(data)
            yield layer, chan, method, width, height, depth, offsets[inside], lengths[inside]
            base += int(lengths.sum())
    else:
        yield layer, -1, method, width, height, depth, np.zeros(0), np.zeros(0)


def _walked(content: pa.Array) -> pa.Array:
    columns, ends, marks, offsets, lens = [[] for _ in range(6)], [0], [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for value in content:
        for *record, at, size in channel_places(value.as_py()) if value.is_valid else ():
            for column, x in zip(columns, record, strict=True):
                column.append(x)
            offsets.append(at.astype(np.int64))
            lens.append(size.astype(np.int64))
            marks.append(marks[-1] + len(at))
        ends.append(len(columns[0]))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    lists = [pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array(np.concatenate(x), k)) for x, k in ((offsets, pa.int64()), (lens, pa.int32()))]
    found = pa.StructArray.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *lists], names=[f.name for f in CHANNELS.elementType.fields])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)


_walked.__annotations__ = {"content": pa.Array, "return": pa.Array}

EXPANDED = T.StructType([T.StructField("samples", T.ArrayType(T.ShortType())), T.StructField("expanded", T.LongType())])


def unpack_runs(data: bytes, limit: int) -> tuple[bytes, int]:
    """A run-length row's first ``limit`` bytes and how many it has in all: a count n < 0 repeats a byte 1 - n times, n >= 0 copies 1 + n."""
    parts, size, at, end = [], 0, 0, len(data)
    while at < end:
        n = data[at]
        if n > 127:
            own = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            own = data[at + 1 : at + 2 + n]
            at += 2 + n
        if size < limit:
            parts.append(own)
        size += len(own)
    return b"".join(parts)[:limit], size


def _expanded(data: pa.Array, method: pa.Array, width: pa.Array, depth: pa.Array) -> pa.Array:
    """Samples of 8 bits (of 16-bit ones the upper byte) and the row's width in samples."""
    flat, ends, sizes = [], [0], []
    for row, how, wide, bits in zip(data, method.to_pylist(), width.to_pylist(), depth.to_pylist(), strict=True):
        body = row.as_py() if row.is_valid else b""
        if how == RUNS:
            body, size = unpack_runs(body, row_bytes(wide, bits))
        else:
            size = len(body)
        own = np.frombuffer(body, np.uint8)
        if bits == 16:
            own, size = own[::2], size // 2
        elif bits == 1:
            own = np.unpackbits(own)[:wide] * np.uint8(255)
            size = wide if size == row_bytes(wide, 1) else size * 8
        flat.append(own)
        ends.append(ends[-1] + len(own))
        sizes.append(size)
    samples = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint8), *flat]).astype(np.int16)))
    return pa.StructArray.from_arrays([samples, pa.array(sizes, pa.int64())], names=["samples", "expanded"])


_expanded.__annotations__ = dict.fromkeys(("data", "method", "width", "depth", "return"), pa.Array)


def picture_rows(files: DataFrame) -> DataFrame:
    """path, layer (-1: the merged picture), chan, y, method, width, height, depth, offset, len, data: the stored rows of all channels.

    Data holds what the file has of them. A channel stored otherwise than raw or by run lengths, or without any row in the
    file, gives one row without y. Masks of layers are left out.
    """
    f = files.where(container_kind(F.col("content")) == "psd")
    walked = F.arrow_udf(_walked, CHANNELS)
    chans = f.select("path", "content", F.inline(walked("content")))
    names = ["path", "layer", "chan", "method", "width", "height", "depth"]
    rows = chans.select(*names, "content", F.posexplode_outer(F.arrays_zip("offsets", "lens")).alias("y", "at"))
    data = F.substring("content", (F.col("at.offsets") + 1).cast("int"), F.col("at.lens"))
    return rows.select(*names, "y", F.col("at.offsets").alias("offset"), F.col("at.lens").alias("len"), data.alias("data"))


def expanded_rows(rows: DataFrame) -> DataFrame:
    """The rows of ``picture_rows`` with samples (array of 0 to 255), expanded (samples in all) and ok instead of their bytes.

    A row is ok when its bytes are all there and give just the picture's width. Samples beyond the width are counted, not
    kept; of samples of 16 bits the upper half is.
    """
    expand = F.arrow_udf(_expanded, EXPANDED)
    out = rows.withColumn("__e", expand("data", "method", "width", "depth"))
    ok = (F.length("data") == F.col("len")) & (F.col("__e.expanded") == F.col("width"))
    return out.select(*[c for c in rows.columns if c != "data"], "__e.samples", "__e.expanded", F.coalesce(ok, F.lit(False)).alias("ok"))


def row_audit(files: DataFrame) -> DataFrame:
    """path, layer, chan, rows, bad (rows of another width, cut off or missing): one row per channel."""
    rows = expanded_rows(picture_rows(files))
    per = rows.groupBy("path", "layer", "chan", "method", "height").agg(F.count("y").alias("rows"), F.count_if("ok").alias("good"))
    return per.select("path", "layer", "chan", "method", "rows", (F.col("height") - F.col("good")).alias("bad"))


def pixels(files: DataFrame, layer: int = MERGED) -> DataFrame:
    """path, y, x, r, g, b of one layer or the merged picture; channels other than the first three are left out.

    Rows of a line meet by (path, line), so a large picture is spread over as many tasks as it has lines. What a damaged
    row lacks is null.
    """
    lines = picture_rows(files).where((F.col("layer") == layer) & F.col("chan").between(0, 2) & F.col("y").isNotNull())
    return blocks.planes_to_rgb(expanded_rows(lines).select("path", "y", "chan", "samples"))
