"""Byte-level search, carving and patching over files (path, content BINARY, ...).

Content never enters a shuffle on the way to a position: a file is cut into short overlapping cells
inside its own task, cells without the needle are dropped at once, and only positions move on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixsieve.bitmaps import may_hold
from pixsieve.operators import walks
from pixsieve.running import row_index, running
from pixsieve.sources.files import write_files
from pixsieve.sources.dims import STD_QUANT_LUMA, ZIGZAG, int_array

CELL, SUB_CELL = 256, 16
SOI = b"\xff\xd8\xff"


def byte_at(content: Column | str, offset: Column) -> Column:
    """Unsigned byte at a zero-based offset, null past the end."""
    return F.conv(F.hex(F.substring(content, (offset + 1).cast("int"), F.lit(1))), 16, 10).cast("int")


def byte_position(content: Column, needle: bytes) -> Column:
    """One-based byte position of the first needle, 0 when there is none."""
    return F.position(F.lit(needle.decode("latin-1")), F.decode(content, "ISO-8859-1"))


def cells(files: DataFrame, overlap: int, *keep: str, size: int = CELL) -> DataFrame:
    """keep..., base, cell: the content in pieces of ``size`` bytes plus ``overlap`` following ones.

    Only the offsets are generated as an array; each piece is read from the content as its row passes,
    so that a large file is never held twice. An empty file gives one empty cell.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(size))
    at = files.select(*keep, "content", F.explode(starts).alias("base"))
    return at.select(*keep, "base", F.substring("content", F.col("base") + 1, F.lit(size + overlap)).alias("cell"))


def hits_in_cell(needle: Column, length: int | Column, size: int = CELL) -> Column:
    """Zero-based places in ``cell`` where the needle starts (within the first ``size`` bytes)."""
    width = F.lit(length) if isinstance(length, int) else length
    last = F.least(F.length("cell") - width, F.lit(size - 1))
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda x: F.substring("cell", x + 1, width) == needle))


def find_all(files: DataFrame, needles: Sequence[bytes], *keep: str, ahead: int = 0) -> DataFrame:
    """All occurrences, overlapping ones too: path, keep..., needle_no, pos[, next bytes as ``ahead``].

    One pass over the content whatever the number of needles: a cell goes on once per needle it holds.
    """
    longest = max(len(n) for n in needles)
    small = cells(files, longest - 1 + ahead, "path", *keep)
    held = [F.when(F.contains("cell", F.lit(n)), F.struct(F.lit(i).alias("needle_no"), F.lit(n).alias("needle"))) for i, n in enumerate(needles)]
    live = small.select("*", F.inline(F.array_compact(F.array(*held))))
    fine = _split_cell(live, longest - 1 + ahead, "path", *keep, "needle_no", "needle")
    hits = fine.where(F.contains("cell", F.col("needle"))).select(
        "*", F.explode(hits_in_cell(F.col("needle"), F.length("needle"), SUB_CELL)).alias("__x")
    )
    cols = ["path", *keep, "needle_no", (F.col("base") + F.col("__x")).alias("pos")]
    if ahead:
        cols.append(F.substring("cell", F.col("__x") + 1 + F.length("needle"), F.lit(ahead)).alias("ahead"))
    return hits.select(*cols)


def _split_cell(live: DataFrame, overlap: int, *keep: str) -> DataFrame:
    """Cut a cell known to hold a needle further, so that the byte-by-byte test runs on few bytes only."""
    starts = F.sequence(F.lit(0), F.least(F.length("cell"), F.lit(CELL)) - 1, F.lit(SUB_CELL))
    parts = F.transform(
        starts, lambda b: F.struct((F.col("base") + b).alias("sub_base"), F.substring("cell", b + 1, F.lit(SUB_CELL + overlap)).alias("sub_cell"))
    )
    return live.select(*keep, F.inline(parts)).withColumnsRenamed({"sub_base": "base", "sub_cell": "cell"})


def count_hits(files: DataFrame, needles: Sequence[bytes]) -> DataFrame:
    return find_all(files, needles).groupBy("path", "needle_no").agg(F.count(F.lit(1)).alias("n"))


def start_offsets(files: DataFrame, needle: bytes = SOI, given: Column | None = None) -> DataFrame:
    """Start offset of each file in the four modes; offset 0 itself is never a search result.

    start = 0; srch1 = 0 when the file begins with the needle, else the next one; srch2 = the first
    needle after offset 0; pos = as given. Without a further needle the offset stays 0.
    """
    lit = F.lit(needle)
    small = cells(files.withColumn("__given", given if given is not None else F.lit(0)), len(needle) - 1, "path", "__given")
    here = F.when(F.contains("cell", lit), hits_in_cell(lit, len(needle)))
    after0 = F.array_min(F.filter(F.transform(here, lambda x: x + F.col("base")), lambda p: p > 0))
    per = small.select("path", "__given", after0.alias("p"), ((F.col("base") == 0) & F.startswith("cell", lit)).alias("ok"))
    got = per.groupBy("path").agg(
        F.max("__given").alias("given"), F.coalesce(F.min("p"), F.lit(0)).alias("next"), F.bool_or("ok").alias("ok")
    )
    return got.select(
        "path",
        F.lit(0).alias("start"),
        F.when(F.col("ok"), F.lit(0)).otherwise(F.col("next")).alias("srch1"),
        F.col("next").alias("srch2"),
        F.col("given").alias("pos"),
    )


def next_previous(files: DataFrame, needle: bytes, start: Column) -> DataFrame:
    """Nearest needle after and before a start offset; the start itself does not count."""
    hits = find_all(files.withColumn("start", start), [needle], "start")
    return hits.groupBy("path").agg(
        F.max("start").alias("start"),
        F.min(F.when(F.col("pos") > F.col("start"), F.col("pos"))).alias("next_pos"),
        F.max(F.when(F.col("pos") < F.col("start"), F.col("pos"))).alias("prev_pos"),
    )


def first_embedded(files: DataFrame, needle: bytes = SOI) -> DataFrame:
    return find_all(files, [needle]).groupBy("path").agg(F.min("pos").alias("first_pos"))


def carve_extents(
    files: DataFrame, start_mark: bytes = SOI, end_mark: bytes = b"\xff\xd9", *, ignore_end: bool = False, span: int | None = None
) -> DataFrame:
    """Extent of every embedded frame: path, pos, end_pos, terminated.

    A frame ends after the first end mark behind its start, else at the next start, else at the end of
    the file. ``ignore_end`` leaves end marks out. The marks of a path come out of one binary value (below
    2 GiB), hence a plain window; pass a ``span`` of positions to spread very dense files.
    """
    hits = find_all(files.withColumn("length", F.length("content").cast("bigint")), [start_mark, end_mark], "length")
    at = F.col("pos").cast("bigint")
    ahead = running(
        hits.select("path", "length", "needle_no", at.alias("pos")), ["path"], "pos",
        {"next_start": ("min", F.when(F.col("needle_no") == 0, F.col("pos"))),
         "next_end": ("min", F.when(F.col("needle_no") == 1, F.col("pos")))},
        inclusive=False, reverse=True, span=span,
    )
    end = F.col("next_end") + len(end_mark)
    if ignore_end:
        end = F.lit(None).cast("bigint")
    return ahead.where("needle_no = 0").select(
        "path", "pos", F.coalesce(end, "next_start", "length").alias("end_pos"), F.col("next_end").isNotNull().alias("terminated")
    )


def jpeg_frames(files: DataFrame, *keep: str, ignore_end: bool = False, force_soi: bool = False, force_eoi: bool = False) -> DataFrame:
    """Embedded JPEGs, found, cut and numbered in the scanning task: path, keep..., frame_no, pos, end_pos, terminated,
    has_tables, scan_at, frame.

    A frame is walked marker by marker from its SOI, so a thumbnail inside a segment is passed over with the segment and
    ends nothing. It ends behind its own EOI, else at the next SOI behind the place where the walk broke off, else with the
    file. ``ignore_end`` goes on past EOIs to the next SOI. ``force_soi`` puts an SOI before a file that begins without
    one, ``force_eoi`` an EOI behind an unterminated frame; has_tables and scan_at (place of the first scan header in the
    frame, -1 without) are those of the walked segments.
    """
    found = walks.jpeg_frames(F.col("content"), F.lit(ignore_end), F.lit(force_soi))
    at = files.select("path", *keep, "content", F.posexplode(found).alias("__no", "f"))
    cut = F.substring("content", (F.col("f.pos") + 1).cast("int"), (F.col("f.end_pos") - F.col("f.pos")).cast("int"))
    head = F.when(F.col("f.forced"), F.lit(b"\xff\xd8")).otherwise(F.lit(b""))
    tail = F.when(F.lit(force_eoi) & ~F.col("f.terminated"), F.lit(b"\xff\xd9")).otherwise(F.lit(b""))
    return at.select(
        "path", *keep, (F.col("__no") + 1).alias("frame_no"), "f.pos", "f.end_pos", "f.terminated", "f.has_tables", "f.scan_at",
        F.concat(head, cut, tail).alias("frame"),
    )


def cut_frames(files: DataFrame, start_mark: bytes, end_mark: bytes, *keep: str, ignore_end: bool = False, unended: bool = False, max_size: int | None = None) -> DataFrame:
    """The frames of ``carve_extents`` found, numbered and cut in the scanning task: path, keep..., frame_no (from 1), pos,
    end_pos, terminated, written, frame.

    Frames without an end mark are left out unless ``unended`` asks for them; those over ``max_size`` keep their number and
    have no bytes.
    """
    found = walks.marked_frames(F.col("content"), F.lit(start_mark), F.lit(b"" if ignore_end else end_mark))
    taken = found if unended or ignore_end else F.filter(found, lambda f: f["terminated"])
    at = files.select("path", *keep, "content", F.posexplode(taken).alias("__no", "f"))
    size = F.col("f.end_pos") - F.col("f.pos")
    written = F.lit(True) if max_size is None else size <= max_size
    cut = F.substring("content", (F.col("f.pos") + 1).cast("int"), size.cast("int"))
    return at.select(
        "path", *keep, (F.col("__no") + 1).cast("bigint").alias("frame_no"), "f.pos", "f.end_pos", "f.terminated", written.alias("written"), F.when(written, cut).alias("frame")
    )


def number_frames(frames: DataFrame, ok: Column, max_size: int | None = None, span: int | None = None) -> DataFrame:
    """Number the suitable frames of a file from 1; frames over ``max_size`` keep their number but are not written."""
    numbered = row_index(frames.where(ok), ["path"], "pos", "__i", span=span)
    size = F.col("end_pos") - F.col("pos")
    return numbered.select(
        "path", "pos", "end_pos", (F.col("__i") + 1).alias("frame_no"),
        (F.lit(True) if max_size is None else size <= max_size).alias("written"),
    )


def frame_name(root: Column, number: Column) -> Column:
    return F.format_string("%s.%06d.jpg", root, number)


def frame_bytes(frames: DataFrame, files: DataFrame) -> DataFrame:
    """Join the bytes of each frame back by path."""
    return frames.join(files.select("path", "content"), "path").withColumn(
        "frame", F.substring("content", (F.col("pos") + 1).cast("int"), (F.col("end_pos") - F.col("pos")).cast("int"))
    ).drop("content")


def write_frames(frames: DataFrame, target: str) -> None:
    """Write carved frames as rows (name, path, frame_no, frame), spread over all tasks."""
    frames.write.mode("overwrite").parquet(target)


def file_root(path: Column) -> Column:
    """A path without its extension, as frame names begin; a leading slash is left out."""
    return F.regexp_replace(F.regexp_replace(path.cast("string"), r"^/+", ""), r"(?<=[^/])\.[^./]*$", "")


def write_frame_files(frames: DataFrame, target: str, root: Column | None = None, overwrite: bool = False) -> None:
    """Every frame as a file of its own, ``<root>.<frame_no>.jpg``, written by the task that cut it.

    The root is the path without its extension; hand in another where two files of a folder differ by extension only,
    since a name that occurs twice ends the write.
    """
    name = frame_name(file_root(F.col("path")) if root is None else root, F.col("frame_no"))
    write_files(frames.select(name.alias("name"), F.col("frame").alias("content")), target, overwrite)


def insert_tables(frames: DataFrame, segment: bytes, table_mark: bytes = b"\xff\xc4", scan_mark: bytes = b"\xff\xda") -> DataFrame:
    """Motion frames without Huffman tables get a standard segment before their scan.

    Frames of ``jpeg_frames`` know their scan header and tables from the walk, so that those of a thumbnail count for
    nothing; other frames are searched for the marks. Adds has_tables and replaces ``frame``; a frame without scan mark is
    left as it is.
    """
    walked = "scan_at" in frames.columns
    has = F.col("has_tables") if walked else F.contains("frame", F.lit(table_mark))
    at = F.col("scan_at") + 1 if walked else byte_position(F.col("frame"), scan_mark)
    fixed = F.concat(
        F.substring("frame", F.lit(1), at - 1), F.lit(segment), F.substring("frame", at, F.length("frame"))
    )
    return frames.withColumn("has_tables", has).withColumn(
        "frame", F.when(F.col("has_tables") | (at == 0), F.col("frame")).otherwise(fixed)
    )


def scan_census(files: DataFrame, lead: int = 0xFF, stuffed=(0x00, 0x00), pad: int | None = 0xFF, restart=(0xD0, 0xD7)) -> DataFrame:
    """Every lead byte of a scan with the class of the byte behind it."""
    hits = find_all(files, [bytes([lead])], ahead=1)
    code = F.conv(F.hex("ahead"), 16, 10).cast("int")
    rows = hits.select("path", "pos", F.when(F.length("ahead") > 0, code).alias("code"))
    kind = F.when(F.col("code").isNull(), "end").when(F.col("code").between(*stuffed), "stuffed").when(F.col("code").between(*restart), "restart")
    if pad is not None:
        kind = kind.when(F.col("code") == pad, "pad")
    return rows.withColumn("kind", kind.otherwise("marker"))


# --- table hunt ----------------------------------------------------------------------------------

BLOCK = 32
ENCODINGS = ((1, False), (2, False), (2, True), (4, False), (4, True))


def _encode(values: Column, width: int, swapped: bool) -> Column:
    """64 numbers as bytes: big-endian, or little-endian when swapped."""
    def one(v: Column) -> Column:
        big = F.lpad(F.hex(v), 2 * width, "0")
        if not swapped:
            return big
        return F.concat(*[F.substring(big, 2 * i + 1, 2) for i in reversed(range(width))])

    return F.unhex(F.array_join(F.transform(values, one), ""))


def hunt_needles(tables: DataFrame) -> DataFrame:
    """All byte forms of the given tables (table_id, table in row order): order x width x byte order.

    A constant table is not hunted; a table with values over 255 has no one-byte form.
    """
    t = tables.where(F.array_min("table") != F.array_max("table"))
    t = t.select("table_id", "table", F.transform(int_array(ZIGZAG), lambda i: F.get("table", i)).alias("zz"))
    forms = [
        F.struct(F.lit(f"{order}-{width}{'s' if swapped else ''}").alias("form"), F.lit(width).alias("width"), _encode(F.col(c), width, swapped).alias("needle"))
        for order, c in (("pre", "table"), ("post", "zz")) for width, swapped in ENCODINGS
    ]
    rows = t.select("table_id", (F.array_max("table") <= 255).alias("baseline"), F.inline(F.array(*forms)))
    return rows.where(F.col("baseline") | (F.col("width") > 1)).select("table_id", "form", "needle")


def standard_table(spark) -> DataFrame:
    return spark.range(1).select(F.lit("standard").alias("table_id"), int_array(STD_QUANT_LUMA).alias("table"))


#: Bytes of the longest form of a table.
REACH = 64 * 4


def hunt_hits(files: DataFrame, needles: DataFrame, reach: int = REACH) -> DataFrame:
    """All offsets of all distinct needles (of 63 to ``reach`` bytes; a longer one ends the query) in all files: path, pos, needle.

    Files are cut into aligned blocks of 32 bytes. Wherever a needle lies, exactly one aligned block is the first that
    falls wholly inside it; so the needle's 32 possible leading blocks join the files' blocks by hash. Blocks that no
    needle can begin with are dropped in the scanning task (a bitmap over the hashes); each of the others carries the
    bytes around it, as many as a needle can reach, so the candidate is verified where it meets the needle and no content
    takes part in a join.
    """
    shifts = F.transform(
        F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda s: F.struct(s.alias("s"), F.xxhash64(F.substring("needle", s + 1, F.lit(BLOCK))).alias("h"))
    )
    fit = F.when(F.length("needle") <= reach, F.col("needle")).otherwise(F.raise_error(F.lit(f"a needle is longer than {reach} bytes")).cast("binary"))
    keys = needles.select(fit.alias("needle")).distinct().select("needle", F.inline(shifts))
    steps = F.sequence(F.lit(0), F.length("content") - BLOCK, F.lit(BLOCK))
    at = files.where(F.length("content") >= BLOCK).select("path", "content", F.explode(steps).alias("p"))
    hashed = may_hold(at, F.xxhash64(F.substring("content", F.col("p") + 1, F.lit(BLOCK))), keys.select("h")).where("__may")
    begin = F.greatest(F.col("p") - (BLOCK - 1), F.lit(0))
    windows = hashed.select(
        "path", "p", begin.alias("begin"), F.substring("content", begin + 1, F.lit(reach + 2 * BLOCK)).alias("window"),
        F.xxhash64(F.substring("content", F.col("p") + 1, F.lit(BLOCK))).alias("h"),
    )
    pos = F.col("p") - F.col("s")
    same = F.substring("window", pos - F.col("begin") + 1, F.length("needle")) == F.col("needle")
    return windows.join(keys, "h").where((pos >= 0) & same).select("path", pos.alias("pos"), "needle").distinct()


def hunt(files: DataFrame, needles: DataFrame) -> DataFrame:
    """The hits named by table and form: path, table_id, form, pos. Tables of equal bytes share their hits; to keep those
    apart from their owners take ``hunt_hits`` and the needles as two relations."""
    return hunt_hits(files, needles).join(needles, "needle").select("path", "table_id", "form", "pos")


# --- hex dump and container ----------------------------------------------------------------------

HEX_ROW, HEX_TOTAL = 16, 128


def printable(data: Column) -> Column:
    """Bytes as text, non-printable ones as dots."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), "[^\\x20-\\x7e]", ".")


def hex_rows(files: DataFrame) -> DataFrame:
    """Hex dump: rows of 16 bytes, at most 128 bytes, then a row of dots when there is more."""
    size = F.length("content")
    starts = F.when(size > 0, F.sequence(F.lit(0), F.least(size, F.lit(HEX_TOTAL)) - 1, F.lit(HEX_ROW)))
    data = F.transform(starts, lambda s: F.struct(s.alias("off"), F.substring("content", s + 1, F.lit(HEX_ROW)).alias("data")))
    more = F.when(size > HEX_TOTAL, F.array(F.struct(F.lit(HEX_TOTAL).alias("off"), F.lit(None).cast("binary").alias("data"))))
    rows = files.select("path", (size <= HEX_ROW).alias("in_line"), F.inline(F.concat(data, F.coalesce(more, F.slice(data, 1, 0)))))
    spaced = F.regexp_replace(F.hex("data"), "(..)", "$1 ")
    return rows.select(
        "path", "off", "in_line",
        F.when(F.col("data").isNull(), "...").otherwise(F.rpad(spaced, 48, " ")).alias("hex_text"),
        F.when(F.col("data").isNull(), "").otherwise(F.rpad(printable(F.col("data")), HEX_ROW, " ")).alias("ascii_text"),
    )


def container_kind(content: Column) -> Column:
    """psd, dicom, jpeg, avi or unknown, from the leading bytes."""
    def at(offset: int, data: bytes) -> Column:
        return F.substring(content, offset + 1, len(data)) == F.lit(data)

    return (
        F.when(at(0, b"8BPS\x00\x01"), "psd").when(at(128, b"DICM"), "dicom").when(at(0, SOI), "jpeg")
        .when(at(0, b"RIFF") & at(8, b"AVI "), "avi").otherwise("unknown")
    )
