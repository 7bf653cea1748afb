"""Binary files to rows. Content is cut to the section of interest before it leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixsieve.functions import scalars as sc
from pixsieve.operators import blocks, chains, lookups, walks
from pixsieve.operators.carving import container_kind
from pixsieve.sources import dims


def walk_rows(files: DataFrame, walk, content: Column, *keep: str) -> DataFrame:
    """keep..., seq and the fields of the walk, one row per record."""
    out = files.select(*keep, F.posexplode(walk(content)).alias("seq", "__r"))
    return out.select(*keep, "seq", "__r.*")


# --- JPEG ----------------------------------------------------------------------------------------

def jpeg_segments(files: DataFrame) -> DataFrame:
    """path, seq, code, offset, len, complete, marker."""
    rows = walk_rows(files, walks.jpeg_segments, F.col("content"), "path")
    return rows.withColumn(
        "marker", F.when(F.col("code") == 0, "scan").when(F.col("code") == -1, "missing").otherwise(dims.marker_name_column(F.col("code")))
    )


def segment_data(files: DataFrame, code: int, lead: bytes) -> DataFrame:
    """path, seq, data: payloads of the segments with this code that begin with ``lead`` (stripped)."""
    segs = files.select("path", "content", F.posexplode(walks.jpeg_segments("content")).alias("seq", "s"))
    hit = segs.where(F.col("s.code") == code).select(
        "path", "seq", F.substring("content", (F.col("s.offset") + 5).cast("int"), (F.col("s.len") - 2).cast("int")).alias("data")
    )
    return hit.where(F.startswith("data", F.lit(lead))).select("path", "seq", F.substring("data", F.lit(len(lead) + 1), F.length("data")).alias("data"))


#: Frame headers: all SOF codes; C4, C8 and CC between them are tables, reserved and arithmetic conditioning.
SOF = tuple(c for c in range(0xC0, 0xD0) if c not in (0xC4, 0xC8, 0xCC))


def header_segments(files: DataFrame) -> DataFrame:
    """path, seq, code, data: payloads of all complete header segments, from one walk over each file."""
    segs = files.select("path", "content", F.posexplode(walks.jpeg_segments("content")).alias("seq", "s"))
    wanted = (*SOF, 0xC4, 0xDA, 0xDB, 0xDD)
    return segs.where(F.col("s.code").isin(*wanted) & F.col("s.complete")).select(
        "path", "seq", F.col("s.code").alias("code"),
        F.substring("content", (F.col("s.offset") + 5).cast("int"), (F.col("s.len") - 2).cast("int")).alias("data"),
    )


def _byte(at: Column | int) -> Column:
    return sc.read_uint("data", at, 1).cast("int")


def _nibbles(at: Column | int) -> tuple[Column, Column]:
    v = _byte(at)
    return F.shiftright(v, 4), v.bitwiseAND(15)


def frames(segments: DataFrame) -> DataFrame:
    """Frame headers: path, seq, precision, height, width, ncomp, comps (ci, h, v, tq)."""
    f = segments.where(F.col("code").isin(*SOF)).withColumn("ncomp", _byte(5)).where(F.length("data") >= F.col("ncomp") * 3 + 6)

    def comp(i: Column) -> Column:
        h, v = _nibbles(i * 3 + 7)
        return F.struct(_byte(i * 3 + 6).alias("ci"), h.alias("h"), v.alias("v"), _byte(i * 3 + 8).alias("tq"))

    comps = F.when(F.col("ncomp") > 0, F.transform(F.sequence(F.lit(0), F.col("ncomp") - 1), comp))
    return f.select(
        "path", "seq", _byte(0).alias("precision"), sc.read_uint("data", 1, 2).cast("int").alias("height"),
        sc.read_uint("data", 3, 2).cast("int").alias("width"), "ncomp", comps.alias("comps"),
    )


def scans(segments: DataFrame) -> DataFrame:
    """Scan headers: path, seq, ns, comps (ci, td, ta), ss, se, ah, al and the restart interval in force (0 = none).

    The interval is that of the latest DRI before the scan; headers of a path come out of one file.
    """
    dri = F.when(F.col("code") == 0xDD, sc.read_uint("data", 0, 2).cast("int"))
    before = W.partitionBy("path").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    small = segments.where(F.col("code").isin(0xDA, 0xDD))
    s = small.withColumn("rst_interval", F.coalesce(F.last(dri, True).over(before), F.lit(0))).where(F.col("code") == 0xDA)
    s = s.withColumn("ns", _byte(0)).where(F.length("data") >= F.col("ns") * 2 + 4)

    def comp(i: Column) -> Column:
        td, ta = _nibbles(i * 2 + 2)
        return F.struct(_byte(i * 2 + 1).alias("ci"), td.alias("td"), ta.alias("ta"))

    tail = F.col("ns") * 2
    ah, al = _nibbles(tail + 3)
    comps = F.when(F.col("ns") > 0, F.transform(F.sequence(F.lit(0), F.col("ns") - 1), comp))
    return s.select("path", "seq", "ns", comps.alias("comps"), _byte(tail + 1).alias("ss"), _byte(tail + 2).alias("se"), ah.alias("ah"), al.alias("al"), "rst_interval")


def _starts(least: int, step) -> Column:
    """Offsets of the tables inside one payload, each as long as ``step(offset)`` says; a table has ``least`` bytes."""
    rounds = F.sequence(F.lit(1), F.greatest(F.expr(f"CAST(length(data) DIV {least} AS INT)"), F.lit(1)))
    end = F.length("data")

    def grow(acc: Column, _: Column) -> Column:
        tail = F.element_at(acc, -1)
        nxt = tail + step(tail)
        return F.when(nxt < end, F.array_append(acc, nxt)).otherwise(acc)

    return F.aggregate(rounds, F.array(F.lit(0)), grow)


def quantisation_tables(segments: DataFrame) -> DataFrame:
    """path, seq, at (offset in the segment), dest_id, precision (8 or 16), table_zz; a later table replaces an earlier one of its place."""
    def wide(at: Column) -> Column:
        return F.shiftright(_byte(at), 4) > 0

    d = segments.where((F.col("code") == 0xDB) & (F.length("data") >= 65))
    starts = _starts(65, lambda at: F.when(wide(at), F.lit(129)).otherwise(F.lit(65)))
    t = d.select("path", "seq", "data", F.explode(starts).alias("at"))
    hi, lo = _nibbles(F.col("at"))
    t = t.select("path", "seq", "data", "at", (hi > 0).alias("wide"), lo.alias("dest_id"))

    def value(i: Column) -> Column:
        at = F.col("at") + 1
        return F.when(F.col("wide"), sc.read_uint("data", at + i * 2, 2)).otherwise(sc.read_uint("data", at + i, 1)).cast("int")

    size = F.when(F.col("wide"), F.lit(129)).otherwise(F.lit(65))
    t = t.where(F.col("at") + size <= F.length("data"))
    return t.select(
        "path", "seq", "at", "dest_id", F.when(F.col("wide"), 16).otherwise(8).alias("precision"),
        F.transform(F.sequence(F.lit(0), F.lit(63)), value).alias("table_zz"),
    )


def huffman_lists(segments: DataFrame) -> DataFrame:
    """path, seq, class, dest_id, idx, bitlen, value: the code list of each Huffman table, in code order."""
    ones = F.sequence(F.lit(1), F.lit(16))

    def codes(at: Column) -> Column:
        return F.aggregate(ones, F.lit(0), lambda acc, i: acc + F.coalesce(_byte(at + i), F.lit(0)))

    d = segments.where((F.col("code") == 0xC4) & (F.length("data") >= 17))
    t = d.select("path", "seq", "data", F.explode(_starts(17, lambda at: codes(at) + 17)).alias("at"))
    hi, lo = _nibbles(F.col("at"))
    lens = F.flatten(F.transform(ones, lambda i: F.array_repeat(i, F.coalesce(_byte(F.col("at") + i), F.lit(0)))))
    rows = t.select("path", "seq", "data", "at", hi.alias("class"), lo.alias("dest_id"), F.posexplode(lens).alias("idx", "bitlen"))
    return rows.select("path", "seq", "class", "dest_id", "idx", "bitlen", _byte(F.col("at") + 17 + F.col("idx")).alias("value"))


def image_signatures(segments: DataFrame) -> DataFrame:
    """Compression signature per path from its quantisation tables and luma subsampling, plain and rotated.

    One walk and one grouping: the tables of a header segment and the sampling of a frame header are rows of one array.
    Of several tables for one place the last in the file counts, also within one segment.
    """
    first_h, first_v = _nibbles(7)
    sampling = F.when(F.length("data") >= 9, F.format_string("%dx%d", first_h, first_v))
    is_table = (F.col("code") == 0xDB) & (F.length("data") >= 65)

    def wide(at: Column) -> Column:
        return F.shiftright(_byte(at), 4) > 0

    def table(at: Column) -> Column:
        size = F.when(wide(at), F.lit(129)).otherwise(F.lit(65))
        values = F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda i: F.when(wide(at), sc.read_uint("data", at + 1 + i * 2, 2)).otherwise(sc.read_uint("data", at + 1 + i, 1)).cast("int"),
        )
        return F.when(at + size <= F.length("data"), F.struct(_byte(at).bitwiseAND(15).alias("dest_id"), at.alias("at"), values.alias("table_zz")))

    starts = _starts(65, lambda at: F.when(wide(at), F.lit(129)).otherwise(F.lit(65)))
    rows = segments.where(is_table | F.col("code").isin(*SOF)).select(
        "path", "seq", F.when(F.col("code").isin(*SOF), sampling).alias("subsampling"),
        F.explode_outer(F.when(is_table, F.transform(starts, table))).alias("t"),
    )
    per = rows.groupBy("path", F.col("t.dest_id").alias("dest_id")).agg(
        F.max_by(F.col("t.table_zz"), F.struct("seq", F.col("t.at"))).alias("table_zz"), F.min_by("subsampling", "seq").alias("subsampling"),
    )
    # the sampling stands on the rows without a table, one or none per path
    found = F.first("subsampling", ignorenulls=True).over(W.partitionBy("path").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    whole = per.withColumn("subsampling", F.coalesce(found, F.lit(""))).where("dest_id IS NOT NULL")
    return blocks.compression_signature(whole.withColumnRenamed("path", "image_id").select("image_id", "dest_id", "table_zz", "subsampling"))


def thumbnail_signatures(exif: DataFrame) -> DataFrame:
    """Compression signature of the thumbnail inside each TIFF block (path, data), plain and rotated."""
    small = walk_rows(exif.withColumn("block", F.col("data")), walks.tiff_tags, F.col("data"), "path", "block").where("section = 'ifd1'")
    place = small.groupBy("path").agg(
        F.first("block").alias("block"), F.max(F.when(F.col("tag_id") == 0x0201, F.get("nums", 0))).alias("at"),
        F.max(F.when(F.col("tag_id") == 0x0202, F.get("nums", 0))).alias("len"),
    )
    inside = place.where("at >= 0 AND len > 0 AND at < length(block)").select(
        "path", F.substring("block", (F.col("at") + 1).cast("int"), F.least("len", F.length("block").cast("bigint")).cast("int")).alias("content"))
    return image_signatures(header_segments(inside))


def icc_blocks(files: DataFrame) -> DataFrame:
    """path, data: the first chunk of each embedded ICC profile, which holds its header."""
    d = segment_data(files, 0xE2, b"ICC_PROFILE\x00")
    return d.where(sc.read_uint("data", 0, 1) == 1).select("path", F.substring("data", F.lit(3), F.length("data")).alias("data"))


def exif_tags(tiff: DataFrame, dim: DataFrame) -> DataFrame:
    """Named tags with value text from TIFF blocks (path, data)."""
    rows = walk_rows(tiff, walks.tiff_tags, F.col("data"), "path")
    named = lookups.name_exif(rows, dim)
    return named.select("path", "section", "seq", "tag_id", "name", "is_unknown", "type", "count", "complete", tag_value().alias("value"))


def rationals() -> Column:
    """Fractions of a rational value as an array of (num, den)."""
    idx = F.sequence(F.lit(1), F.floor(F.size("nums") / 2).cast("int"))
    pairs = F.transform(idx, lambda i: F.struct(F.get("nums", i * 2 - 2).alias("num"), F.get("nums", i * 2 - 1).alias("den")))
    return F.when(F.size("nums") >= 2, pairs).otherwise(F.slice(pairs, 1, 0))


def tag_value() -> Column:
    """Value text by TIFF type: text up to its zero byte, numbers and fractions separated by commas, other bytes in hex.

    A value that is cut off shows what is there.
    """
    text = F.substring_index(F.decode("data", "ISO-8859-1"), "\x00", 1)
    fractions = F.array_join(F.transform(rationals(), lambda r: F.concat_ws("/", r["num"], r["den"])), ",")
    t = F.col("type")
    value = (
        F.when(t == 2, text).when(t.isin(5, 10), fractions)
        .when(F.col("nums").isNotNull(), F.array_join(F.transform("nums", lambda v: v.cast("string")), ","))
        .otherwise(F.hex("data"))
    )
    return F.when(F.col("count") > 0, value).otherwise("")


def gps_position(tiff: DataFrame) -> DataFrame:
    """Latitude and longitude in signed degrees per path."""
    rows = walk_rows(tiff, walks.tiff_tags, F.col("data"), "path").where("section = 'gps'")
    rows = rows.withColumn("r", F.when(F.col("type") == 5, rationals()))
    letter = F.decode(F.substring("data", 1, 1), "ISO-8859-1")

    def angle(tag: int) -> Column:
        part = [F.try_divide(F.col("r")[i]["num"], F.col("r")[i]["den"]) for i in range(3)]
        return F.max(F.when((F.col("tag_id") == tag) & (F.size("r") >= 3), sc.degrees(*part)))

    per = rows.groupBy("path").agg(
        F.max(F.when(F.col("tag_id") == 1, letter)).alias("ns"), angle(2).alias("lat"),
        F.max(F.when(F.col("tag_id") == 3, letter)).alias("ew"), angle(4).alias("lon"),
    )
    return per.select(
        "path", F.when(F.col("ns") == "S", -F.col("lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(F.col("ew") == "W", -F.col("lon")).otherwise(F.col("lon")).alias("lon"),
    )


def thumbnail_extents(tags: DataFrame) -> DataFrame:
    """Offset (in the TIFF block) and length of the embedded thumbnail per path."""
    number = F.col("value").try_cast("bigint")  # a damaged entry may hold anything
    t = tags.where("section = 'ifd1'").groupBy("path").agg(
        F.max(F.when(F.col("tag_id") == 0x0201, number)).alias("offset"), F.max(F.when(F.col("tag_id") == 0x0202, number)).alias("len"),
    )
    return t.where("offset IS NOT NULL")


def icc_header(profiles: DataFrame) -> DataFrame:
    """Fixed fields of an ICC profile header (path, data); pure projections."""
    d = F.col("data")

    def key(at: int) -> Column:
        return F.decode(F.substring(d, at + 1, 4), "ISO-8859-1")

    when = [sc.read_uint(d, 24 + 2 * i, 2) for i in range(6)]
    version = F.format_string("%d.%d", sc.read_uint(d, 8, 1), F.shiftright(sc.read_uint(d, 9, 1), 4))
    return profiles.where(F.length("data") >= 128).select(
        "path", sc.read_uint(d, 0, 4).alias("size"), key(4).alias("cmm"), version.alias("version"), key(12).alias("device_class"),
        key(16).alias("colour_space"), key(20).alias("pcs"),
        F.try_make_timestamp(*[w.cast("int") for w in when]).alias("created"), (key(36) == "acsp").alias("signature_ok"),
        key(40).alias("platform"), sc.read_uint(d, 44, 4).alias("flags"), key(48).alias("manufacturer"), key(52).alias("model"),
        sc.read_uint(d, 64, 4).alias("intent"), key(80).alias("creator"),
    )


ICC_LEAD = b"ICC_PROFILE\x00"


def icc_profiles(files: DataFrame) -> DataFrame:
    """path, chunks (declared), held, missing (chunk numbers), repeated, in_order, complete, data: profiles out of APP2 segments.

    A profile is cut into numbered chunks, each with the number of all; the first of those numbered alike counts. data is
    the chunks in the order of their numbers where all are there, else null. A file has 255 chunks of 64 KiB at most, so all
    is done in the row that holds it. Files without a profile have no row.
    """
    found = F.filter(walks.jpeg_segments(F.col("content")), lambda s: (s["code"] == 0xE2) & s["complete"] & (s["len"] >= len(ICC_LEAD) + 4))
    body = lambda s, skip, size: F.substring(F.col("content"), (s["offset"] + 5 + skip).cast("int"), size)
    cut = files.select("path", "content", F.filter(found, lambda s: body(s, 0, F.lit(len(ICC_LEAD))) == F.lit(ICC_LEAD)).alias("segs")).where("size(segs) > 0")
    byte = lambda b: F.conv(F.hex(b), 16, 10).cast("int")
    chunks = F.transform("segs", lambda s: F.struct(
        byte(body(s, len(ICC_LEAD), F.lit(1))).alias("no"), byte(body(s, len(ICC_LEAD) + 1, F.lit(1))).alias("all"), (s["offset"] + 5 + len(ICC_LEAD) + 2).alias("at"),
        (s["len"] - 2 - len(ICC_LEAD) - 2).alias("size")))
    listed = cut.select("path", "content", chunks.alias("pieces")).withColumns({
        "numbers": F.transform("pieces", lambda c: c["no"]), "declared": F.array_max(F.transform("pieces", lambda c: c["all"]))})
    wanted = F.when(F.col("declared") > 0, F.sequence(F.lit(1), F.col("declared"))).otherwise(F.array().cast("array<int>"))
    audit = listed.select(
        "path", "content", "pieces", F.col("declared").alias("chunks_all"), F.array_except(wanted, F.array_distinct("numbers")).alias("missing"),
        (F.size("numbers") - F.size(F.array_distinct("numbers"))).alias("repeated"), (F.col("numbers") == F.array_sort("numbers")).alias("in_order"),
        (F.forall("pieces", lambda c: (c["all"] == F.col("declared")) & c["no"].between(1, F.col("declared")))).alias("agreed"), wanted.alias("wanted"))
    whole = (F.size("missing") == 0) & F.col("agreed") & (F.size("wanted") > 0)
    first = F.transform("wanted", lambda n: F.get(F.filter("pieces", lambda c: c["no"] == n), 0))
    data = F.unhex(F.array_join(F.transform(first, lambda c: F.hex(F.substring(F.col("content"), c["at"].cast("int"), c["size"].cast("int")))), ""))
    return audit.select(
        "path", F.col("chunks_all").alias("chunks"), F.size("pieces").alias("held"), "missing", "repeated", "in_order", whole.alias("complete"), F.when(whole, data).alias("data")
    )


# --- AVI -----------------------------------------------------------------------------------------

def avi_frames(files: DataFrame, *keep: str) -> DataFrame:
    """Video frames of AVI files: path, keep..., frame_no, stream, pos, len, indexed, key, jpeg, has_tables, scan_at, complete, frame.

    Each frame is cut in the scanning task and goes on by itself, as ``carving.insert_tables`` takes it.
    """
    at = files.where(container_kind(F.col("content")) == "avi").select("path", *keep, "content", F.inline(walks.avi_frames("content")))
    frame = F.substring("content", (F.col("pos") + 1).cast("int"), F.least(F.col("len"), F.length("content")).cast("int"))
    return at.where("walked").select("path", *keep, "frame_no", "stream", "pos", "len", "indexed", "key", "jpeg", "has_tables", "scan_at", "complete", frame.alias("frame"))


def avi_index_audit(files: DataFrame) -> DataFrame:
    """path, frames (walked), indexed (of them), stray (index entries without a frame), agree: one row per AVI file with any."""
    rows = files.where(container_kind(F.col("content")) == "avi").select("path", F.inline(walks.avi_frames("content")))
    per = rows.groupBy("path").agg(
        F.count_if("walked").alias("frames"), F.count_if(F.col("walked") & F.col("indexed")).alias("indexed"), F.count_if(~F.col("walked")).alias("stray"))
    return per.withColumn("agree", (F.col("frames") == F.col("indexed")) & (F.col("stray") == 0))


# --- PSD -----------------------------------------------------------------------------------------

def psd_sections(files: DataFrame) -> DataFrame:
    """Files of kind psd with the places of their sections, content kept."""
    c = F.col("content")
    f = files.where(container_kind(c) == "psd").withColumn("mode_len", sc.read_uint(c, 26, 4))
    f = f.withColumn("res_at", F.col("mode_len") + 30).withColumn("res_len", sc.read_uint(c, F.col("res_at"), 4))
    f = f.withColumn("layer_at", F.col("res_at") + 4 + F.col("res_len"))
    return f.withColumn("layer_len", sc.read_uint(c, F.col("layer_at"), 4))


def _section(at: str, size: str) -> Column:
    return F.substring("content", sc.place(F.col(at) + 5), sc.place(F.col(size)))


def enum_text(field: str, value: Column) -> Column:
    """Text of a small enumeration as an expression; unknown values become a hex word."""
    out = None
    for f, v, text in dims.PSD_ENUMS:
        if f == field:
            hit = value == dims.key_to_int(v)
            out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.otherwise(lookups.hex_word(value))


def psd_header(files: DataFrame) -> DataFrame:
    c = F.col("content")
    return psd_sections(files).select(
        "path", sc.read_uint(c, 4, 2).alias("version"), sc.read_uint(c, 12, 2).alias("channels"), sc.read_uint(c, 14, 4).alias("height"),
        sc.read_uint(c, 18, 4).alias("width"), sc.read_uint(c, 22, 2).alias("depth"),
        enum_text("color_mode", sc.read_uint(c, 24, 2)).alias("color_mode"), "mode_len",
    )


def psd_resources(files: DataFrame, dim: DataFrame) -> DataFrame:
    """Image resource blocks with their names; offset counts from the start of the file."""
    s = psd_sections(files).select("path", "res_at", _section("res_at", "res_len").alias("section"))
    rows = walk_rows(s, walks.image_resources, F.col("section"), "path", "res_at")
    rows = rows.withColumn("offset", F.col("offset") + F.col("res_at") + 4).withColumnRenamed("name", "own_name").drop("res_at")
    return lookups.name_codes(rows, "bim_id", dim)


def resource_fields(resources: DataFrame, layout: DataFrame, enums: DataFrame) -> DataFrame:
    """Typed payloads as path, seq, bim_id, n, field, value, by joining blocks with their field layout.

    A layout row names one field: its place, width and kind; ``stride`` repeats it for every item of a
    list, whose length is stored at ``count_at`` or follows from the size of the block.
    """
    d, size = F.col("data"), F.length("data")
    f = resources.select("path", "seq", "bim_id", "data").where(size > 0).join(layout, "bim_id")
    fit = F.expr("(length(data) - start) DIV stride")
    counted = F.conv(F.hex(F.substring(d, F.col("count_at") + 1, F.col("count_width"))), 16, 10).cast("bigint")
    times = F.when(F.col("stride") == 0, F.lit(1)).when(F.col("count_at").isNull(), fit).otherwise(F.least(fit, counted))
    f = f.withColumn("times", times).where("times > 0")
    f = f.select("*", F.explode(F.sequence(F.lit(0), (F.col("times") - 1).cast("int"))).alias("i"))

    first_wide = sc.read_uint(d, F.col("at"), 4) * 2 + 4
    second_wide = sc.read_uint(d, F.col("at") + first_wide, 4) * 2 + 4
    skip = F.col("skip_wide")
    at = F.col("at") + F.col("i") * F.col("stride") + F.when(skip > 0, first_wide).otherwise(0) + F.when(skip > 1, second_wide).otherwise(0)
    f = f.withColumn("place", at)
    raw = F.substring(d, sc.place(F.col("place") + 1), F.col("width"))
    f = f.withColumn("raw", F.when(F.length(raw) == F.col("width"), sc.unsigned(raw)))
    e = enums.select(F.col("field").alias("enum"), F.col("value").alias("raw"), F.col("text").alias("enum_text"))
    f = f.join(e, ["enum", "raw"], "left")
    v, k = F.col("raw"), F.col("kind")
    value = (
        F.when(k == "num", v.cast("string")).when(k == "bool", sc.bool_text(v)).when(k == "fixed", F.format_string("%.5f", sc.fixed_point(v)))
        .when(k == "enum", F.coalesce("enum_text", lookups.hex_word(v))).when(k == "single", F.format_string("%.5f", sc.float32(v)))
        .when(k == "double", F.format_string("%.5f", sc.float64(v, sc.read_uint(d, F.col("place") + 4, 4))))
        .when(k == "quality", sc.save_quality(v).cast("string")).when(k == "format", sc.save_format(v)).when(k == "scans", sc.save_scans(v))
        .when(k == "wide", sc.length_prefixed_wide(d, F.col("place"))).when(k == "utf8", F.decode("data", "UTF-8"))
        .when(k == "place", F.col("place").cast("string"))
    )
    return f.select(
        "path", "seq", "bim_id", (F.col("n") + F.col("i") * F.col("per")).cast("int").alias("n"), "field", value.alias("value")
    )


def iptc_records(resources: DataFrame, dim: DataFrame) -> DataFrame:
    """Named IPTC datasets with value text out of resource 0x0404."""
    iptc = resources.where("bim_id = 1028").select("path", F.col("data").alias("block"))
    rows = lookups.name_iptc(walk_rows(iptc, walks.iptc_datasets, F.col("block"), "path"), dim)
    return rows.select("path", "seq", "record", "dataset", "name", "len", lookups.iptc_value(F.col("type"), F.col("data")).alias("value"))


def psd_layers(files: DataFrame) -> DataFrame:
    """One row per layer; the extra keys that carry a number, flag or name become columns."""
    s = psd_sections(files).where("layer_len > 0").select("path", _section("layer_at", "layer_len").alias("section"))
    rows = walk_rows(s, walks.psd_layers, F.col("section"), "path").drop("seq")

    def extra(key: str) -> Column:
        return F.get(F.filter("extra", lambda e: e["key"] == key), 0)["data"]

    def flag(key: str) -> Column:
        return sc.bool_text(sc.read_uint(extra(key), 0, 4))

    return rows.select(
        "path", "layer", "transparency", (F.col("right") - F.col("left")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"),
        "complete", "chans", "blend_sig", enum_text("blend_mode", F.col("blend_key")).alias("blend_mode"), "opacity", "mask_len", "ranges", "name",
        sc.length_prefixed_wide(extra("luni"), F.lit(0)).alias("unicode_name"), sc.read_uint(extra("lnsr"), 0, 4).alias("name_source"),
        sc.read_uint(extra("lyid"), 0, 4).alias("layer_id"), flag("clbl").alias("blend_clipped"), flag("infx").alias("blend_interior"),
        flag("knko").alias("knockout"),
    )


def psd_global_mask(files: DataFrame) -> DataFrame:
    """path, offset, len, color_space, c1..c4, opacity, kind: the global mask of layered documents, one row where one is stored.

    It follows the layer records inside their section; fields that the file does not have are null.
    """
    c = F.col("content")
    s = psd_sections(files).where("layer_len > 4").withColumn("offset", F.col("layer_at") + 8 + sc.read_uint(c, F.col("layer_at") + 4, 4))
    s = s.where(F.col("offset") + 4 <= F.col("layer_at") + 4 + F.col("layer_len")).withColumn("len", sc.read_uint(c, F.col("offset"), 4)).where("len > 0")
    field = lambda skip, width: F.when(F.col("len") >= skip + width, sc.read_uint(c, F.col("offset") + 4 + skip, width))
    return s.select(
        "path", "offset", "len", field(0, 4).alias("color_space"), *[field(4 + 2 * i, 2).alias(f"c{i + 1}") for i in range(4)],
        field(12, 2).alias("opacity"), field(14, 1).alias("kind"),
    )


# --- DICOM ---------------------------------------------------------------------------------------

def dicom_elements(files: DataFrame, tags: DataFrame, enums: DataFrame, places: bool = False) -> DataFrame:
    """Named data elements, those inside sequences too; items of encapsulated pixel data that hold an image get its offset.

    Pixel data inside a sequence (a small preview, say) counts for no image. ``places`` adds depth, parent (seq of the
    sequence that holds the element, -1 outside) and item.
    """
    rows = walk_rows(files, walks.dicom_elements, F.col("content"), "path")
    kind = (
        F.when((F.col("grp") == 0x7FE0) & (F.col("elem") == 0x0010) & F.col("undefined") & (F.col("depth") == 0), "start")
        .when(F.col("pixels") & (F.col("elem") == 0xE000), "item").when(F.col("pixels") & (F.col("elem") == 0xE0DD), "end").otherwise("other")
    )
    # all elements of a file come out of one record array, so a plain window per file is enough
    flagged = chains.encapsulated_items(rows.withColumn("kind", kind), span=None)
    text = F.regexp_replace(F.substring_index(F.decode("data", "ISO-8859-1"), "\x00", 1), "[^\\x20-\\x7e]", "")
    out = lookups.describe_dicom(lookups.name_dicom(flagged.withColumn("value", text), tags), enums)
    return out.select(
        "path", "seq", "offset", "grp", "elem", "name", "known", "vr", "vr_explicit", "len", "value", "text", "is_offset_table", "is_jpeg",
        F.when(F.col("is_jpeg"), F.col("offset") + 8).alias("jpeg_offset"), *(["depth", "parent", "item"] if places else []),
    )


def first_dicom_image(elements: DataFrame) -> DataFrame:
    """Only the first encapsulated image of a file counts."""
    return elements.where("is_jpeg").groupBy("path").agg(F.min("jpeg_offset").alias("jpeg_offset"))
