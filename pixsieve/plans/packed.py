"""Binary files packed by Spark from the given tables, one file per row, for the extraction queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixsieve.plans import inputs as inp
from pixsieve.sources.dims import STD_QUANT_LUMA

CHUNK = 60000


def hx(text: str) -> Column:
    return F.unhex(F.lit(text.replace(" ", "")))


def be(v: Column | int, width: int) -> Column:
    v = F.lit(v) if isinstance(v, int) else v
    return F.unhex(F.lpad(F.hex(v.cast("bigint")), 2 * width, "0"))


def ordered(v: Column | int, width: int, little: Column) -> Column:
    """Number in the byte order of the file."""
    v = F.lit(v) if isinstance(v, int) else v
    big = F.lpad(F.hex(v.cast("bigint")), 2 * width, "0")
    small = F.concat(*[F.substring(big, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.unhex(F.when(little, small).otherwise(big))


def text(v: Column | str, width: int | None = None) -> Column:
    """Bytes of a text, zero-padded to ``width``."""
    raw = F.encode(F.lit(v) if isinstance(v, str) else v, "UTF-8")
    if width is None:
        return raw
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), F.lit(width) - F.length(raw))))


def sealed(content: Column, name: str) -> Column:
    """A generated column: the packing expression is evaluated once and is not copied into later filters."""
    return F.explode(F.array(content)).alias(name)


def jpeg_files(spark, sf_dir: str) -> DataFrame:
    """Documents as comment segments of a small JPEG: path, content."""
    d = inp.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("b"), F.md5("text").alias("m"))
    n = F.length("b")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(CHUNK)))
    parts = F.transform(starts, lambda s: F.hex(F.concat(hx("FFFE"), be(F.least(n - s, F.lit(CHUNK)) + 2, 2), F.substring("b", s + 1, F.lit(CHUNK)))))
    table = "".join(f"{v:02X}" for v in STD_QUANT_LUMA)
    content = F.concat(
        hx("FFD8 FFE0 0010 4A46494600 0102 00 0048 0048 0000"), F.unhex(F.coalesce(F.array_join(parts, ""), F.lit(""))),
        hx("FFDB 0043 00" + table), hx("FFC0 000B 08 0010 0010 01 01 11 00"), hx("FFDA 0008 01 01 00 00 3F 00"),
        text(F.col("m")), hx("FF00 78 FFD0 79 FFD9"),
    )
    return d.select("path", sealed(content, "content"))


def coded_files(spark, sf_dir: str) -> DataFrame:
    """Blocks as JPEG headers: an 8-bit and a 16-bit table in one DQT, two Huffman tables in one DHT, DRI, SOS."""
    b = inp.block_arrays(spark, sf_dir)
    key, q = F.col("block_id"), F.col("q")
    narrow = F.unhex(F.array_join(F.transform(q, lambda v: F.lpad(F.hex(1 + F.abs(v) % 255), 2, "0")), ""))
    wide = F.unhex(F.array_join(F.transform(q, lambda v: F.lpad(F.hex(1 + F.abs(v) * 97), 4, "0")), ""))
    b = b.select("*", sealed(narrow, "narrow"), ).select("*", sealed(wide, "wide"))
    n2 = key % 3
    counts = F.concat(hx("00"), be(n2, 1), hx("02" + "00" * 13))
    values = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), (n2 + 2).cast("int")), lambda i: F.lpad(F.hex(i * 16), 2, "0")), ""))
    dht = F.concat(hx("00"), counts, values, hx("11" + "00" * 15 + "01" + "7F"))
    content = F.concat(
        hx("FFD8 FFDB 00C4 00"), "narrow", hx("11"), "wide",
        hx("FFC0 0011 08"), be(key % 500 + 16, 2), be(key % 700 + 8, 2), hx("03 01"), F.when(key % 2 == 0, hx("22")).otherwise(hx("11")), hx("00 021101 031101"),
        hx("FFC4"), be(F.length(dht) + 2, 2), dht, F.when(key % 4 > 0, F.concat(hx("FFDD 0004"), be(key % 4, 2))).otherwise(hx("")),
        hx("FFDA 000C 03 0100 0211 0311 00 3F 00 A5 FFD9"),
    )
    return b.select(key.alias("path"), sealed(content, "content"))


def tiff_blocks(spark, sf_dir: str) -> DataFrame:
    """Parts as TIFF blocks in both byte orders: path, data."""
    p = inp.spread(spark, sf_dir, "part")
    le = F.col("p_partkey") % 2 == 0
    size = F.col("p_size")

    def o(v, width):
        return ordered(v, width, le)

    def entry(tag: int, typ: int, count, value: Column) -> list[Column]:
        return [o(tag, 2), o(typ, 2), o(count, 4), value]

    def short(v) -> Column:
        return F.concat(o(v, 2), hx("0000"))

    lat = [size, F.col("p_partkey") % 60, F.col("p_partkey") % 6000]
    lon = [size * 2, F.col("p_partkey") % 59, F.col("p_partkey") % 5999]
    ns = F.when(F.col("p_partkey") % 3 == 0, hx("53000000")).otherwise(hx("4E000000"))
    ew = F.when(F.col("p_partkey") % 5 == 0, hx("57000000")).otherwise(hx("45000000"))
    parts = [
        F.when(le, hx("4949")).otherwise(hx("4D4D")), o(42, 2), o(8, 4),
        o(6, 2), *entry(0x010F, 2, F.length("p_brand") + 1, o(86, 4)), *entry(0x0110, 2, F.length("p_type") + 1, o(118, 4)),
        *entry(0x0112, 3, 1, short(size % 8 + 1)), *entry(0x8769, 4, 1, o(150, 4)), *entry(0x8825, 4, 1, o(208, 4)),
        *entry(0xC0DE, 4, 1, o(F.col("p_partkey"), 4)), o(310, 4),
        text(F.col("p_brand"), 32), text(F.col("p_type"), 32),
        o(3, 2), *entry(0x829A, 5, 1, o(192, 4)), *entry(0x829D, 5, 1, o(200, 4)), *entry(0x8827, 3, 1, short(size * 10)), o(0, 4),
        o(1, 4), o(size + 1, 4), o(size, 4), o(10, 4),
        o(4, 2), *entry(1, 2, 2, ns), *entry(2, 5, 3, o(262, 4)), *entry(3, 2, 2, ew), *entry(4, 5, 3, o(286, 4)), o(0, 4),
        *[c for v, den in zip(lat, (1, 1, 100)) for c in (o(v, 4), o(den, 4))],
        *[c for v, den in zip(lon, (1, 1, 100)) for c in (o(v, 4), o(den, 4))],
        o(2, 2), *entry(0x0201, 4, 1, o(340, 4)), *entry(0x0202, 4, 1, o(size, 4)), o(0, 4),
        F.unhex(F.repeat(F.lit("FF"), size)),
    ]
    return p.select(F.col("p_partkey").alias("path"), sealed(F.concat(*parts), "data"))


def exif_files(spark, sf_dir: str) -> DataFrame:
    """TIFF blocks wrapped into the APP1 segment of a JPEG: path, content."""
    t = tiff_blocks(spark, sf_dir)
    return t.select("path", F.concat(hx("FFD8FFE1"), be(F.length("data") + 8, 2), text("Exif"), hx("0000"), F.col("data"), hx("FFD9")).alias("content"))


def icc_profiles(spark, sf_dir: str) -> DataFrame:
    """Orders as ICC profile headers: path, data."""
    o = inp.spread(spark, sf_dir, "orders")
    at = F.col("o_orderdate")
    stamp = [f(at) for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second)]
    space = F.when(F.col("o_orderstatus") == "O", text("RGB ")).otherwise(text("GRAY"))
    parts = [
        be(F.col("o_custkey") + 128, 4), text("lcms"), hx("02 40 00 00"), text("mntr"), space, text("XYZ "), *[be(s, 2) for s in stamp],
        text("acsp"), text("MSFT"), be(F.col("o_orderkey") % 2, 4), text(F.rpad("o_orderpriority", 4, " ")), text("mdl1"), hx("00" * 8),
        be(F.col("o_orderkey") % 4, 4), hx("00" * 12), text("crea"), hx("00" * 44),
    ]
    return o.select(F.col("o_orderkey").alias("path"), sealed(F.concat(*parts), "data"))


def _block(bim_id: int, name: str, data: Column) -> Column:
    """One 8BIM resource; name and data are padded to even lengths."""
    head = hx("3842494D" + f"{bim_id:04X}" + f"{len(name):02X}" + name.encode().hex() + ("" if len(name) % 2 else "00"))
    return F.concat(head, be(F.length(data), 4), data, F.when(F.length(data) % 2 == 1, hx("00")).otherwise(hx("")))


def _iptc(record: int, dataset: int, data: Column) -> Column:
    return F.concat(hx(f"1C{record:02X}{dataset:02X}"), be(F.length(data), 2), data)


def psd_files(spark, sf_dir: str) -> DataFrame:
    """Parts as layered documents with nine resources: path, content."""
    p = inp.spread(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    header = F.concat(hx("38425053 0001 000000000000 0003"), be(size, 4), be(size + 1, 4), hx("0008"), be(key % 10, 2))
    mode = F.when(key % 10 == 2, F.concat(be(768, 4), F.unhex(F.repeat(F.lit("AB"), F.lit(768))))).otherwise(be(0, 4))
    wide = F.concat(be(F.length("p_name"), 4), F.encode("p_name", "UTF-16BE"))
    res = F.concat(
        _block(0x03ED, "", F.concat(be(size * 65536 + 32768, 4), hx("0001 0002"), be(F.lit(72 * 65536), 4), hx("0002 0009"))),
        _block(0x0404, "", F.concat(_iptc(2, 0, be(size, 2)), _iptc(2, 5, text(F.col("p_name"))), _iptc(2, 25, text(F.col("p_type"))), _iptc(9, 99, text("?")), hx("00"))),
        _block(0x0406, "ab", F.concat(be((key + 65533) % 65536, 2), be(key % 3, 2), be(key % 4, 2))),
        _block(0x0408, "", F.concat(hx("00000001 00000240 00000240 00000002"), be(size, 4), hx("00"), be(size * 2, 4), hx("01"))),
        _block(0x07D1, "path", text(F.col("p_brand"))),
        _block(0x0421, "", F.concat(hx("00000001 01"), wide, wide, be(key, 4))),
        _block(0x0426, "", F.concat(be(key % 3, 2), hx("3FC00000 C0200000 3F800000"))),
        _block(0x0428, "", hx("00000001 3FF8000000000000")),
        _block(0x042D, "", F.concat(be(2, 2), be(key, 4), be(size, 4))),
    )
    blend = F.when(key % 3 == 0, text("norm")).when(key % 3 == 1, text("mul ")).otherwise(text("zzzz"))

    def extra_key(k: str, data: Column) -> Column:
        fill = F.when(F.length(data) % 4 > 0, F.unhex(F.repeat(F.lit("00"), 4 - F.length(data) % 4))).otherwise(hx(""))
        return F.concat(text("8BIM" + k), be(F.length(data), 4), data, fill)

    def layer(i: int, name: Column) -> Column:
        room = F.unhex(F.repeat(F.lit("00"), 3 - F.length(name) % 4))
        extra = F.concat(
            hx("00000000"), hx("00000010" + "00" * 16), be(F.length(name), 1), text(name), room,
            extra_key("luni", wide), extra_key("lyid", be(key + i, 4)), extra_key("knko", hx("00000001")),
        )
        return F.concat(
            be(0, 4), be(0, 4), be(size + i, 4), be(size, 4), hx("0002 0000"), be(size, 4), hx("FFFF"), be(size + 2, 4),
            text("8BIM"), blend, be(size * 4, 1), hx("000000"), be(F.length(extra), 4), extra)

    p = p.select("*", sealed(res, "res"))
    p = p.select("*", sealed(layer(0, F.col("p_name")), "layer0"))
    p = p.select("*", sealed(layer(1, F.col("p_brand")), "layer1"))
    p = p.select("*", sealed(F.concat(F.when(key % 2 == 0, hx("FFFE")).otherwise(hx("0002")), "layer0", "layer1"), "layers"))
    info = F.concat(be(F.length("layers"), 4), "layers")
    content = F.concat(header, mode, be(F.length("res"), 4), "res", be(F.length(info), 4), info, hx("0000"))
    return p.select(key.alias("path"), sealed(content, "content"))


def dicom_files(spark, sf_dir: str) -> DataFrame:
    """Parts as encapsulated DICOM files: path, content."""
    p = inp.spread(spark, sf_dir, "part")
    le = F.lit(True)

    def o(v, width):
        return ordered(v, width, le)

    def even(v: Column, filler: str) -> Column:
        return F.when(F.length(v) % 2 == 1, F.concat(v, hx(filler))).otherwise(v)

    uid = even(text(F.when(F.col("p_partkey") % 2 == 0, "1.2.840.10008.1.2.4.50").otherwise("1.2.840.10008.1.2.1")), "00")
    brand = even(text(F.col("p_brand")), "20")
    frame = F.concat(hx("FFD8FF"), F.unhex(F.repeat(F.lit("11"), F.col("p_size") * 2 + 1)))
    parts = [
        hx("00" * 128), text("DICM"),
        hx("0200 1000"), text("UI"), o(F.length(uid), 2), uid,
        hx("0800 7000"), text("LO"), o(F.length(brand), 2), brand,
        hx("0900 0100"), text("UN"), hx("0000"), o(4, 4), o(F.col("p_partkey"), 4),
        hx("2800 0000"), o(4, 4), o(F.col("p_size"), 4),
        hx("E07F 1000"), text("OB"), hx("0000 FFFFFFFF"),
        hx("FEFF 00E0 00000000"),
        hx("FEFF 00E0"), o(F.length(frame), 4), frame,
        hx("FEFF 00E0"), o(4, 4), hx("FFD8FF00"),
        hx("FEFF DDE0 00000000"),
    ]
    return p.select(F.col("p_partkey").alias("path"), sealed(F.concat(*parts), "content"))
