"""Hand-packed byte files with rows written by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from pixsieve.operators import extract as ex
from pixsieve.sources import dims


def seg(code: int, data: bytes) -> bytes:
    return b"\xff" + bytes([code]) + struct.pack(">H", len(data) + 2) + data


def minimal_jpeg(scan: bytes = b"\x12\x34") -> bytes:
    return (b"\xff\xd8" + seg(0xE0, b"JFIF\0\x01\x02\0\0\x01\0\x01\0\0") + seg(0xDB, b"\0" + bytes(64)) + seg(0xC0, b"\x08\0\x08\0\x08\x01\x01\x11\0")
            + seg(0xC4, b"\0" + bytes(16)) + seg(0xDA, b"\x01\x01\0\0\x3f\0") + scan + b"\xff\xd9")


def test_jpeg_segments(files_of):
    cut = minimal_jpeg()[:30]
    rows = ex.jpeg_segments(files_of({"min": minimal_jpeg(), "rst": minimal_jpeg(b"\x01\xff\x00\xff\xd0\x02\xff\xd2"), "cut": cut, "bad": b"\xff\xd8hello", "empty": b""})).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.seq):
        by.setdefault(r.path, []).append((r.marker, r.offset, r.len, r.complete))
    assert [m[0] for m in by["min"]] == ["SOI", "APP0", "DQT", "SOF0", "DHT", "SOS", "scan", "EOI"]
    assert by["min"][6] == ("scan", len(minimal_jpeg()) - 4, 2, True)
    assert by["rst"][6][0::2] == ("scan", 8)
    assert by["cut"] == [("SOI", 0, 0, True), ("APP0", 2, 16, True), ("DQT", 20, 67, False)]
    assert by["bad"] == [("SOI", 0, 0, True), ("missing", 2, 0, False)]
    assert "empty" not in by


def test_tables_of_a_header(spark, files_of):
    dqt = seg(0xDB, b"\0" + bytes(range(1, 65)) + b"\x11" + struct.pack(">64H", *range(300, 364)) + b"\x02" + bytes([9] * 64))
    dht = seg(0xC4, b"\x00" + bytes([0, 2, 1] + [0] * 13) + b"abc" + b"\x11" + bytes([1] + [0] * 15) + b"z")
    sof = seg(0xC0, b"\x08\0\x10\0\x20\x03" + b"\x01\x21\x00" + b"\x02\x11\x01" + b"\x03\x11\x01")
    sos = seg(0xDA, b"\x03\x01\x00\x02\x11\x03\x11\0\x3f\0")
    again = seg(0xDB, b"\0" + bytes([7] * 64))
    jpeg = b"\xff\xd8" + dqt + sof + seg(0xDD, b"\0\x05") + dht + sos + b"\x01\xff\xd9"
    cut = b"\xff\xd8" + seg(0xDB, b"\0" + bytes(range(1, 65)) + b"\x11short") + b"\xff\xd9"
    h = ex.header_segments(files_of({"a": jpeg, "b": b"\xff\xd8" + dqt + again + sof + b"\xff\xd9", "cut": cut})).cache()
    f = ex.frames(h).where("path = 'a'").collect()[0]
    assert (f.precision, f.height, f.width, f.ncomp) == (8, 16, 32, 3) and [tuple(c) for c in f.comps] == [(1, 2, 1, 0), (2, 1, 1, 1), (3, 1, 1, 1)]
    s = ex.scans(h).collect()
    assert len(s) == 1 and (s[0].ns, s[0].rst_interval, s[0].se) == (3, 5, 63) and [tuple(c) for c in s[0].comps] == [(1, 0, 0), (2, 1, 1), (3, 1, 1)]
    q = {(r.path, r.seq, r.dest_id): (r.precision, list(r.table_zz)) for r in ex.quantisation_tables(h).collect()}
    assert q["a", 1, 0] == (8, list(range(1, 65))) and q["a", 1, 1] == (16, list(range(300, 364))) and q["a", 1, 2][1] == [9] * 64
    assert len([k for k in q if k[0] == "cut"]) == 1 and q["b", 2, 0][1] == [7] * 64
    t = ex.huffman_lists(h).where("path = 'a'").orderBy("class", "idx").collect()
    assert [(r["class"], r.dest_id, r.bitlen, chr(r.value)) for r in t] == [(0, 0, 2, "a"), (0, 0, 2, "b"), (0, 0, 3, "c"), (1, 1, 1, "z")]
    g = {r.image_id: r for r in ex.image_signatures(h).collect()}
    assert len(g) == 3 and g["a"].csig != g["b"].csig and g["a"].csig != g["a"].csig_rot
    h.unpersist()


def test_maker_note_that_reads_like_a_directory(spark, files_of):
    maker = struct.pack("<H", 1) + struct.pack("<HHI", 6, 2, 4) + b"abc\0" + struct.pack("<I", 0)
    exif = struct.pack("<H", 1) + struct.pack("<HHII", 0x927C, 7, len(maker), 44) + struct.pack("<I", 0)
    ifd = struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 26) + struct.pack("<I", 0)
    data = b"II" + struct.pack("<HI", 42, 8) + ifd + exif + maker
    junk = data[:44] + b"\xff" * len(maker)
    rows = ex.exif_tags(files_of({"m": data, "j": junk}).withColumnRenamed("content", "data"), dims.dim_exif(spark)).collect()
    assert sorted((r.path, r.section, r.name) for r in rows if r.section == "maker") == [("m", "maker", "Unknown Tag 0x0006")]


def tiff(order: str) -> bytes:
    e = "<" if order == "II" else ">"
    gps_at, data_at = 62, 104
    ent = lambda tag, typ, n, v: struct.pack(e + "HHI", tag, typ, n) + v
    short = lambda v: struct.pack(e + "H", v) + b"\0\0"
    long = lambda v: struct.pack(e + "I", v)
    ifd = struct.pack(e + "H", 4) + ent(0x010F, 2, 6, long(data_at)) + ent(0x0112, 3, 1, short(6)) + ent(0x8825, 4, 1, long(gps_at)) + ent(0xC0DE, 9, 1, struct.pack(e + "i", -5)) + long(0)
    gps = struct.pack(e + "H", 3) + ent(1, 2, 2, b"S\0\0\0") + ent(2, 5, 3, long(data_at + 6)) + ent(5, 1, 1, b"\x01\0\0\0") + long(0)
    head = order.encode() + struct.pack(e + "HI", 42, 8)
    body = head + ifd
    body += b"\0" * (gps_at - len(body)) + gps
    return body + b"\0" * (data_at - len(body)) + b"Canon\0" + struct.pack(e + "6I", 10, 1, 30, 1, 3600, 100)


@pytest.mark.parametrize("order", ["II", "MM"])
def test_exif_in_both_byte_orders(spark, files_of, order):
    jpeg = b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + tiff(order)) + seg(0xE1, b"http://other") + b"\xff\xd9"
    blocks = ex.segment_data(files_of({"f": jpeg}), 0xE1, b"Exif\0\0")
    rows = ex.exif_tags(blocks, dims.dim_exif(spark)).orderBy("seq").collect()
    assert [(r.section, r.name, r.is_unknown, r.value) for r in rows] == [
        ("ifd0", "Make", False, "Canon"), ("ifd0", "Orientation", False, "6"), ("ifd0", "GPSOffset", False, "62"),
        ("ifd0", "Unknown Tag 0xC0DE", True, "-5"), ("gps", "GPSLatitudeRef", False, "S"), ("gps", "GPSLatitude", False, "10/1,30/1,3600/100"),
        ("gps", "GPSAltitudeRef", False, "1")]
    assert ex.gps_position(blocks).select(F.round("lat", 6)).collect()[0][0] == -10.51


def test_looping_directories_end(spark, files_of):
    loop = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 8) + struct.pack("<I", 8)
    df = files_of({"f": loop, "short": b"II", "none": b""}).withColumnRenamed("content", "data")
    assert ex.exif_tags(df, dims.dim_exif(spark)).count() == 1


def res(bim_id: int, name: bytes, data: bytes) -> bytes:
    n = bytes([len(name)]) + name
    n += b"\0" * (len(n) % 2)
    return b"8BIM" + struct.pack(">H", bim_id) + n + struct.pack(">I", len(data)) + data + b"\0" * (len(data) % 2)


def psd(resources: bytes, layers: bytes = b"") -> bytes:
    head = b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 2, 2, 8, 3) + struct.pack(">I", 0)
    return head + struct.pack(">I", len(resources)) + resources + struct.pack(">I", len(layers)) + layers


def test_psd_resources_payloads_and_iptc(spark, files_of):
    iptc = b"\x1c\x02\x05\x00\x03abc" + b"\x1c\x01\x00\x00\x02\x00\x04" + b"\x1c\x02\xca\x00\x01x" + b"zz\x1c\x02\x05\x00\x01q"
    blob = psd(
        res(0x03ED, b"", struct.pack(">IHHIHH", 72 << 16, 1, 1, (72 << 16) + 0x8000, 1, 2)) + res(0x0404, b"", iptc) + res(0x0406, b"q", b"\xff\xfd\x01\x01\x00\x03")
        + res(0x0408, b"", struct.pack(">IIII", 1, 5, 6, 2) + struct.pack(">IB", 9, 0) + struct.pack(">IB", 8, 1)) + res(0x07D1, b"odd", b"xyz")
        + res(0x0402, b"", b"\0\1\0\2") + res(0x0430, b"", b"\1\0") + res(0x03F3, b"", bytes([1, 0, 0, 0, 0, 0, 0, 0, 1])) + res(0x9999, b"", b"?"))
    bad = psd(b"8BIM" + struct.pack(">HHI", 0x03ED, 0, 500) + b"short")
    files = files_of({"h": blob, "bad": bad, "junk": psd(b"XXXX0000000000")})
    r = ex.psd_resources(files, dims.dim_resource(spark))
    got = {(x.path, x.seq): x for x in r.collect()}
    assert got["h", 4].name == "Path Information (saved paths)" and got["h", 4].own_name == "odd" and got["h", 4].len == 3
    assert got["h", 0].offset == 34 and got["h", 8].name is None
    assert got["bad", 0].complete is False and got["junk", 0].bim_id == -1
    f = ex.resource_fields(r.where("path = 'h'"), dims.dim_resource_fields(spark), dims.dim_psd_enum(spark)).orderBy("bim_id", "n").collect()
    fields = {}
    for x in f:
        fields.setdefault(x.bim_id, []).append((x.field, x.value))
    assert fields[0x03ED][0] == ("h_resolution", "72.00000") and fields[0x03ED][3:5] == [("v_resolution", "72.50000"), ("v_unit", "pixels per inch")]
    assert fields[0x0406] == [("quality", "1"), ("format", "Progressive"), ("scans", "5 Scans")]
    assert fields[0x0408][4:] == [("location", "9"), ("direction", "vertical"), ("location", "8"), ("direction", "horizontal")]
    assert fields[0x0402] == [("layer_group", "1"), ("layer_group", "2")] and fields[0x0430] == [("layer_enabled", "1"), ("layer_enabled", "0")]
    assert fields[0x03F3][0] == ("labels", "true") and fields[0x03F3][1] == ("crop_marks", "false") and len(fields[0x03F3]) == 9
    i = ex.iptc_records(r, dims.dim_iptc(spark)).orderBy("seq").collect()
    assert [(x.name, x.value) for x in i] == [("Object Name", '"abc"'), ("Model Version", "4"), ("ObjectData Preview Data", "???")]
    h = ex.psd_header(files).where("path = 'h'").collect()[0]
    assert (h.version, h.channels, h.height, h.width, h.depth, h.color_mode) == (1, 3, 2, 2, 8, "RGB")


def test_psd_layers(files_of):
    name, luni = b"bg", struct.pack(">I", 2) + "bg".encode("utf-16-be")
    extra = struct.pack(">I", 0) + struct.pack(">I", 0) + bytes([len(name)]) + name + b"\0" + b"8BIMluni" + struct.pack(">I", len(luni)) + luni
    extra += b"8BIMlyid" + struct.pack(">II", 4, 77) + b"8BIMclbl" + struct.pack(">I", 4) + b"\0\0\0\0"
    rec = struct.pack(">IIIIH", 1, 2, 5, 9, 1) + struct.pack(">HI", 0xFFFF, 10) + b"8BIMscrn" + bytes([200, 0, 0, 0]) + struct.pack(">I", len(extra)) + extra
    body = struct.pack(">h", -1) + rec
    r = ex.psd_layers(files_of({"p": psd(b"", struct.pack(">I", len(body)) + body), "flat": psd(b"")})).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.transparency, r.width, r.height, r.blend_mode, r.opacity, r.name, r.unicode_name, r.layer_id) == (True, 7, 4, "screen", 200, "bg", "bg", 77)
    assert (r.blend_clipped, r.knockout) == ("false", None) and [(c.id, c.len) for c in r.chans] == [(0xFFFF, 10)]


def test_dicom_elements_and_first_image(spark, files_of):
    el = lambda g, e, rest: struct.pack("<HH", g, e) + rest
    blob = (b"\0" * 128 + b"DICM" + el(2, 0x10, b"UI" + struct.pack("<H", 20) + b"1.2.840.10008.1.2.1\0") + el(9, 1, struct.pack("<I", 2) + b"zz")
            + el(0x7FE0, 0x10, b"OB\0\0" + b"\xff" * 4) + el(0xFFFE, 0xE000, struct.pack("<I", 4) + b"\0" * 4) + el(0xFFFE, 0xE000, struct.pack("<I", 2) + b"AB")
            + el(0xFFFE, 0xE000, struct.pack("<I", 2) + b"CD") + el(0xFFFE, 0xE0DD, struct.pack("<I", 0)))
    native = b"\0" * 128 + b"DICM" + el(0x7FE0, 0x10, b"OW\0\0" + struct.pack("<I", 3) + b"abc") + el(0xFFFE, 0xE000, struct.pack("<I", 0))
    e = ex.dicom_elements(files_of({"d": blob, "native": native, "no": b"x" * 200}), dims.dim_dicom(spark), dims.dim_dicom_enum(spark))
    rows = {(r.path, r.seq): r for r in e.collect()}
    assert rows["d", 0].text == "Explicit VR Little Endian" and rows["d", 1].known is False and rows["d", 1].name == "??? (0009,0001)"
    assert [rows["d", i].is_jpeg for i in range(7)] == [False, False, False, False, True, True, False]
    assert rows["d", 3].is_offset_table and not rows["native", 1].is_jpeg and not any(p == "no" for p, _ in rows)
    assert [(r.path, r.jpeg_offset) for r in ex.first_dicom_image(e).collect()] == [("d", rows["d", 4].offset + 8)]


def test_icc_header(files_of):
    data = bytearray(160)
    data[0:4], data[4:8], data[8:10], data[12:16], data[16:20], data[20:24] = struct.pack(">I", 160), b"ADBE", b"\x02\x10", b"mntr", b"RGB ", b"XYZ "
    data[24:36], data[36:40], data[64:68] = struct.pack(">6H", 1999, 6, 3, 0, 1, 2), b"acsp", struct.pack(">I", 1)
    bad = bytearray(data)
    bad[26:28] = b"\x00\x63"
    rows = {r.path: r for r in ex.icc_header(files_of({"ok": data, "bad": bad, "short": b"x"}).withColumnRenamed("content", "data")).collect()}
    assert set(rows) == {"ok", "bad"}
    r = rows["ok"]
    assert (r.size, r.cmm, r.version, r.intent, r.signature_ok, str(r.created)) == (160, "ADBE", "2.1", 1, True, "1999-06-03 00:01:02")
    assert rows["bad"].created is None


def test_long_values_stay_whole(spark, files_of):
    el = lambda g, e, rest: struct.pack("<HH", g, e) + rest
    blob = b"\0" * 128 + b"DICM" + el(0x10, 0x4000, b"UT\0\0" + struct.pack("<I", 5000) + b"x" * 5000) + el(0x10, 0x20, b"LO" + struct.pack("<H", 4) + b"id12")
    e = ex.dicom_elements(files_of({"d": blob}), dims.dim_dicom(spark), dims.dim_dicom_enum(spark)).orderBy("seq").collect()
    assert [(r.name, r.len, len(r.value)) for r in e] == [("Patient Comments", 5000, 5000), ("Patient ID", 4, 4)]


def layered(name: str, box=(0, 0, 4, 4)) -> bytes:
    wide = struct.pack(">I", len(name)) + name.encode("utf-16-be")
    extra = struct.pack(">II", 0, 0) + b"\0\0\0\0" + b"8BIMluni" + struct.pack(">I", len(wide)) + wide + b"\0" * (-len(wide) % 4)
    record = struct.pack(">iiiiH", *box, 1) + struct.pack(">HI", 0, 2) + b"8BIMnorm" + b"\xff\0\0\0" + struct.pack(">I", len(extra)) + extra
    info = struct.pack(">h", 1) + record
    info = struct.pack(">I", len(info)) + info
    return b"8BPS\0\1" + b"\0" * 6 + struct.pack(">HIIHH", 3, 4, 4, 8, 3) + struct.pack(">I", 0) + struct.pack(">I", 0) + struct.pack(">I", len(info)) + info


def test_layers_signed_whole_and_cut(files_of):
    name = "n" * 1000
    whole = layered(name, (-5, -5, 10, 10))
    blobs = {"whole": whole} | {f"cut{k:04}": whole[:k] for k in range(40, len(whole), 37)}
    rows = {r.path: r for r in ex.psd_layers(files_of(blobs)).collect()}
    r = rows["whole"]
    assert (r.width, r.height, r.unicode_name, r.complete) == (15, 15, name, True)
    assert all(not r.complete for p, r in rows.items() if p != "whole")


def test_damaged_tags_end_no_job(spark, files_of):
    def block(count: int, typ: int = 4, tail: bytes = b"") -> bytes:
        return b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 0x0201, typ, count, 8) + struct.pack("<HHII", 0x0112, 3, 1, 6) + struct.pack("<I", 0) + tail

    blobs = {f"{c:x}-{t}": block(c, t) for c in (0xFFFFFFFF, 0x7FFFFFFF, 0, 3) for t in range(0, 14)}
    good = block(1)
    blobs |= {f"cut{k}": good[:k] for k in range(len(good))} | {"text": b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHII", 0x0201, 2, 3, 0) + b"1,2"}
    tags = ex.exif_tags(files_of(blobs).withColumnRenamed("content", "data"), dims.dim_exif(spark))
    rows = tags.collect()
    assert sum(r.path.startswith("ffffffff") for r in rows) == 28 and not any(r.complete for r in rows if r.path.startswith("ffffffff") and r.tag_id == 0x0201)
    moved = tags.withColumn("section", F.lit("ifd1"))
    assert ex.thumbnail_extents(moved).count() > 0


def test_a_later_table_of_one_segment_counts(files_of):
    def jpeg(*tables: int) -> bytes:
        dqt = b"".join(b"\0" + bytes([v]) * 64 for v in tables)
        return b"\xff\xd8\xff\xdb" + struct.pack(">H", len(dqt) + 2) + dqt + b"\xff\xc9\0\x0b\x08\0\x08\0\x08\x01\x01\x11\0\xff\xd9"

    got = {r.image_id: (r.csig, r.csig_rot) for r in ex.image_signatures(ex.header_segments(files_of({"twice": jpeg(7, 9), "once": jpeg(9), "other": jpeg(7)}))).collect()}
    assert got["twice"] == got["once"] != got["other"]
