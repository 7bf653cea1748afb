import random

import pytest
from pyspark.sql import functions as F

from pixsieve.operators import carving as cv
from pixsieve.sources.dims import STD_QUANT_LUMA, ZIGZAG


def all_hits(data: bytes, needle: bytes):
    return [i for i in range(len(data) - len(needle) + 1) if data[i : i + len(needle)] == needle]


@pytest.fixture(scope="module")
def blobs():
    rng = random.Random(3)
    out = {f"r{n}": bytes(rng.choice(b"\xff\xd8\x00a") for _ in range(n)) for n in (0, 1, 2, 3, 15, 16, 17, 255, 256, 257, 700, 2000)}
    out["same"] = b"\xff" * 600
    out["edge"] = b"x" * 254 + b"\xff\xd8\xff\xd8\xff" + b"y" * 300
    return out


def test_find_all_matches_brute_force(files_of, blobs):
    needles = [b"\xff\xd8\xff", b"\xff", b"aa", b"\xff\xd8\xff\x00a\xd8"]
    got = {(r.path, r.needle_no, r.pos) for r in cv.find_all(files_of(blobs), needles).collect()}
    assert got == {(p, i, h) for p, d in blobs.items() for i, n in enumerate(needles) for h in all_hits(d, n)}


def test_find_all_crosses_cells(files_of):
    rng = random.Random(9)
    blobs = {str(n): bytes(rng.choice(b"ab") for _ in range(n)) for n in (511, 512, 513, 1500)}
    got = {(r.path, r.pos) for r in cv.find_all(files_of(blobs), [b"abba"]).collect()}
    assert got == {(p, h) for p, d in blobs.items() for h in all_hits(d, b"abba")}


def test_find_all_reads_ahead(files_of, blobs):
    rows = cv.find_all(files_of(blobs), [b"\xff\xd8"], ahead=2).collect()
    assert rows
    for r in rows:
        assert bytes(r.ahead) == blobs[r.path][r.pos + 2 : r.pos + 4]


def test_scan_census_of_a_scan(files_of):
    scan = b"\x12\xff\x00\xff\xd0\x34\xff\xff\xd2\xff\xd9\xff"
    got = [(r.pos, r.kind) for r in cv.scan_census(files_of({"s": scan})).orderBy("pos").collect()]
    assert got == [(1, "stuffed"), (3, "restart"), (6, "pad"), (7, "restart"), (9, "marker"), (11, "end")]


def test_carve_number_and_name(spark, files_of):
    soi, eoi = b"\xff\xd8\xff", b"\xff\xd9"
    two = b"junk" + soi + b"AAAA" + eoi + b"junk" + soi + b"BB"
    files = files_of({"two": two, "none": b"nothing here"})
    frames = {(r.pos, r.end_pos, r.terminated) for r in cv.carve_extents(files).collect()}
    assert frames == {(4, 13, True), (17, 22, False)}
    ignoring = {(r.pos, r.end_pos) for r in cv.carve_extents(files, ignore_end=True).collect()}
    assert ignoring == {(4, 17), (17, 22)}
    numbered = cv.number_frames(cv.carve_extents(files), F.lit(True), max_size=6)
    got = cv.frame_bytes(numbered, files).select("frame_no", "written", "frame", cv.frame_name(F.col("path"), F.col("frame_no")).alias("name")).orderBy("frame_no").collect()
    assert [(r.frame_no, r.written, bytes(r.frame), r.name) for r in got] == [
        (1, False, two[4:13], "two.000001.jpg"), (2, True, two[17:], "two.000002.jpg")]


def test_start_offsets_exclude_the_start(files_of):
    soi = b"\xff\xd8\xff"
    rows = {r.path: r for r in cv.start_offsets(files_of({"at0": soi + b"xx" + soi, "later": b"ab" + soi, "no": b"abc", "only": soi, "empty": b""})).collect()}
    assert {p: (r.start, r.srch1, r.srch2) for p, r in rows.items()} == {
        "at0": (0, 0, 5), "later": (0, 2, 2), "no": (0, 0, 0), "only": (0, 0, 0), "empty": (0, 0, 0)}


def test_hunt_matches_brute_force(spark, files_of):
    rng = random.Random(11)
    table = [1 + rng.randrange(250) for _ in range(64)]
    wide = [300 + i for i in range(64)]
    std_zz = bytes(STD_QUANT_LUMA[z] for z in ZIGZAG)
    pre1, pre2, le4 = bytes(table), b"".join(v.to_bytes(2, "big") for v in table), b"".join(v.to_bytes(4, "little") for v in table)
    blobs = {
        "a": rng.randbytes(37) + pre1 + rng.randbytes(70) + pre2 + pre1, "b": le4, "c": rng.randbytes(5) + std_zz, "d": pre1[:-1], "e": b"",
        "f": b"".join(v.to_bytes(2, "little") for v in wide) * 2,
    }
    tables = spark.createDataFrame([("t", table), ("w", wide), ("flat", [7] * 64)], "table_id STRING, table ARRAY<INT>").unionByName(cv.standard_table(spark))
    needles = cv.hunt_needles(tables)
    lens = {(r.table_id, r.form): bytes(r.needle) for r in needles.collect()}
    assert ("w", "pre-1") not in lens and not any(t == "flat" for t, _ in lens)
    assert lens["t", "pre-2"] == pre2 and lens["t", "pre-4s"] == le4 and lens["standard", "post-1"] == std_zz
    got = {(r.path, r.table_id, r.form, r.pos) for r in cv.hunt(files_of(blobs), needles).collect()}
    assert got == {(p, t, f, h) for p, d in blobs.items() for (t, f), n in lens.items() for h in all_hits(d, n)}
    assert {g[0] for g in got} == {"a", "b", "c", "f"}


def test_hunt_of_a_table_that_many_images_share(spark, files_of):
    rng = random.Random(12)
    table = [1 + rng.randrange(250) for _ in range(64)]
    blobs = {f"z{i}": bytes(4000) for i in range(20)} | {"hit": bytes(77) + bytes(table) + bytes(500)}  # zero blocks dominate
    needles = cv.hunt_needles(spark.createDataFrame([(f"t{i}", table) for i in range(50)], "table_id STRING, table ARRAY<INT>"))
    hits = cv.hunt_hits(files_of(blobs), needles)
    assert [(r.path, r.pos, bytes(r.needle)) for r in hits.collect()] == [("hit", 77, bytes(table))]
    named = cv.hunt(files_of(blobs), needles).collect()
    assert {r.table_id for r in named} == {f"t{i}" for i in range(50)} and {r.pos for r in named} == {77}


def test_hex_rows_and_container(files_of):
    files = files_of({"short": b"AB\x00", "long": bytes(range(200)), "empty": b"", "psd": b"8BPS\x00\x01", "avi": b"RIFF0000AVI ",
                      "jpg": b"\xff\xd8\xff", "dcm": b"\x00" * 128 + b"DICM", "psd2": b"8BPS\x00\x02"})
    rows = {}
    for r in cv.hex_rows(files).orderBy("path", "off").collect():
        rows.setdefault(r.path, []).append((r.hex_text.strip(), r.ascii_text, r.in_line))
    assert rows["short"] == [("41 42 00", "AB.             ", True)]
    assert len(rows["long"]) == 9 and rows["long"][-1][0] == "..." and "empty" not in rows
    kinds = {r.path: r.k for r in files.select("path", cv.container_kind(F.col("content")).alias("k")).collect()}
    assert kinds == {"short": "unknown", "long": "unknown", "empty": "unknown", "psd": "psd", "psd2": "unknown", "avi": "avi", "jpg": "jpeg", "dcm": "dicom"}


def test_tables_go_in_before_the_scan(files_of):
    f = files_of({"a": b"\xff\xd8\xff\xe9\xff\xdaXX", "b": b"\xff\xc4\xff\xdaXX", "c": b"zz"}).withColumnRenamed("content", "frame")
    got = {r.path: (r.has_tables, bytes(r.frame)) for r in cv.insert_tables(f, b"TAB").collect()}
    assert got == {"a": (False, b"\xff\xd8\xff\xe9TAB\xff\xdaXX"), "b": (True, b"\xff\xc4\xff\xdaXX"), "c": (False, b"zz")}


SOI, EOI = b"\xff\xd8", b"\xff\xd9"


def segment(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


def camera(thumbnail: bytes, tables: bool = True) -> bytes:
    """A JPEG whose APP1 holds a whole small JPEG."""
    dht = segment(0xC4, b"\x00" * 17) if tables else b""
    return SOI + segment(0xE1, b"Exif\x00\x00" + thumbnail) + segment(0xDB, bytes(65)) + dht + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + b"ab\xff\x00cd\xff\xd0ef" + EOI


def test_frames_end_at_their_own_eoi(files_of):
    thumb = SOI + segment(0xC4, bytes(17)) + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + b"t" + EOI
    one, two = camera(thumb), camera(thumb, tables=False)
    data = b"junk" + one + b"between" + two + b"x" + one[:60]
    got = cv.jpeg_frames(files_of({"f": data, "none": b"no picture", "empty": b""})).orderBy("frame_no").collect()
    assert [(r.path, r.frame_no, r.terminated, r.has_tables) for r in got] == [("f", 1, True, True), ("f", 2, True, False), ("f", 3, False, False)]
    assert [bytes(r.frame) for r in got] == [one, two, one[:60]]
    assert [r.scan_at for r in got] == [one.rindex(b"\xff\xda"), two.rindex(b"\xff\xda"), -1]
    fixed = cv.insert_tables(cv.jpeg_frames(files_of({"f": two})), b"TAB").collect()[0]
    at = two.rindex(b"\xff\xda")
    assert bytes(fixed.frame) == two[:at] + b"TAB" + two[at:]


def test_forced_marks(files_of):
    whole = camera(b"")
    cut = whole[2:-2]
    got = cv.jpeg_frames(files_of({"f": cut}), force_soi=True, force_eoi=True).collect()
    assert [(bytes(r.frame), r.terminated) for r in got] == [(whole, False)]
    two = cv.jpeg_frames(files_of({"f": whole + b"tail" + whole}), ignore_end=True).orderBy("frame_no").collect()
    assert [bytes(r.frame) for r in two] == [whole + b"tail", whole]


def test_cut_frames_equal_joined_extents(spark, files_of):
    rng = random.Random(8)
    blobs = {f"f{i}": b"".join(rng.choice([b"<p", b"<p>", b"</p>", b"x", b"<", b"p>"]) for _ in range(n)) for i, n in enumerate((0, 1, 5, 40, 200, 200))}
    f = files_of(blobs)
    for ignore in (False, True):
        extents = cv.carve_extents(f, b"<p", b"</p>", ignore_end=ignore)
        want = {(r.path, r.pos, r.end_pos, r.terminated and not ignore) for r in extents.collect()}
        got = cv.cut_frames(f, b"<p", b"</p>", ignore_end=ignore, unended=True).collect()
        assert {(r.path, r.pos, r.end_pos, r.terminated) for r in got} == want
        assert all(blobs[r.path][r.pos : r.end_pos] == bytes(r.frame) for r in got)
    numbered = cv.number_frames(cv.carve_extents(f, b"<p", b"</p>"), F.col("terminated"), 9)
    want = {(r.path, r.pos, r.frame_no, r.written) for r in numbered.collect()}
    got = cv.cut_frames(f, b"<p", b"</p>", max_size=9)
    assert {(r.path, r.pos, r.frame_no, r.written) for r in got.collect()} == want and got.where("written <> (frame IS NOT NULL)").count() == 0
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
