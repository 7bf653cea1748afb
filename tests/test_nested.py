"""Nested and chunked records in hand-packed files: movies, sequences, profiles, damaged tags."""

import struct

from pyspark.sql import functions as F

from pixsieve.operators import carving as cv
from pixsieve.operators import extract as ex
from pixsieve.operators import walks
from pixsieve.sources import dims


def rows_of(spark, files_of, walk, blobs):
    got = files_of(blobs).select("path", F.inline(walk("content"))).collect()
    return {p: [r for r in got if r.path == p] for p in blobs}


# --- movies --------------------------------------------------------------------------------------

BARE = b"\xff\xd8\xff\xda\x00\x02scan\xff\xd9"
WITH = b"\xff\xd8\xff\xc4\x00\x04\x00\x07\xff\xda\x00\x02scan\xff\xd9"


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def listed(name, kind, *parts):
    return chunk(name, kind + b"".join(parts))


def movie(frames, absolute=False, grouped=False, index=True):
    parts = [chunk(b"01wb", b"sound") + chunk(b"00dc", f) for f in frames]
    body = [listed(b"LIST", b"rec ", *parts[:2]), *parts[2:]] if grouped else parts
    head = listed(b"LIST", b"hdrl", chunk(b"avih", b"\x00" * 8))
    whole = listed(b"RIFF", b"AVI ", head, listed(b"LIST", b"movi", *body))
    at, entries, base = 0, b"", whole.index(b"movi")
    for k, f in enumerate(frames):
        at = whole.index(b"00dc" + struct.pack("<I", len(f)) + f, at + 1)
        entries += b"00dc" + struct.pack("<III", 16 if k == 0 else 0, at - (0 if absolute else base), len(f))
    return listed(b"RIFF", b"AVI ", head, listed(b"LIST", b"movi", *body), chunk(b"idx1", entries)) if index else whole


def test_movie_frames(spark, files_of):
    frames = [BARE, WITH, b"no jpeg", BARE + b"x"]
    blobs = {
        "plain": movie(frames), "absolute": movie(frames, absolute=True), "grouped": movie(frames, grouped=True), "bare": movie(frames, index=False),
        "two": movie(frames) + listed(b"RIFF", b"AVIX", listed(b"LIST", b"movi", chunk(b"00dc", WITH))), "cut": movie(frames, index=False)[:-5],
        "odd": b"RIFF\xff\xff\xff\xffAVI LIST\xff\xff\xff\xffmovi00dc\xff\xff\xff\xffabc", "empty": b"", "jpeg": BARE,
    }
    got = {}
    for r in ex.avi_frames(files_of(blobs)).collect():
        got.setdefault(r.path, []).append(r)
    for p in ("plain", "absolute", "grouped", "bare"):
        own = sorted(got[p], key=lambda r: r.frame_no)
        assert [bytes(r.frame) for r in own] == frames
        assert [r.indexed for r in own] == [p != "bare"] * 4 and [r.key for r in own] == [p != "bare", False, False, False]
        assert [(r.jpeg, r.has_tables, r.scan_at) for r in own] == [(True, False, 2), (True, True, 8), (False, False, -1), (True, False, 2)]
        assert all(r.complete and blobs[p][r.pos : r.pos + r.len] == bytes(r.frame) for r in own)
    assert [bytes(r.frame) for r in sorted(got["two"], key=lambda r: r.frame_no)] == [*frames, WITH]
    assert [r.complete for r in sorted(got["cut"], key=lambda r: r.frame_no)] == [True, True, True, False]
    assert [(bytes(r.frame), r.complete) for r in got["odd"]] == [(b"abc", False)]
    assert set(got) == {"plain", "absolute", "grouped", "bare", "two", "cut", "odd"}
    audit = {r.path: (r.frames, r.indexed, r.stray, r.agree) for r in ex.avi_index_audit(files_of(blobs)).collect()}
    assert audit["plain"] == (4, 4, 0, True) and audit["bare"] == (4, 0, 0, False) and audit["two"] == (5, 4, 0, False)


def test_movie_frames_get_tables(spark, files_of):
    out = cv.insert_tables(ex.avi_frames(files_of({"m": movie([BARE, WITH, b"no jpeg"])})), b"TABLE")
    assert [bytes(r.frame) for r in sorted(out.collect(), key=lambda r: r.frame_no)] == [b"\xff\xd8TABLE" + BARE[2:], WITH, b"no jpeg"]


# --- sequences -----------------------------------------------------------------------------------

def element(grp, elem, vr, body, undefined=False, explicit=True):
    n = 0xFFFFFFFF if undefined else len(body)
    head = struct.pack("<HH", grp, elem)
    if not explicit:
        return head + struct.pack("<I", n) + body
    return head + vr + (struct.pack("<HI", 0, n) if vr in (b"SQ", b"OB", b"UN") else struct.pack("<H", n)) + body


def item(body, undefined=False):
    if undefined:
        return struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + body + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    return struct.pack("<HHI", 0xFFFE, 0xE000, len(body)) + body


SEQUENCE_END = struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)


def sequence(items, undefined=False, explicit=True):
    return element(0x40, 0xA730, b"SQ", b"".join(items) + (SEQUENCE_END if undefined else b""), undefined, explicit)


def test_three_levels_with_and_without_lengths(spark, files_of):
    leaf = element(8, 0x104, b"LO", b"leaf")
    head = b"\x00" * 128 + b"DICM"
    blobs = {}
    for inner in (False, True):
        for middle in (False, True):
            for outer in (False, True):
                deep = sequence([item(leaf, inner)], inner)
                mid = sequence([item(leaf), item(deep + leaf, middle)], middle)
                blobs[f"{inner}{middle}{outer}"] = head + sequence([item(mid, outer), item(b""), item(leaf)], outer) + leaf
    for p, got in rows_of(spark, files_of, walks.dicom_elements, blobs).items():
        leaves = [(r.depth, r.item) for r in got if (r.grp, r.elem) == (8, 0x104)]
        assert leaves == [(2, 1), (3, 1), (2, 2), (1, 3), (0, 0)], p
        sequences = [k for k, r in enumerate(got) if r.vr == "SQ"]
        parents = [r.parent for r in got if (r.grp, r.elem) == (8, 0x104)]
        assert parents == [sequences[1], sequences[2], sequences[1], sequences[0], -1], p
        assert all(bytes(r.data) == b"leaf" for r in got if r.elem == 0x104)


def test_sequences_without_vrs_and_pixels_inside(spark, files_of):
    head = b"\x00" * 128 + b"DICM"
    leaf = element(8, 0x104, b"", b"leaf", explicit=False)
    jpeg = lambda d: element(0x7FE0, 0x10, b"OB", item(b"") + item(d) + SEQUENCE_END, True)
    blobs = {
        "implicit": head + sequence([item(leaf), item(leaf, True)], False, False) + leaf,
        "preview": head + sequence([item(jpeg(b"\xff\xd8in"))]) + element(8, 0x70, b"LO", b"ab") + jpeg(b"\xff\xd8out"),
        "looks": head + element(9, 1, b"UN", struct.pack("<HHI", 0xFFFE, 0xE000, 99)) + element(9, 2, b"", struct.pack("<HHI", 0xFFFE, 0xE000, 99), explicit=False),
        "cut": (head + sequence([item(leaf)], True, False))[:-9],
    }
    got = rows_of(spark, files_of, walks.dicom_elements, blobs)
    assert [(r.depth, r.item) for r in got["implicit"] if r.elem == 0x104] == [(1, 1), (1, 2), (0, 0)]
    assert [r.depth for r in got["looks"]] == [0, 0] and [len(r.data) for r in got["looks"]] == [8, 8]
    assert [r.depth for r in got["cut"]][:3] == [0, 1, 1]
    elements = ex.dicom_elements(files_of(blobs), dims.dim_dicom(spark), dims.dim_dicom_enum(spark))
    first = {r.path: r.jpeg_offset for r in ex.first_dicom_image(elements).collect()}
    assert first == {"preview": blobs["preview"].index(b"\xff\xd8out")}


# --- profiles ------------------------------------------------------------------------------------

def profiled(*chunks):
    segments = [b"\xff\xe2" + struct.pack(">H", len(d) + 16) + b"ICC_PROFILE\x00" + bytes([no, n]) + d for no, n, d in chunks]
    return b"\xff\xd8" + b"\xff\xe2\x00\x06FPXR" + b"".join(segments) + b"\xff\xd9"


def test_profiles_from_chunks(spark, files_of):
    big = [(i, 255, bytes([i]) * 60_000) for i in range(1, 256)]
    blobs = {
        "one": profiled((1, 1, b"abc")), "turned": profiled((3, 3, b"c"), (1, 3, b"a"), (2, 3, b"b")), "twice": profiled((1, 2, b"a"), (1, 2, b"x"), (2, 2, b"b")),
        "missing": profiled((1, 3, b"a"), (3, 3, b"c")), "none": profiled(), "zero": profiled((0, 0, b"a")), "quarrel": profiled((1, 2, b"a"), (2, 3, b"b"), (3, 3, b"c")),
        "beyond": profiled((1, 1, b"a"), (2, 1, b"b")), "big": profiled(*big), "empty": b"",
    }
    got = {r.path: r for r in ex.icc_profiles(files_of(blobs)).collect()}
    assert set(got) == set(blobs) - {"none", "empty"}
    whole = {p: bytes(r.data) for p, r in got.items() if r.complete}
    assert whole == {"one": b"abc", "turned": b"abc", "twice": b"ab", "big": b"".join(d for _, _, d in big)}
    assert all((r.data is None) == (not r.complete) for r in got.values())
    assert {p: (list(r.missing), r.repeated, r.in_order) for p, r in got.items() if p in ("turned", "twice", "missing")} == {
        "turned": ([], 0, False), "twice": ([], 1, True), "missing": ([2], 0, True)}


# --- damage --------------------------------------------------------------------------------------

def test_endless_tags_stay_within_the_block(spark, files_of):
    entries = b"".join(struct.pack("<HHII", 0x100 + i, 7, 0xFFFFFFFF, 8) for i in range(4900))
    block = b"II*\x00\x08\x00\x00\x00" + struct.pack("<H", 4900) + entries + b"\x00" * 4
    got = rows_of(spark, files_of, walks.tiff_tags, {"b": block})["b"]
    assert len(got) == 4900 and not any(r.complete for r in got) and sum(len(r.data) for r in got) <= 2 * len(block)
    shared = struct.pack("<HHII", 0x11A, 5, 1, 38) + struct.pack("<HHII", 0x11B, 5, 1, 38)
    block = b"II*\x00\x08\x00\x00\x00\x02\x00" + shared + b"\x00" * 4 + struct.pack("<II", 300, 1)
    got = rows_of(spark, files_of, walks.tiff_tags, {"b": block})["b"]
    assert [(r.complete, list(r.nums)) for r in got] == [(True, [300, 1])] * 2


def test_extended_iptc_lengths(spark, files_of):
    plain = b"\x1c\x02\x05\x00\x03abc"
    blobs = {
        "four": b"\x1c\x02\x19\x80\x04" + struct.pack(">I", 5) + b"12345" + plain, "big": b"\x1c\x02\x19\x80\x04" + struct.pack(">I", 70_000) + b"x" * 70_000 + plain,
        "none": b"\x1c\x02\x19\x80\x00" + plain, "wide": b"\x1c\x02\x19\xff\xff" + plain, "cut": b"\x1c\x02\x19\x80\x04\xff\xff\xff\xffab", "short": plain + b"\x1c\x02\x19\x80\x04\x00",
    }
    got = {p: [(r.len, len(r.data)) for r in rows] for p, rows in rows_of(spark, files_of, walks.iptc_datasets, blobs).items()}
    assert got == {"four": [(5, 5), (3, 3)], "big": [(70_000, 70_000), (3, 3)], "none": [], "wide": [], "cut": [(0x7FFFFFFF, 2)], "short": [(3, 3)]}


def test_endless_section_lengths_end_no_job(spark, files_of):
    head = b"8BPS\x00\x01" + b"\x00" * 6 + struct.pack(">HIIHH", 3, 1, 1, 8, 3)
    endless = b"\xff\xff\xff\xff"
    blobs = {"mode": head + endless + b"x" * 9, "resources": head + b"\x00" * 4 + endless + b"8BIM\x04\x04\x00\x00" + endless + b"\x1c\x02", "layers": head + b"\x00" * 8 + endless + b"\x00\x00\x00\x20\x00\x01" + b"\x7f" * 30,
             "cut": head}
    f = files_of(blobs)
    assert {r.path for r in ex.psd_header(f).collect()} == set(blobs)
    resources = ex.psd_resources(f, dims.dim_resource(spark))
    assert [(r.path, r.bim_id, r.complete) for r in resources.collect()] == [("resources", 1028, False)]
    assert ex.iptc_records(resources, dims.dim_iptc(spark)).count() == 0
    assert ex.resource_fields(resources, dims.dim_resource_fields(spark), dims.dim_psd_enum(spark)).count() == 0
    assert [(r.path, r.complete) for r in ex.psd_layers(f).collect()] == [("layers", False)]
    wide = spark.createDataFrame([(bytearray(endless + b"ab"),)], "c BINARY")
    from pixsieve.functions import scalars as sc
    assert [tuple(r) for r in wide.select(sc.length_prefixed_ascii(F.col("c"), F.lit(0)), sc.length_prefixed_wide(F.col("c"), F.lit(0)), sc.fixed_string(F.col("c"), F.lit(1 << 40), F.lit(1 << 40))).collect()]
