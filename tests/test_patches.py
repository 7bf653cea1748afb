"""Patches as winning segments, against laying them one after the other."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pixsieve.operators import patches as pt

COLUMNS = "path STRING, ordinal INT, start INT, len INT, data BINARY"


def test_patches_highest_ordinal_wins(spark, files_of):
    rng = random.Random(5)
    blobs = {f"f{i}": bytes(rng.randrange(256) for _ in range(n)) for i, n in enumerate((0, 3, 40, 200))}
    patches = []
    for p in blobs:
        for o in range(12):
            data = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 9)))
            patches.append((p, o, rng.randrange(0, 60), len(data), bytearray(data)))
    df = spark.createDataFrame(patches, "path STRING, ordinal INT, start INT, len INT, data BINARY")
    want = {}
    for p, content in blobs.items():
        out = bytearray(content)
        for _, o, s, n, data in sorted((x for x in patches if x[0] == p), key=lambda x: x[1]):
            for i, b in enumerate(data):
                if s + i < len(out):
                    out[s + i] = b
        want[p] = bytes(out)
    got = {r.path: bytes(r.content) for r in pt.apply_patches(files_of(blobs), df).collect()}
    assert got == want
    clean = {r.path: bytes(r.content) for r in pt.apply_patches(files_of(blobs), df, clean=True).collect()}
    assert clean == blobs
    winners = {(r.path, r.off): r.value for r in pt.patched_bytes(df).collect()}
    assert all(want[p][o] == v for (p, o), v in winners.items() if o < len(want[p]))


def test_no_patch_is_too_long_or_too_late(spark, files_of):
    body = bytes(range(256)) * 4
    rows = [("f", 600, 5, 600, bytearray(b"\x01" * 600)), ("f", 3, 0, 40, bytearray(b"\x02" * 40)), ("g", 1, 1020, 9, bytearray(b"\x03" * 9)), ("none", 0, 0, 1, bytearray(b"\x04"))]
    patches = spark.createDataFrame(rows, "path STRING, ordinal INT, start INT, len INT, data BINARY")
    got = {r.path: bytes(r.content) for r in pt.apply_patches(files_of({"f": body, "g": body, "h": body}), patches).collect()}
    assert got == {"f": b"\x02" * 5 + b"\x01" * 600 + body[605:], "g": body[:1020] + b"\x03" * 4, "h": body}


def test_untouched_files_stay_out_of_shuffles(spark, files_of):
    patches = spark.createDataFrame([("f", 0, 0, 1, bytearray(b"z"))], "path STRING, ordinal INT, start INT, len INT, data BINARY")
    plan = pt.apply_patches(files_of({"f": b"abc"}), patches)._jdf.queryExecution().executedPlan().toString()
    bare = plan.split("Union")[1].split("MapInArrow")[0]
    assert "BroadcastHashJoin" in bare and "hashpartitioning(path" not in bare.split("MapInArrow")[0].split("BroadcastExchange")[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 15), st.integers(0, 5)), max_size=12))
def test_sweep_gives_disjoint_winners(raw):
    own = [(start, start + size, start, ordinal, size) for start, size, ordinal in raw]
    want = {}
    for begin, stop, start, ordinal, size in sorted(own, key=lambda p: (p[3], p[2], p[4])):
        want.update((at, (start, ordinal, size)) for at in range(begin, stop))
    got, behind = {}, -1
    for begin, stop, *patch in pt.sweep(own):
        assert behind <= begin < stop
        behind = stop
        got.update((at, tuple(patch)) for at in range(begin, stop))
    assert got == want


def test_sweep_costs_by_patches_not_bytes():
    own = [(i, i + (1 << 30), i, i, 1 << 30) for i in range(2000)]
    segments = list(pt.sweep(own))
    assert len(segments) == 2000 and segments[-1][:2] == (1999, 1999 + (1 << 30))


def test_empty_null_and_outlying_patches(spark, files_of):
    rows = [("f", 0, 1, 0, bytearray(b"")), ("f", 1, 2, 0, None), ("f", None, 0, 1, bytearray(b"n")), ("f", 2, None, 1, bytearray(b"n")),
            ("f", 3, -2, 4, bytearray(b"wxyz")), ("f", 4, 900, 2, bytearray(b"zz")), (None, 5, 0, 1, bytearray(b"q"))]
    patches = spark.createDataFrame(rows, COLUMNS)
    got = {r.path: r.content and bytes(r.content) for r in pt.apply_patches(files_of({"f": b"abcdef", "g": b""}), patches).collect()}
    assert got == {"f": b"yzcdef", "g": b""}
    assert pt.apply_patches(files_of({"f": b"abc"}), patches.limit(0)).collect()[0].content == b"abc"


def test_equal_patches_are_one(spark, files_of):
    rows = [("f", 1, 1, 2, bytearray(b"ab")), ("f", 1, 1, 2, bytearray(b"zz")), ("f", 1, 1, 2, bytearray(b"mm"))]
    got = pt.apply_patches(files_of({"f": b"......"}), spark.createDataFrame(rows, COLUMNS)).collect()
    assert [bytes(r.content) for r in got] == [b".zz..."]


def test_long_patches_cross_spans(spark, monkeypatch):
    monkeypatch.setattr(pt, "SPAN", 1 << 20)
    size = 5 << 20
    long = spark.range(1).selectExpr("'f' AS path", "1 AS ordinal", "100 AS start", f"cast(repeat('L', {size}) AS binary) AS data")
    over = spark.createDataFrame([("f", 2, 2 << 20, 3, bytearray(b"new")), ("f", 0, 0, 200, bytearray(b"o" * 200))], "path STRING, ordinal INT, start INT, len INT, data BINARY").drop("len")
    patches = long.unionByName(over)
    files = spark.range(1).selectExpr("'f' AS path", f"cast(repeat('.', {size + 1000}) AS binary) AS content")
    body = bytes(pt.apply_patches(files, patches).collect()[0].content)
    want = bytearray(b"o" * 100 + b"L" * size + b"." * 900)
    want[2 << 20 : (2 << 20) + 3] = b"new"
    assert body == bytes(want)
    assert pt.winning_segments(patches).count() <= 10


def test_a_much_patched_file_is_swept_by_spans(spark, monkeypatch):
    monkeypatch.setattr(pt, "SPAN", 64)
    patches = spark.range(2000).selectExpr("'f' AS path", "int(id) AS ordinal", "int((id * 37) % 1000) AS start", "cast(repeat(char(65 + id % 26), 1 + int(id % 40)) AS binary) AS data")
    want = bytearray(b"." * 1100)
    for r in sorted(patches.collect(), key=lambda r: r.ordinal):
        want[r.start : r.start + len(r.data)] = r.data
    files = spark.range(1).selectExpr("'f' AS path", "cast(repeat('.', 1100) AS binary) AS content")
    assert bytes(pt.apply_patches(files, patches).collect()[0].content) == bytes(want)
