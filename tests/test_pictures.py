"""Picture rows of packed layered documents: raw and run-length channels, layers, damage."""

import random
import struct

import numpy as np

from pixsieve.operators import pictures as pc


def runs(line: bytes, rng) -> bytes:
    """A run-length coding of a line, in pieces of random size."""
    out, at = b"", 0
    while at < len(line):
        same = 1
        while at + same < len(line) and same < 120 and line[at + same] == line[at]:
            same += 1
        if same > 1:
            out += bytes([257 - same, line[at]])
            at += same
        else:
            n = min(rng.randint(1, 9), len(line) - at)
            out += bytes([n - 1]) + line[at : at + n]
            at += n
    return out


def plane_set(planes, method, rng):
    lines = [bytes(row) for p in planes for row in p]
    if method == 0:
        return struct.pack(">H", 0) + b"".join(lines)
    coded = [runs(x, rng) for x in lines]
    return struct.pack(">H", 1) + b"".join(struct.pack(">H", len(c)) for c in coded) + b"".join(coded)


def document(planes, method, layers=(), depth=8, rng=random.Random(1)):
    """layers: (planes by channel id, method)."""
    records, pixels = b"", b""
    for own, how in layers:
        h, w = next(iter(own.values())).shape
        parts = {c: plane_set([p], how, rng) for c, p in own.items()}
        extra = struct.pack(">II", 0, 0) + b"\x01L\x00\x00"
        records += struct.pack(">iiiiH", 5, 5, 5 + h, 5 + w, len(own)) + b"".join(struct.pack(">HI", c, len(p)) for c, p in parts.items())
        records += b"8BIMnorm" + b"\xff\x00\x00\x00" + struct.pack(">I", len(extra)) + extra
        pixels += b"".join(parts.values())
    info = struct.pack(">h", len(layers)) + records + pixels
    section = struct.pack(">I", len(info)) + info if layers else b""
    h, w = planes[0].shape if planes else (0, 0)
    w = w * 8 // depth if depth > 1 else w * 8
    head = b"8BPS" + struct.pack(">H6xHIIHH", 1, len(planes), h, w, depth, 3)
    return head + struct.pack(">III", 0, 0, len(section)) + section + plane_set(planes, method, rng)


def noise(h, w, seed, flat=True):
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 3 if flat else 256, (h, w), np.uint8)
    out[:, : w // 2] = out[:, :1]
    return out


def lines_of(spark, files_of, blobs):
    rows = pc.expanded_rows(pc.picture_rows(files_of(blobs))).collect()
    return {(r.path, r.layer, r.chan, r.y): (None if r.samples is None else [x for x in r.samples], r.expanded, r.ok) for r in rows}


def test_layers_and_the_merged_picture(spark, files_of):
    planes = [noise(6, 31, c) for c in range(4)]
    layers = [({0: noise(4, 9, 10), 1: noise(4, 9, 11), 2: noise(4, 9, 12), 0xFFFF: noise(4, 9, 13), 0xFFFE: noise(4, 9, 14)}, m) for m in (0, 1)]
    blobs = {f"m{m}": document(planes, m, layers) for m in (0, 1)}
    got = lines_of(spark, files_of, blobs)
    want = {}
    for p in blobs:
        want |= {(p, -1, c, y): (planes[c][y].tolist(), 31, True) for c in range(4) for y in range(6)}
        want |= {(p, k, c, y): (own[c][y].tolist(), 9, True) for k, (own, _) in enumerate(layers) for c in own if c != 0xFFFE for y in range(4)}
    assert got == want
    for layer, src in ((-1, planes), (1, [layers[1][0][c] for c in range(3)])):
        pixels = {(r.path, r.y, r.x): (r.r, r.g, r.b) for r in pc.pixels(files_of(blobs), layer).collect()}
        h, w = src[0].shape
        assert pixels == {(p, y, x): tuple(int(src[c][y, x]) for c in range(3)) for p in blobs for y in range(h) for x in range(w)}


def test_other_depths(spark, files_of):
    wide, bits = noise(3, 20, 1, False), noise(3, 5, 2, False)
    blobs = {"16raw": document([wide], 0, depth=16), "16runs": document([wide], 1, depth=16), "1raw": document([bits], 0, depth=1), "1runs": document([bits], 1, depth=1)}
    got = lines_of(spark, files_of, blobs)
    for y in range(3):
        assert got["16raw", -1, 0, y] == got["16runs", -1, 0, y] == (wide[y, ::2].tolist(), 10, True)
        assert got["1raw", -1, 0, y] == got["1runs", -1, 0, y] == ((np.unpackbits(bits[y]) * 255).tolist(), 40, True)


def test_damage_is_marked_row_by_row(spark, files_of):
    planes = [noise(5, 40, c, False) for c in range(3)]
    whole = document(planes, 1)
    at = 40 + 2 * 15
    worse = bytearray(whole)
    worse[at] = worse[at] + 1 if worse[at] < 127 or worse[at] > 128 else worse[at] - 1
    blobs = {"bent": bytes(worse), "cut": document(planes, 0)[:-50], "odd": b"8BPS\x00\x01" + b"\x00" * 6 + struct.pack(">HIIHH", 3, 1 << 30, 1 << 30, 8, 3) + b"\x00" * 12 + b"\x00\x01\x00\x05",
             "method": whole[:38] + b"\x00\x02" + whole[40:], "head": whole[:30], "none": b"", "layer": document(planes, 0, [({0: noise(4, 9, 1)}, 0)])[:60]}
    audit = {(r.path, r.layer, r.chan): (r.rows, r.bad) for r in pc.row_audit(files_of(blobs)).collect()}
    assert audit["bent", -1, 0][1] >= 1 and audit["bent", -1, 1] == audit["bent", -1, 2] == (5, 0)
    assert audit["cut", -1, 0] == audit["cut", -1, 1] == (5, 0) and audit["cut", -1, 2] == (4, 2)
    assert audit["method", -1, -1] == (0, 5)
    assert audit["odd", -1, 0] == (0, 1 << 30)
    assert not {p for p, *_ in audit} & {"head", "none"}


def test_a_bomb_of_runs_is_counted_not_kept():
    data = bytes([129, 7]) * 30_000
    kept, size = pc.unpack_runs(data, 10)
    assert (kept, size) == (b"\x07" * 10, 128 * 30_000)
