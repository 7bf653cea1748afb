"""Chain walks inside one blob: a record's place depends on the length of the one before it.

These few functions only emit places, codes and lengths; naming, auditing and statistics are joins
and windows on the rows they give. Each is an Arrow batch UDF from bytes to an array of records.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _records(spec: str) -> T.ArrayType:
    """'name:type ...' to the type of an array of such records."""
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "str": T.StringType(), "bin": T.BinaryType(), "bool": T.BooleanType()}
    fields = []
    for part in spec.split():
        name, kind = part.split(":")
        if kind == "chans":
            typ = T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("len", T.LongType())]))
        elif kind == "keys":
            typ = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("data", T.BinaryType())]))
        elif kind == "nums":
            typ = T.ArrayType(T.LongType())
        else:
            typ = kinds[kind]
        fields.append(T.StructField(name, typ))
    return T.ArrayType(T.StructType(fields))


def walker(spec: str):
    """Turn ``walk(data, *options) -> iterator of tuples`` into a batch UDF; options are columns of one value each.

    A walk checks its bounds and never raises on damaged bytes: it yields what it can read and marks what it can't.
    """
    returns = _records(spec)
    names = [f.name for f in returns.elementType.fields]

    def wrap(walk):
        def records(content: pa.Array, options: list[pa.Array]) -> pa.Array:
            from pyspark.sql.pandas.types import to_arrow_type

            columns, ends = [[] for _ in names], [0]
            settings = [o[0].as_py() for o in options] if len(content) else []
            for v in content:  # one value at a time, so that a batch's bytes are held once beside their records
                for record in walk(v.as_py(), *settings) if v.is_valid else ():
                    for column, value in zip(columns, record):
                        column.append(value)
                ends.append(len(columns[0]))
            out = to_arrow_type(returns)
            fields = [out.value_type.field(i) for i in range(len(names))]
            found = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, type=out)

        def batch(content: pa.Array) -> pa.Array:
            return records(content, [])

        def batch2(content: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
            return records(content, [first, second])

        used = batch if walk.__code__.co_argcount == 1 else batch2
        used.__annotations__ = dict.fromkeys(used.__code__.co_varnames[: used.__code__.co_argcount], pa.Array) | {"return": pa.Array}
        return F.arrow_udf(used, returns)

    return wrap


_AFTER_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)


@walker("code:int offset:long len:long complete:bool")
def jpeg_segments(data: bytes):
    """Marker segments; entropy-coded data follows its SOS as code 0; a missing marker ends with code -1."""
    pos, end = 0, len(data)
    while pos < end:
        if data[pos] != 0xFF:
            yield -1, pos, 0, False
            return
        while pos + 1 < end and data[pos + 1] == 0xFF:
            pos += 1
        if pos + 1 >= end:
            yield -1, pos, 0, False
            return
        code = data[pos + 1]
        if code == 1 or 0xD0 <= code <= 0xD9:
            yield code, pos, 0, True
            pos += 2
            if code == 0xD9:
                return
            continue
        if pos + 4 > end:
            yield code, pos, 0, False
            return
        size = int.from_bytes(data[pos + 2 : pos + 4], "big")
        yield code, pos, size, pos + 2 + size <= end and size >= 2
        pos += 2 + max(size, 2)
        if code == 0xDA and pos < end:
            found = _AFTER_SCAN.search(data, pos)
            stop = found.start() if found else end
            yield 0, pos, stop - pos, found is not None
            pos = stop


def _segments(data: bytes, pos: int):
    """(code, offset, length behind it) of the marker segments from an SOI on; code -1 where the chain breaks off."""
    end = len(data)
    while pos + 1 < end:
        if data[pos] != 0xFF:
            break
        while pos + 1 < end and data[pos + 1] == 0xFF:
            pos += 1
        if pos + 1 >= end:
            break
        code = data[pos + 1]
        if code == 0:
            break
        if code == 1 or 0xD0 <= code <= 0xD9:
            yield code, pos, pos + 2
            pos += 2
            continue
        size = int.from_bytes(data[pos + 2 : pos + 4], "big") if pos + 4 <= end else 0
        if size < 2 or pos + 2 + size > end:
            break
        yield code, pos, pos + 2 + size
        pos += 2 + size
        if code == 0xDA:
            found = _AFTER_SCAN.search(data, pos)
            if found is None:
                pos = end
                break
            pos = found.start()
    yield -1, min(pos, end), min(pos, end)


@walker("pos:long end_pos:long terminated:bool has_tables:bool scan_at:long forced:bool")
def jpeg_frames(data: bytes, ignore_end: bool, force_soi: bool):
    """JPEGs inside a file, one behind the other; what lies inside a frame's segments is not looked into."""
    pos = data.find(b"\xff\xd8\xff")
    if force_soi and pos != 0 and data:
        pos = 0
    while pos >= 0:
        forced = data[pos : pos + 2] != b"\xff\xd8"
        has_tables, scan_at, finish, broke = False, -1, None, len(data)
        for code, at, after in _segments(data, pos):
            if code == 0xC4 and scan_at < 0:
                has_tables = True
            elif code == 0xDA and scan_at < 0:
                scan_at = at - pos + 2 * forced
            elif code == 0xD9:
                finish = after
                break
            elif code == 0xD8 and at > pos:
                broke = at
                break
            elif code == -1:
                broke = at
        behind = broke if finish is None else finish
        following = data.find(b"\xff\xd8\xff", max(behind, pos + 1))
        open_end = following if following >= 0 else len(data)
        stop = open_end if finish is None or ignore_end else finish
        yield pos, stop, finish is not None, has_tables, scan_at, forced
        pos = following


@walker("pos:long end_pos:long terminated:bool")
def marked_frames(data: bytes, start: bytes, end: bytes):
    """Extents from each start mark to behind the first end mark after it, else to the next start mark, else to the end; an
    empty end mark is nowhere."""
    pos, stop = data.find(start), -1
    while pos >= 0:
        following = data.find(start, pos + 1)
        if end and stop is not None and stop <= pos:
            stop = data.find(end, pos + 1)
            stop = None if stop < 0 else stop  # none here is none further on
        ended = bool(end) and stop is not None
        yield pos, stop + len(end) if ended else following if following >= 0 else len(data), ended
        pos = following


_TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_SUB_DIRECTORY = {0x8769: "exif", 0x8825: "gps", 0xA005: "interop"}


_NUMBERS = {1: "B", 3: "H", 4: "I", 5: "I", 6: "b", 8: "h", 9: "i", 10: "i"}


@walker("section:str tag_id:int type:int count:long at:long little:bool complete:bool nums:nums data:bin")
def tiff_tags(data: bytes):
    """Directory entries of a TIFF block with their raw values, numeric ones as numbers too (a fraction as two).

    Sub-directories are followed once, and a maker note where it reads like a directory (offsets from the TIFF start).
    ``complete`` is false where the declared count reaches past the block: the value then holds what is there. Values of a
    block's tags hold twice the block's bytes in all, more than any tags that do not share them; the values beyond, of
    which damaged blocks have many, are left out as incomplete (their place and count are given). A directory that is cut
    off ends, and the next one queued is read.
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return
    todo, seen, room = [("ifd0", struct.unpack(order + "I", data[4:8])[0])], set(), 2 * len(data)
    while todo:
        section, at = todo.pop(0)
        if at in seen or at + 2 > len(data) or at == 0:
            continue
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if section == "maker":
            kinds = [struct.unpack_from(order + "H", data, at + 4 + 12 * i)[0] for i in range(n)] if at + 2 + 12 * n <= len(data) else []
            if not kinds or any(k not in _TYPE_SIZE for k in kinds):
                continue
        for i in range(n):
            e = at + 2 + 12 * i
            if e + 12 > len(data):
                break
            tag, typ, count = struct.unpack_from(order + "HHI", data, e)
            width = _TYPE_SIZE.get(typ, 1)
            size = width * count
            where = e + 8 if size <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
            here = max(0, min(size, len(data) - where))
            if here > 4:
                room -= here
            body = data[where : where + size] if here <= 4 or room >= 0 else b""
            nums = None
            if typ in _NUMBERS:
                held = len(body) // width * (2 if typ in (5, 10) else 1)
                nums = list(struct.unpack_from(f"{order}{held}{_NUMBERS[typ]}", body))
            yield section, tag, typ, count, where, order == "<", len(body) == size, nums, body
            if tag == 0x927C:
                todo.append(("maker", where))
            if tag in _SUB_DIRECTORY and size == 4:
                todo.append((_SUB_DIRECTORY[tag], struct.unpack_from(order + "I", data, e + 8)[0]))
        after = at + 2 + 12 * n
        if section == "ifd0" and after + 4 <= len(data):
            todo.append(("ifd1", struct.unpack_from(order + "I", data, after)[0]))


@walker("bim_id:int name:str offset:long len:long complete:bool data:bin")
def image_resources(data: bytes):
    """8BIM blocks of a resource section; an unknown signature ends the walk with id -1."""
    pos, end = 0, len(data)
    while pos < end:
        if data[pos : pos + 4] != b"8BIM" or pos + 12 > end:
            yield -1, "", pos, 0, False, b""
            return
        bim_id, name_len = struct.unpack_from(">HB", data, pos + 4)
        name = data[pos + 7 : pos + 7 + name_len].decode("latin-1")
        at = pos + 6 + (name_len + 2) // 2 * 2
        size = int.from_bytes(data[at : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        yield bim_id, name, pos, size, at + 4 <= end and len(body) == size, body
        pos = at + 4 + (size + 1) // 2 * 2


@walker("record:int dataset:int offset:long len:int data:bin")
def iptc_datasets(data: bytes):
    """IPTC records; a first byte other than 0x1C ends the block.

    A length with its top bit set is extended: its low bits tell how many bytes (four at most) hold the length itself.
    """
    pos = 0
    while pos + 5 <= len(data) and data[pos] == 0x1C:
        record, dataset, size = struct.unpack_from(">BBH", data, pos + 1)
        at = pos + 5
        if size & 0x8000:
            width = size & 0x7FFF
            if not 0 < width <= 4 or at + width > len(data):
                return
            size = int.from_bytes(data[at : at + width], "big")
            at += width
        yield record, dataset, pos, min(size, 0x7FFFFFFF), data[at : at + size]
        pos = at + size


@walker("layer:int transparency:bool top:long left:long bottom:long right:long chans:chans blend_sig:str blend_key:long opacity:int mask_len:long ranges:int name:str extra:keys complete:bool")
def psd_layers(data: bytes):
    """Layer records of a layer-and-mask section (starting at its layer-info length); coordinates are signed.

    The record at which the section ends too early is given with the fields that are there, ``complete`` false.
    """
    if len(data) < 6 or data[:4] == b"\x00\x00\x00\x00":
        return
    (count,) = struct.unpack_from(">h", data, 4)
    pos = 6
    for i in range(abs(count)):
        box, chans, blend, mask_len, ranges, name, extra = [None] * 4, [], (None, None, None), None, None, None, []
        cut = (i, count < 0)
        if pos + 18 > len(data):
            yield *cut, *box, chans, *blend, mask_len, ranges, name, extra, False
            return
        *box, n = struct.unpack_from(">iiiiH", data, pos)
        pos += 18
        chans = [dict(zip(("id", "len"), struct.unpack_from(">HI", data, pos + 6 * c))) for c in range(min(n, (len(data) - pos) // 6))]
        pos += 6 * n
        if pos + 16 > len(data):
            yield *cut, *box, chans, *blend, mask_len, ranges, name, extra, False
            return
        sig, key, opacity = struct.unpack_from(">4sIB", data, pos)
        blend = (sig.decode("latin-1"), key, opacity)
        (extra_len,) = struct.unpack_from(">I", data, pos + 12)
        pos += 16
        stop = pos + extra_len
        whole = stop <= len(data)
        if pos + 4 <= len(data):
            (mask_len,) = struct.unpack_from(">I", data, pos)
            pos += 4 + mask_len
        if mask_len is not None and pos + 4 <= len(data):
            (range_len,) = struct.unpack_from(">I", data, pos)
            ranges = max(range_len - 8, 0) // 8
            pos += 4 + range_len
        if ranges is not None and pos < len(data):
            name_len = data[pos]
            name = data[pos + 1 : pos + 1 + name_len].decode("latin-1")
            whole = whole and pos + 1 + name_len <= stop
            pos += (name_len + 4) // 4 * 4
        else:
            whole = False
        while whole and pos + 12 <= stop and data[pos : pos + 4] == b"8BIM":
            (size,) = struct.unpack_from(">I", data, pos + 8)
            extra.append({"key": data[pos + 4 : pos + 8].decode("latin-1"), "data": data[pos + 12 : pos + 12 + size]})
            pos += 12 + (size + 3) // 4 * 4
        yield *cut, *box, chans, *blend, mask_len, ranges, name, extra, whole
        if not whole:
            return
        pos = stop


_VR_SHORT = set("AE AS AT CS DA DS DT FL FD IS LO LT PN SH SL SS ST TM UI UL US".split())
_VR_LONG = set("OB OD OF OL OV OW SQ SV UC UN UR UT UV".split())


_ITEM, _ITEM_END, _SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)


@walker("grp:int elem:int vr:str vr_explicit:bool offset:long header:int len:long undefined:bool depth:int parent:int item:int pixels:bool data:bin")
def dicom_elements(data: bytes):
    """Data elements behind the preamble, those inside sequences too, with or without a length, to any depth.

    depth, parent (number of the sequence's own element, -1 outside) and item (from 1) place an element; the items of a
    sequence and what ends them are of the sequence's inner depth. Values are whole, but for sequences, whose contents are
    elements of their own, and pixel data and its items, which stay in the file (place and length are given; ``pixels`` marks
    the items and the end of encapsulated pixel data outside sequences). An undefined length counts as 0; items have no VR.
    Without VRs a value that begins with an item that fits into it is a sequence.
    """
    pos, end, seq = 132, len(data), 0
    if data[128:132] != b"DICM":
        return
    #: open sequences: where they end (none: by their delimiter), own number, items so far, where the open item ends, encapsulated
    stack: list[list] = []
    while pos + 8 <= end:
        while stack and stack[-1][0] is not None and stack[-1][0] <= pos:
            stack.pop()
        grp, elem = tag = struct.unpack_from("<HH", data, pos)
        vr = data[pos + 4 : pos + 6].decode("latin-1")
        mark = tag in (_ITEM, _ITEM_END, _SEQUENCE_END)
        if not mark and vr in _VR_SHORT:
            header, size, explicit = 8, struct.unpack_from("<H", data, pos + 6)[0], True
        elif not mark and vr in _VR_LONG and pos + 12 <= end:
            header, size, explicit = 12, struct.unpack_from("<I", data, pos + 8)[0], True
        else:
            header, size, explicit, vr = 8, struct.unpack_from("<I", data, pos + 4)[0], False, "??"
        undefined = size == 0xFFFFFFFF
        size = 0 if undefined else size
        inside = stack[-1] if stack else None
        if tag == _ITEM and inside:
            inside[2] += 1
        place = (len(stack), inside[1] if inside else -1, inside[2] if inside else 0)
        encapsulated = bool(inside) and inside[3]
        at, opens, skip = pos + header, None, size
        if mark:
            body = data[at : at + min(size, 4)] if encapsulated else b""
            skip = size if encapsulated or not inside else 0
        elif tag == (0x7FE0, 0x0010):
            body, opens = data[at : at + min(size, 4)], [None, seq, 0, True] if undefined else None
        else:
            inner = struct.unpack_from("<HHI", data, at) if size >= 8 and at + 8 <= end else None
            nested = vr == "SQ" or (undefined and vr in ("UN", "??"))
            if not explicit and inner and inner[:2] == _ITEM and (inner[2] == 0xFFFFFFFF or inner[2] + 8 <= size):
                nested = True
            body = b"" if nested else data[at : at + size]
            if nested:
                opens, skip = [None if undefined else at + size, seq, 0, False], 0
        yield grp, elem, vr, explicit, pos, header, size, undefined, *place, encapsulated and len(stack) == 1 and mark, body
        if tag == _SEQUENCE_END and inside:
            stack.pop()
        elif opens and (opens[0] is None or opens[0] > at):
            stack.append(opens)
        pos = at + skip
        seq += 1


@walker("version:str seq:int make:str model:str editor:int quality:str csig:str csig_rot:str subsampling:str sw_trim:str sw_disp:str complete:bool")
def signature_records(data: bytes, header: str, versions: str):
    """Records of a binary user signature table: header, version, then sections of a name, a count and so many records.

    Texts end with a zero or a line end, in bytes or, where the header reads so, in UTF-16. Versions that are not listed
    (as text, two characters each) and files with another header give nothing; version 01 has no rotated signature. A record
    at which the file ends is given as far as it goes, ``complete`` false, as is one without a number for its editor.
    """
    for coding, unit in (("utf-16-le", 2), ("latin-1", 1)):
        if data.startswith(header.encode(coding)):
            break
    else:
        return
    pos, whole = 0, True

    def text() -> str:
        nonlocal pos, whole
        begin = pos
        while pos + unit <= len(data):
            sign = int.from_bytes(data[pos : pos + unit], "little")
            pos += unit
            if sign in (0, 10):
                return data[begin : pos - unit].decode(coding, "replace")
        whole, pos = False, len(data)
        return data[begin : pos - (pos - begin) % unit].decode(coding, "replace")

    if text() != header:
        return
    version = text()
    if len(version) != 2 or version not in versions.split(","):
        return
    seq = 0
    while whole and text() == "*DB*" and pos + 4 <= len(data):
        count = int.from_bytes(data[pos : pos + 4], "little")
        pos += 4
        for _ in range(count):
            if pos >= len(data):
                return
            make, model, editor, quality, csig = (text() for _ in range(5))
            csig_rot = "" if version == "01" else text()
            rest = [text() for _ in range(3)]
            number = editor.strip().isdecimal() and len(editor.strip()) < 10
            yield version, seq, make, model, int(editor) if number else None, quality, csig, csig_rot, *rest, whole and number
            seq += 1


@walker("frame_no:int stream:int pos:long len:long walked:bool indexed:bool key:bool jpeg:bool has_tables:bool scan_at:long complete:bool")
def avi_frames(data: bytes):
    """Video chunks of an AVI file in the order of the file: chunks ##dc and ##db of the movie lists, grouped ones (rec) too.

    pos and len are those of the chunk's data. indexed and key (a frame that needs no other) come from the old index, whose
    places count from the movie list or from the file's start; entries without a chunk follow with walked false, without a
    frame number. has_tables and scan_at are those of a frame's own marker segments. A chunk that the file ends in is not complete.
    """
    end, frames, entries, movie = len(data), [], [], None
    todo = [(0, end)]
    while todo:
        pos, stop = todo.pop()
        while pos + 8 <= stop:
            name, size = data[pos : pos + 4], int.from_bytes(data[pos + 4 : pos + 8], "little")
            at, after = pos + 8, pos + 8 + size + size % 2
            if name in (b"RIFF", b"LIST") and at + 4 <= stop:
                kind = data[at : at + 4]
                if (name == b"RIFF" and kind in (b"AVI ", b"AVIX")) or (name == b"LIST" and kind in (b"movi", b"rec ")):
                    if kind == b"movi" and movie is None:
                        movie = at
                    todo.append((after, stop))
                    pos, stop = at + 4, min(at + size, stop)
                    continue
            elif name == b"idx1":
                whole = data[at : min(at + size, stop)]
                entries += list(struct.iter_unpack("<4sIII", whole[: len(whole) // 16 * 16]))
            elif name[2:] in (b"dc", b"db") and name[:2].isdigit() and movie is not None:
                frames.append((int(name[:2]), pos, at, size, min(at + size, end)))
            pos = after
    entries = [e for e in entries if e[0][2:] in (b"dc", b"db") and e[0][:2].isdigit()]
    begins = {f[1] for f in frames}
    shift = 0 if entries and entries[0][2] in begins else movie or 0
    listed = {place + shift: (name, flags, size) for name, flags, place, size in entries}
    for n, (stream, pos, at, size, stop) in enumerate(frames):
        entry = listed.pop(pos, None)
        jpeg, has_tables, scan_at = data[at : at + 2] == b"\xff\xd8", False, -1
        if jpeg:
            for code, place, _ in _segments(data[at:stop], 0):
                if code == 0xDA:
                    scan_at = place
                    break
                has_tables = has_tables or code == 0xC4
        yield n + 1, stream, at, size, True, entry is not None, bool(entry and entry[1] & 0x10), jpeg, has_tables, scan_at, at + size <= end
    for place, (name, flags, size) in listed.items():
        yield None, int(name[:2]), place + 8, size, False, True, bool(flags & 0x10), False, False, -1, False
