"""Extraction queries over packed files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixsieve.operators import extract as ex
from pixsieve.plans import inputs as inp
from pixsieve.plans import packed
from pixsieve.sources import dims


def jpeg_segments(spark, d):
    return ex.jpeg_segments(packed.jpeg_files(spark, d))


def _exif(spark, d):
    return ex.segment_data(packed.exif_files(spark, d), 0xE1, b"Exif\x00\x00")


def exif_tags(spark, d):
    return ex.exif_tags(_exif(spark, d), dims.dim_exif(spark)).drop("complete")


def gps_position(spark, d):
    g = ex.gps_position(_exif(spark, d))
    return g.select("path", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def thumbnail_extent(spark, d):
    return ex.thumbnail_extents(ex.exif_tags(_exif(spark, d), dims.dim_exif(spark)))


def icc_header(spark, d):
    h = ex.icc_header(packed.icc_profiles(spark, d))
    return h.withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


def psd_header(spark, d):
    return ex.psd_header(packed.psd_files(spark, d))


def _resources(spark, d):
    return ex.psd_resources(packed.psd_files(spark, d), dims.dim_resource(spark))


def psd_resources(spark, d):
    return _resources(spark, d).select("path", "seq", "bim_id", "own_name", "offset", "len", "complete", "name")


def psd_payloads(spark, d):
    return ex.resource_fields(_resources(spark, d), dims.dim_resource_fields(spark), dims.dim_psd_enum(spark))


def iptc_records(spark, d):
    return ex.iptc_records(_resources(spark, d), dims.dim_iptc(spark))


def psd_layers(spark, d):
    rows = ex.psd_layers(packed.psd_files(spark, d))
    chans = F.array_join(F.transform("chans", lambda c: F.concat_ws(":", c["id"], c["len"])), " ")
    return rows.withColumn("chans", chans).drop("complete")


def _elements(spark, d):
    return ex.dicom_elements(packed.dicom_files(spark, d), dims.dim_dicom(spark), dims.dim_dicom_enum(spark))


def dicom_elements(spark, d):
    return _elements(spark, d).drop("value")


def dicom_first_image(spark, d):
    return ex.first_dicom_image(_elements(spark, d))


def _headers(spark, d):
    return ex.header_segments(packed.coded_files(spark, d))


def jpeg_frames(spark, d):
    f = ex.frames(_headers(spark, d))
    return f.withColumn("comps", F.array_join(F.transform("comps", lambda c: F.concat_ws(":", c["ci"], c["h"], c["v"], c["tq"])), " "))


def jpeg_scans(spark, d):
    f = ex.scans(_headers(spark, d))
    return f.withColumn("comps", F.array_join(F.transform("comps", lambda c: F.concat_ws(":", c["ci"], c["td"], c["ta"])), " "))


def jpeg_dqt(spark, d):
    t = ex.quantisation_tables(_headers(spark, d))
    return t.select("path", "seq", "dest_id", "precision", F.posexplode("table_zz").alias("zz", "value"))


def jpeg_dht(spark, d):
    return ex.huffman_lists(_headers(spark, d))


def image_signatures(spark, d):
    return ex.image_signatures(_headers(spark, d))


QUERIES = {f.__name__: f for f in (
    jpeg_segments, jpeg_frames, jpeg_scans, jpeg_dqt, jpeg_dht, image_signatures, exif_tags, gps_position, thumbnail_extent, icc_header, psd_header, psd_resources, psd_payloads, iptc_records,
    psd_layers, dicom_elements, dicom_first_image,
)}

_C = packed.CHUNK
_JPEG = f"""f AS (SELECT doc_id AS path, octet_length(encode(text)) AS n, CAST(ceil(octet_length(encode(text)) / {_C}.0::DOUBLE) AS BIGINT) AS k FROM documents),
g AS (SELECT *, 20 + n + 4 * k AS base FROM f),
s AS (SELECT path, 0 AS seq, 216 AS code, 0 AS "offset", 0 AS len, 'SOI' AS marker FROM g
  UNION ALL SELECT path, 1, 224, 2, 16, 'APP0' FROM g
  UNION ALL SELECT path, 2 + c.i, 254, 20 + c.i * ({_C} + 4), least(n - c.i * {_C}, {_C}) + 2, 'COM' FROM g, range(0, 100) c(i) WHERE c.i < k
  UNION ALL SELECT path, 2 + k, 219, base, 67, 'DQT' FROM g
  UNION ALL SELECT path, 3 + k, 192, base + 69, 11, 'SOF0' FROM g
  UNION ALL SELECT path, 4 + k, 218, base + 82, 8, 'SOS' FROM g
  UNION ALL SELECT path, 5 + k, 0, base + 92, 38, 'scan' FROM g
  UNION ALL SELECT path, 6 + k, 217, base + 130, 0, 'EOI' FROM g)"""

_EXIF_ROWS = (
    ("ifd0", 0, 0x010F, "Make", 2, "length(p_brand) + 1", "p_brand"),
    ("ifd0", 1, 0x0110, "Model", 2, "length(p_type) + 1", "p_type"),
    ("ifd0", 2, 0x0112, "Orientation", 3, "1", "CAST(p_size % 8 + 1 AS VARCHAR)"),
    ("ifd0", 3, 0x8769, "ExifOffset", 4, "1", "'150'"),
    ("ifd0", 4, 0x8825, "GPSOffset", 4, "1", "'208'"),
    ("ifd0", 5, 0xC0DE, None, 4, "1", "CAST(p_partkey AS VARCHAR)"),
    ("exif", 6, 0x829A, "ExposureTime", 5, "1", "'1/' || (p_size + 1)"),
    ("exif", 7, 0x829D, "FNumber", 5, "1", "p_size || '/10'"),
    ("exif", 8, 0x8827, "ISOSpeedRatings", 3, "1", "CAST(p_size * 10 AS VARCHAR)"),
    ("gps", 9, 1, "GPSLatitudeRef", 2, "2", "CASE WHEN p_partkey % 3 = 0 THEN 'S' ELSE 'N' END"),
    ("gps", 10, 2, "GPSLatitude", 5, "3", "p_size || '/1,' || (p_partkey % 60) || '/1,' || (p_partkey % 6000) || '/100'"),
    ("gps", 11, 3, "GPSLongitudeRef", 2, "2", "CASE WHEN p_partkey % 5 = 0 THEN 'W' ELSE 'E' END"),
    ("gps", 12, 4, "GPSLongitude", 5, "3", "(p_size * 2) || '/1,' || (p_partkey % 59) || '/1,' || (p_partkey % 5999) || '/100'"),
    ("ifd1", 13, 0x0201, "JpegIFOffset", 4, "1", "'340'"),
    ("ifd1", 14, 0x0202, "JpegIFByteCount", 4, "1", "CAST(p_size AS VARCHAR)"),
)

# id, own name, length of the data, defined name
_RES = (
    (0x03ED, "", "16"), (0x0404, "", "24 + length(p_name) + length(p_type)"), (0x0406, "ab", "6"), (0x0408, "", "26"),
    (0x07D1, "path", "length(p_brand)"), (0x0421, "", "17 + 4 * length(p_name)"), (0x0426, "", "14"), (0x0428, "", "12"), (0x042D, "", "10"),
)


def _res_name(code: int) -> str:
    return next(n for lo, hi, n in dims.RESOURCE_IDS if lo == code or lo <= code <= hi)


def _res_sql() -> str:
    """Offsets follow from the lengths: 12 bytes of frame, the name's, and the data rounded up to even."""
    rows, at = [], "34 + CASE WHEN p_partkey % 10 = 2 THEN 768 ELSE 0 END"
    for i, (code, name, size) in enumerate(_RES):
        rows.append(f"""SELECT p_partkey AS path, {i} AS seq, {code} AS bim_id, '{name}' AS own_name, CAST({at} AS BIGINT) AS "offset",
  CAST({size} AS BIGINT) AS len, true AS complete, '{_res_name(code)}' AS name FROM part""")
        at += f" + {10 + (len(name) + 2) // 2 * 2} + ({size} + 1) // 2 * 2"
    return " UNION ALL ".join(rows)


_ENUM = {(f, v): t for f, v, t in dims.PSD_ENUMS}
_MODES = "[" + ",".join(
    "'" + _ENUM.get(("color_mode", m), f"0x00 00 00 {m:02X}  | ....") + "'" for m in range(10)) + "]"


def _payload_sql() -> str:
    fields = (
        (0, 0x03ED, (("h_resolution", "printf('%.5f', p_size + 0.5)"), ("h_unit", "'pixels per inch'"), ("width_unit", "'cm'"),
                     ("v_resolution", "'72.00000'"), ("v_unit", "'pixels per cm'"), ("height_unit", "'0x00 00 00 09  | ....'"))),
        (2, 0x0406, (("quality", "CAST(CASE WHEN (p_partkey + 1) % 65536 BETWEEN 1 AND 12 THEN (p_partkey + 1) % 65536 ELSE 0 END AS VARCHAR)"),
                     ("format", "['Standard', 'Optimized', '???'][p_partkey % 3 + 1]"), ("scans", "['???', '3 Scans', '4 Scans', '5 Scans'][p_partkey % 4 + 1]"))),
        (3, 0x0408, (("version", "'1'"), ("grid_horizontal", "'576'"), ("grid_vertical", "'576'"), ("guides", "'2'"),
                     ("location", "CAST(p_size AS VARCHAR)"), ("direction", "'vertical'"), ("location", "CAST(p_size * 2 AS VARCHAR)"), ("direction", "'horizontal'"))),
        (5, 0x0421, (("version", "'1'"), ("has_merged_data", "'1'"), ("writer", "p_name"), ("reader", "p_name"), ("file_version", "CAST(p_partkey AS VARCHAR)"))),
        (6, 0x0426, (("style", "['centered', 'size to fit', 'user defined'][p_partkey % 3 + 1]"), ("x", "'1.50000'"), ("y", "'-2.50000'"), ("scale", "'1.00000'"))),
        (7, 0x0428, (("version", "'1'"), ("ratio", "'1.50000'"))),
        (8, 0x042D, (("selected", "'2'"), ("layer_id", "CAST(p_partkey AS VARCHAR)"), ("layer_id", "CAST(p_size AS VARCHAR)"))),
    )
    return " UNION ALL ".join(
        f"SELECT p_partkey AS path, {seq} AS seq, {code} AS bim_id, {n} AS n, '{name}' AS field, {value} AS value FROM part"
        for seq, code, group in fields for n, (name, value) in enumerate(group))


def _iptc_sql() -> str:
    rows = ((2, 0, "Record Version", "2", "CAST(p_size AS VARCHAR)"), (2, 5, "Object Name", "length(p_name)", "'\"' || p_name || '\"'"),
            (2, 25, "Keywords", "length(p_type)", "'\"' || p_type || '\"'"), (9, 99, "?", "1", "'???'"))
    return " UNION ALL ".join(
        f"SELECT p_partkey AS path, {i} AS seq, {r} AS record, {s} AS dataset, '{n}' AS name, CAST({size} AS INTEGER) AS len, {v} AS value FROM part"
        for i, (r, s, n, size, v) in enumerate(rows))


def _layer_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT p_partkey AS path, {i} AS layer, p_partkey % 2 = 0 AS transparency, CAST(p_size AS BIGINT) AS width, CAST(p_size + {i} AS BIGINT) AS height,
  '0:' || p_size || ' 65535:' || (p_size + 2) AS chans, '8BIM' AS blend_sig, ['normal', 'multiply', '0x7A 7A 7A 7A  | zzzz'][p_partkey % 3 + 1] AS blend_mode,
  p_size * 4 AS opacity, CAST(0 AS BIGINT) AS mask_len, 1 AS ranges, {name} AS name, p_name AS unicode_name, CAST(NULL AS BIGINT) AS name_source,
  p_partkey + {i} AS layer_id, CAST(NULL AS VARCHAR) AS blend_clipped, CAST(NULL AS VARCHAR) AS blend_interior, 'true' AS knockout FROM part"""
        for i, name in ((0, "p_name"), (1, "p_brand")))


_DICOM = """f AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 22 ELSE 20 END AS u, (length(p_brand) + 1) // 2 * 2 AS b, p_size * 2 + 4 AS fr, * FROM part),
o AS (SELECT *, 132 AS o0, 140 + u AS o1, 148 + u + b AS o2, 164 + u + b AS o3, 176 + u + b AS o4 FROM f)"""


def _dicom_sql() -> str:
    t = "CASE WHEN p_partkey % 2 = 0 THEN 'JPEG Baseline (Process 1)' ELSE 'Explicit VR Little Endian' END"
    rows = (
        ("o0", 2, 16, "Transfer Syntax UID", True, "UI", True, "u", t, False, False),
        ("o1", 8, 112, "Manufacturer", True, "LO", True, "b", "NULL", False, False),
        ("o2", 9, 1, "??? (0009,0001)", False, "UN", True, "4", "NULL", False, False),
        ("o3", 40, 0, "Group Length (Group=0028)", True, "??", False, "4", "NULL", False, False),
        ("o4", 0x7FE0, 16, "Pixel Data", True, "OB", True, "0", "NULL", False, False),
        ("o4 + 12", 0xFFFE, 0xE000, "Item", True, "??", False, "0", "NULL", True, False),
        ("o4 + 20", 0xFFFE, 0xE000, "Item", True, "??", False, "fr", "NULL", False, True),
        ("o4 + 28 + fr", 0xFFFE, 0xE000, "Item", True, "??", False, "4", "NULL", False, True),
        ("o4 + 40 + fr", 0xFFFE, 0xE0DD, "Sequence Delimitation Item", True, "??", False, "0", "NULL", False, False),
    )
    return " UNION ALL ".join(
        f"""SELECT path, {i} AS seq, CAST({at} AS BIGINT) AS "offset", {g} AS grp, {e} AS elem, '{n}' AS name, {known} AS known, '{vr}' AS vr,
  {explicit} AS vr_explicit, CAST({size} AS BIGINT) AS len, CAST({txt} AS VARCHAR) AS text, {tab} AS is_offset_table, {jpg} AS is_jpeg,
  CAST({at + ' + 8' if jpg else 'NULL'} AS BIGINT) AS jpeg_offset FROM o"""
        for i, (at, g, e, n, known, vr, explicit, size, txt, tab, jpg) in enumerate(rows))


_CODED = f"""c AS (SELECT vec_id AS path, (SELECT list(q ORDER BY pos) FROM blocks WHERE block_id = vec_id) AS q,
  CASE WHEN vec_id % 2 = 0 THEN '2x2' ELSE '1x1' END AS sub FROM embeddings)"""
_TXT = "array_to_string(list_transform({v}, lambda v: CAST({e} AS VARCHAR)), ',')"
_ROTATED = "list_transform({zz}, lambda z: {v}[({unzz})[({rot})[z + 1] + 1] + 1])"


def _sig_sql(turned: bool) -> str:
    v = _ROTATED.format(zz=inp.ZZ_SQL, v="q", unzz=inp.UNZZ_SQL, rot=inp.ROT_SQL) if turned else "q"
    return f"upper(md5(concat_ws(';', sub, {_TXT.format(v=v, e='1 + abs(v) % 255')}, {_TXT.format(v=v, e='1 + abs(v) * 97')})))"


ORACLE = {
    "jpeg_frames": """SELECT vec_id AS path, 2 AS seq, 8 AS precision, CAST(vec_id % 500 + 16 AS INTEGER) AS height, CAST(vec_id % 700 + 8 AS INTEGER) AS width, 3 AS ncomp,
  CASE WHEN vec_id % 2 = 0 THEN '1:2:2:0' ELSE '1:1:1:0' END || ' 2:1:1:1 3:1:1:1' AS comps FROM embeddings""",
    "jpeg_scans": """SELECT vec_id AS path, CASE WHEN vec_id % 4 > 0 THEN 5 ELSE 4 END AS seq, 3 AS ns, '1:0:0 2:1:1 3:1:1' AS comps, 0 AS ss, 63 AS se, 0 AS ah, 0 AS al,
  CAST(vec_id % 4 AS INTEGER) AS rst_interval FROM embeddings""",
    "jpeg_dqt": f"""WITH {inp.BLOCKS} SELECT block_id AS path, 1 AS seq, 0 AS dest_id, 8 AS precision, pos AS zz, 1 + abs(q) % 255 AS value FROM blocks
UNION ALL SELECT block_id, 1, 1, 16, pos, 1 + abs(q) * 97 FROM blocks""",
    "jpeg_dht": """SELECT vec_id AS path, 3 AS seq, 0 AS class, 0 AS dest_id, CAST(r.i AS INTEGER) AS idx, CASE WHEN r.i < vec_id % 3 THEN 2 ELSE 3 END AS bitlen,
  CAST((r.i + 1) * 16 AS INTEGER) AS value FROM embeddings, range(4) r(i) WHERE r.i < vec_id % 3 + 2
UNION ALL SELECT vec_id, 3, 1, 1, 0, 16, 127 FROM embeddings""",
    "image_signatures": f"""WITH {inp.BLOCKS}, {_CODED} SELECT path AS image_id, {_sig_sql(False)} AS csig, {_sig_sql(True)} AS csig_rot FROM c""",
    "jpeg_segments": f"""WITH {_JPEG} SELECT path, CAST(seq AS INTEGER) AS seq, code, CAST("offset" AS BIGINT) AS "offset", CAST(len AS BIGINT) AS len, true AS complete, marker FROM s""",
    "exif_tags": " UNION ALL ".join(
        f"""SELECT p_partkey AS path, '{s}' AS section, {i} AS seq, {t} AS tag_id, '{n or 'Unknown Tag 0xC0DE'}' AS name, {n is None} AS is_unknown,
  {typ} AS type, CAST({cnt} AS BIGINT) AS count, {v} AS value FROM part""" for s, i, t, n, typ, cnt, v in _EXIF_ROWS),
    "gps_position": """SELECT p_partkey AS path,
  round(CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END * (p_size + (p_partkey % 60) / 60.0::DOUBLE + (p_partkey % 6000) / 100.0::DOUBLE / 3600), 6) AS lat,
  round(CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE 1 END * (p_size * 2 + (p_partkey % 59) / 60.0::DOUBLE + (p_partkey % 5999) / 100.0::DOUBLE / 3600), 6) AS lon FROM part""",
    "thumbnail_extent": """SELECT p_partkey AS path, CAST(340 AS BIGINT) AS "offset", CAST(p_size AS BIGINT) AS len FROM part""",
    "icc_header": """SELECT o_orderkey AS path, o_custkey + 128 AS size, 'lcms' AS cmm, '2.4' AS version, 'mntr' AS device_class,
  CASE WHEN o_orderstatus = 'O' THEN 'RGB ' ELSE 'GRAY' END AS colour_space, 'XYZ ' AS pcs, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created,
  true AS signature_ok, 'MSFT' AS platform, o_orderkey % 2 AS flags, rpad(o_orderpriority, 4, ' ') AS manufacturer, 'mdl1' AS model,
  o_orderkey % 4 AS intent, 'crea' AS creator FROM orders""",
    "psd_header": f"""SELECT p_partkey AS path, CAST(1 AS BIGINT) AS version, CAST(3 AS BIGINT) AS channels, CAST(p_size AS BIGINT) AS height, CAST(p_size + 1 AS BIGINT) AS width,
  CAST(8 AS BIGINT) AS depth, {_MODES}[p_partkey % 10 + 1] AS color_mode, CAST(CASE WHEN p_partkey % 10 = 2 THEN 768 ELSE 0 END AS BIGINT) AS mode_len FROM part""",
    "psd_resources": _res_sql(),
    "psd_payloads": _payload_sql(),
    "iptc_records": _iptc_sql(),
    "psd_layers": _layer_sql(),
    "dicom_elements": f"WITH {_DICOM} {_dicom_sql()}",
    "dicom_first_image": f"WITH {_DICOM} SELECT path, CAST(o4 + 28 AS BIGINT) AS jpeg_offset FROM o",
}
