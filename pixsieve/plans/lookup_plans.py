"""Lookup and scalar queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixsieve.functions import scalars as sc
from pixsieve.operators import lookups as lk
from pixsieve.operators.blocks import swap16
from pixsieve.plans import inputs as inp
from pixsieve.sources import dims

SMALL_RANGES = ((1, 0, "one"), (10, 49, "range"), (50, 0, "fifty"), (45, 60, "late"))
DICOM_GROUPS = (0x0002, 0x0008, 0x0028, 0x7FE0, 0xFFFE)
BLEND = tuple(dims.key_to_int(k) for k in ("norm", "mul ", "zzzz"))
FIELDS = ("color_mode", "resolution_unit", "width_unit", "print_scale_style", "guide_direction", "blend_mode")


def bim_lookup(spark, d):
    rows = [(c, e, n, i) for i, (c, e, n) in enumerate(SMALL_RANGES)]
    dim = dims.local_rows(spark, rows, "code INT, code_end INT, name STRING, ordinal INT")
    p = inp.table(spark, d, "part").select("p_partkey", "p_size")
    return lk.name_codes(p, "p_size", dim)


def bim_names(spark, d):
    p = inp.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 7 % 10100 + 900).cast("int").alias("bim_id"))
    return lk.name_codes(p, "bim_id", dims.dim_resource(spark))


def iptc_lookup(spark, d):
    f = inp.facts(spark, d).select("path", F.col("n").alias("record"), F.col("code").alias("dataset"))
    return lk.name_iptc(f, dims.dim_iptc(spark))


def iptc_values(spark, d):
    p = inp.table(spark, d, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("NUM", "HEX", "STR", "UNK")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", kind.alias("kind"), F.encode("p_name", "UTF-8").alias("data")).select(
        "p_partkey", "kind", lk.iptc_value(F.col("kind"), F.col("data")).alias("value"))


def _dicom_keys(spark, d):
    group = F.get(dims.int_array(DICOM_GROUPS), F.col("n") % 5)
    return inp.facts(spark, d).select(
        "path", "n", "code", group.alias("grp"), ((F.col("code") + F.col("n")) % 20).alias("elem"))


def dicom_lookup(spark, d):
    return lk.name_dicom(_dicom_keys(spark, d), dims.dim_dicom(spark))


def dicom_enum(spark, d):
    value = F.when(F.col("code") % 3 == 0, "1.2.840.10008.1.2").otherwise(
        F.concat(F.lit("1.2.840.10008.1.2.4."), (F.col("code") + 50).cast("string")))
    rows = inp.facts(spark, d).select("path", "n", F.lit(2).alias("grp"), F.lit(16).alias("elem"), value.alias("value"))
    return lk.describe_dicom(rows, dims.dim_dicom_enum(spark))


def psd_enum(spark, d):
    field = F.get(F.array(*[F.lit(x) for x in FIELDS]), F.col("code") % 6)
    blend = F.get(F.array(*[F.lit(x) for x in BLEND]), F.col("n") % 3)
    value = F.when(F.col("code") % 6 == 5, blend).otherwise((F.col("n") % 5).cast("bigint"))
    return lk.name_psd_enum(inp.facts(spark, d).select("path", field.alias("field"), value.alias("value")), dims.dim_psd_enum(spark))


def _tags(spark, d):
    rows = inp.event_tags(spark, d).withColumn("section", F.lit("gps"))
    return lk.name_markers(lk.name_exif(rows, dims.dim_exif(spark)).withColumn("code", F.col("tag_id") % 64 + 192))


def exif_lookup(spark, d):
    return _tags(spark, d)


def hide_unknown(spark, d):
    return lk.hide_unknown(_tags(spark, d)).select("path", "seq", "tag_id", "name")


def scalar_bits(spark, d):
    f = inp.facts(spark, d).withColumns({"word": F.col("scan_bytes") % (1 << 32), "nb": F.col("code") % 12})
    w, c = F.col("width"), F.col("code")
    return f.select(
        "path", "n", "scan_bytes",
        sc.to_binary(w, 16, True).alias("bin16"), sc.to_binary(c, 8).alias("bin8"), swap16(w).alias("swapped"),
        sc.test_bit(w, 3).alias("bit3"), sc.extract_bits(F.col("word"), c % 16 + 1).alias("top_bits"),
        sc.left_mask(c % 16 + 1).alias("mask"),
        sc.signed_value((w % F.pow(F.lit(2.0), F.col("nb")).cast("int")), F.col("nb")).alias("signed"),
        sc.scale_precision(w - 2000, 8 + F.col("n") % 5).alias("scaled"),
        sc.zero_run(c).alias("run"), sc.extra_bits(c).alias("extra"), sc.is_end_of_block(c % 16).alias("eob"),
    )


def scalar_strings(spark, d):
    p = inp.table(spark, d, "part")
    name, brand = F.encode("p_name", "UTF-8"), F.encode("p_brand", "UTF-8")
    size = F.unhex(F.lpad(F.hex(F.length("p_name")), 8, "0"))
    b = p.select(
        "p_partkey", "p_name", "p_size",
        F.concat(name, F.unhex(F.lit("00")), brand).alias("c"),
        F.concat(F.unhex(F.lit("0102")), name, F.unhex(F.lit("7f"))).alias("junk"),
        F.concat(size, F.encode("p_name", "UTF-16BE")).alias("wide"), F.concat(size, name).alias("narrow"),
        F.concat(F.unhex(F.lit("00000000")), F.encode(F.rpad("p_name", 4, "x"), "UTF-8")).alias("code4"),
        F.encode(F.concat("p_name", F.lit("\x00"), "p_brand"), "UTF-16LE").alias("wide_zero"),
        (F.col("p_partkey") * 7919 % 4294967296).alias("word"),
    )
    zero = F.lit(0)
    return b.select(
        "p_partkey",
        sc.four_chars(F.col("word")).alias("four"), sc.dotted_bytes(F.col("word")).alias("dotted"),
        sc.parse_uint32(F.concat(F.lit("0x"), F.hex("p_partkey")), 16).alias("hex_num"),
        sc.parse_uint32(F.when(F.col("p_partkey") % 3 == 0, "12z").otherwise(F.col("p_partkey").cast("string")), 10).alias("dec_num"),
        sc.fixed_string(F.col("c"), F.lit(2), F.lit(20)).alias("fixed"), sc.fixed_string(F.col("junk"), zero, F.lit(40)).alias("clean"),
        sc.terminated_string(F.col("c"), zero).alias("ended"),
        sc.length_prefixed_wide(F.col("wide"), zero, 6).alias("wide6"), sc.length_prefixed_ascii(F.col("narrow"), zero).alias("ascii"),
        sc.length_prefixed_ascii(F.col("code4"), zero).alias("code4"), sc.bool_text(F.col("p_size") % 2).alias("flag"),
        sc.terminated_wide_string(F.col("wide_zero"), zero).alias("wide_ended"),
    )


def scalar_geom(spark, d):
    f = inp.facts(spark, d)
    w, h, c = F.col("width"), F.col("height"), F.col("code")
    packed = sc.pack_offset(F.col("scan_bytes"), c % 8)
    return f.select(
        "path", "n", "scan_bytes",
        sc.cell_of(w, 16).alias("mcu_x"), sc.cell_of(h, 8).alias("mcu_y"), sc.cell_of(w, 8).alias("blk_x"),
        sc.linear_index(sc.cell_of(w, 16), sc.cell_of(h, 8), 250).alias("linear"),
        (sc.cell_of(w, 8) % 2).alias("css_x"), packed.alias("packed"), sc.unpack_byte(packed).alias("byte"), sc.unpack_bit(packed).alias("bit"),
        sc.position_text(F.col("scan_bytes"), c % 8).alias("pos_text"),
    )


def scalar_numeric(spark, d):
    f = inp.facts(spark, d).withColumn("word", F.col("scan_bytes") * 37 % (1 << 32))
    data = F.unhex(F.lpad(F.hex("word"), 8, "0"))
    c, n = F.col("code"), F.col("n")
    word = F.pmod(c - 6, F.lit(65536))
    return f.withColumn("data", data).select(
        "path", "n", "scan_bytes",
        sc.read_uint("data", 0, 4).alias("be32"), sc.read_uint("data", 0, 4, True).alias("le32"),
        sc.read_uint("data", 1, 2).alias("be16"), sc.read_int16("data", 2).alias("i16"), sc.read_uint("data", 2, 4).alias("short"),
        sc.fixed_point(F.col("word")).alias("fixed"), sc.float32(F.col("word")).alias("single"),
        F.round(sc.float64(F.lit(0x40500000) + F.col("word") % 1000, F.col("word")), 5).alias("double"),
        sc.save_quality(word).alias("quality"), sc.save_format(c % 3 + F.when(n == 1, 256).otherwise(0)).alias("format"),
        sc.save_scans(c % 5).alias("scans"), F.round(sc.rational(F.col("width"), n - 3), 6).alias("ratio"),
        F.round(sc.degrees(c, n, F.col("width") / 100), 6).alias("deg"),
    )


def scalar_fractions(spark, d):
    f = inp.facts(spark, d)
    w, c, n = F.col("width"), F.col("code"), F.col("n")
    return f.select(
        "path", "n", "scan_bytes", sc.fraction_text(w, n - 3).alias("fraction"), sc.fraction_text(c, n * 2).alias("half"),
        sc.dms_text(c, n, F.floor(w / 8) / 8).alias("dms"),
    )


def scalar_md5(spark, d):
    return inp.byte_files(spark, d).select("path", sc.md5_upper(F.col("content")).alias("md5"))


def scalar_url(spark, d):
    t = inp.byte_files(spark, d).select("path", F.concat(F.lit("{a}(b)*~+|"), F.col("text")).alias("text"))
    e = t.select("path", "text", sc.url_escape(F.col("text")).alias("esc"))
    return e.select("path", F.length("esc").alias("n"), F.md5("esc").alias("md5"), (sc.url_unescape(F.col("esc")) == F.col("text")).alias("same"))


QUERIES = {f.__name__: f for f in (
    bim_lookup, bim_names, iptc_lookup, iptc_values, dicom_lookup, dicom_enum, psd_enum, exif_lookup, hide_unknown,
    scalar_bits, scalar_strings, scalar_geom, scalar_numeric, scalar_fractions, scalar_md5, scalar_url,
)}

_F = f"WITH {inp.FACTS}"


def _dim(name, columns, rows):
    return inp.values_sql(name, columns, rows)


_RANGE_SMALL = _dim("dim", "code, code_end, name, ordinal", [(*r, i) for i, r in enumerate(SMALL_RANGES)])
_RANGE_ALL = _dim("dim", "code, code_end, name, ordinal", [(*r, i) for i, r in enumerate(dims.RESOURCE_IDS)])
_MARK = inp.sql_list(f"'{dims.marker_name(c)}'" for c in range(0xC0, 0x100))


def _range_sql(key: str, value: str, rows: str) -> str:
    return f"""SELECT {key}, {value}, (SELECT arg_min(name, ordinal) FROM dim WHERE {value} BETWEEN code AND
  CASE WHEN code_end = 0 THEN code ELSE code_end END) AS name FROM {rows}"""


_TAGS = f"""{_dim('dim', 'section, tag_id, name', dims.EXIF_TAGS)}, tags AS (SELECT path, seq, e.tag_id, 'gps' AS section,
  coalesce(name, printf('Unknown Tag 0x%04X', e.tag_id)) AS name, name IS NULL AS is_unknown, e.tag_id % 64 + 192 AS code,
  ({_MARK})[e.tag_id % 64 + 1] AS marker
  FROM event_tags e LEFT JOIN dim ON dim.section = 'gps' AND dim.tag_id = e.tag_id)"""

ORACLE = {
    "bim_lookup": f"WITH {_RANGE_SMALL} " + _range_sql("p_partkey", "p_size", "part"),
    "bim_names": f"WITH {_RANGE_ALL}, r AS (SELECT p_partkey, CAST(p_partkey * 7 % 10100 + 900 AS INTEGER) AS bim_id FROM part) " + _range_sql("p_partkey", "bim_id", "r"),
    "iptc_lookup": f"""{_F}, {_dim('dim', 'record, dataset, type, name', dims.IPTC_FIELDS)}
SELECT path, n AS record, code AS dataset, coalesce(type, 'UNK') AS type, coalesce(name, '?') AS name
FROM facts LEFT JOIN dim ON record = n AND dataset = code""",
    "iptc_values": """WITH r AS (SELECT p_partkey, ['NUM', 'HEX', 'STR', 'UNK'][p_partkey % 4 + 1] AS kind, p_name, hex(encode(p_name)) AS hx FROM part)
SELECT p_partkey, kind, CASE kind WHEN 'NUM' THEN CASE WHEN length(hx) <= 16 THEN CAST(('0x' || hx)::UBIGINT AS VARCHAR) END
  WHEN 'HEX' THEN '[' || regexp_replace(hx, '(..)', '0x\\1 ', 'g') || ']' WHEN 'STR' THEN '"' || p_name || '"' ELSE '???' END AS value FROM r""",
    "dicom_lookup": f"""{_F}, {_dim('dim', 'grp, elem, name', dims.DICOM_CORE_TAGS)},
k AS (SELECT path, n, code, {inp.sql_list(DICOM_GROUPS)}[n % 5 + 1] AS grp, (code + n) % 20 AS elem FROM facts)
SELECT path, n, code, k.grp, k.elem, coalesce(name, CASE WHEN k.elem = 0 THEN printf('Group Length (Group=%04X)', k.grp)
  ELSE printf('??? (%04X,%04X)', k.grp, k.elem) END) AS name, name IS NOT NULL OR k.elem = 0 AS known
FROM k LEFT JOIN dim ON dim.grp = k.grp AND dim.elem = k.elem""",
    "dicom_enum": f"""{_F}, {_dim('dim', 'value, text', dims.DICOM_TRANSFER_SYNTAXES)},
k AS (SELECT path, n, 2 AS grp, 16 AS elem, CASE WHEN code % 3 = 0 THEN '1.2.840.10008.1.2' ELSE '1.2.840.10008.1.2.4.' || (code + 50) END AS value FROM facts)
SELECT k.*, text FROM k LEFT JOIN dim ON dim.value = k.value""",
    "psd_enum": f"""{_F}, {_dim('dim', 'field, value, text', [(f, dims.key_to_int(v), t) for f, v, t in dims.PSD_ENUMS])},
k AS (SELECT path, {[*FIELDS]}[code % 6 + 1] AS field, CASE WHEN code % 6 = 5 THEN {inp.sql_list(BLEND)}[n % 3 + 1] ELSE n % 5 END::BIGINT AS value FROM facts),
h AS (SELECT k.*, text, printf('%08X', k.value) AS hx FROM k LEFT JOIN dim ON dim.field = k.field AND dim.value = k.value)
SELECT path, field, value, coalesce(text, '0x' || regexp_replace(hx, '(..)', '\\1 ', 'g') || ' | ' ||
  (SELECT string_agg(CASE WHEN v BETWEEN 32 AND 126 THEN chr(v) ELSE '.' END, '' ORDER BY i) FROM (SELECT i, ('0x' || substr(hx, 2 * i + 1, 2))::INTEGER AS v FROM range(4) q(i)))) AS text
FROM h""",
    "exif_lookup": f"WITH {inp.EVENT_TAGS}, {_TAGS} SELECT * FROM tags",
    "hide_unknown": f"WITH {inp.EVENT_TAGS}, {_TAGS} SELECT path, seq, tag_id, name FROM tags WHERE NOT is_unknown",
    "scalar_bits": f"""{_F}, f AS (SELECT *, scan_bytes % 4294967296 AS word, code % 12 AS nb, code % 16 + 1 AS tb, lpad(bin(width), 16, '0') AS b16 FROM facts)
SELECT path, n, scan_bytes, b16[1:8] || ' ' || b16[9:16] AS bin16, lpad(bin(code), 8, '0') AS bin8, (width % 256) * 256 + width // 256 AS swapped,
  (width // 8) % 2 = 1 AS bit3, word // (CAST(1 AS BIGINT) << (32 - tb)) AS top_bits, 4294967296 - (CAST(1 AS BIGINT) << (32 - tb)) AS mask,
  CAST(CASE WHEN nb = 0 THEN 0 WHEN width % (1 << nb) >= (1 << (nb - 1)) THEN width % (1 << nb) ELSE width % (1 << nb) - ((1 << nb) - 1) END AS BIGINT) AS signed,
  CAST(trunc((width - 2000) / (1 << (n % 5))::DOUBLE) AS INTEGER) AS scaled, code // 16 AS run, code % 16 AS extra, code % 16 = 0 AS eob FROM f""",
    "scalar_strings": """WITH f AS (SELECT *, p_partkey * 7919 % 4294967296 AS word FROM part),
g AS (SELECT *, [word // 16777216, word // 65536 % 256, word // 256 % 256, word % 256] AS b FROM f)
SELECT p_partkey, printf('''%s'' (0x%08X)', array_to_string(list_transform(b, lambda v: CASE WHEN v = 0 THEN '.' ELSE chr(v::INTEGER) END), ''), word) AS four,
  printf('''%d.%d.%d.%d'' (0x%08X)', b[1], b[2], b[3], b[4], word) AS dotted, p_partkey AS hex_num,
  CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS dec_num, substr(p_name, 3) AS fixed, p_name AS clean, p_name AS ended,
  substr(p_name, 1, 6) AS wide6, p_name AS ascii, substr(rpad(p_name, 4, 'x'), 1, 4) AS code4, CASE WHEN p_size % 2 <> 0 THEN 'true' ELSE 'false' END AS flag, p_name AS wide_ended FROM g""",
    "scalar_geom": f"""{_F} SELECT path, n, scan_bytes, width // 16 AS mcu_x, height // 8 AS mcu_y, width // 8 AS blk_x, (height // 8) * 250 + width // 16 AS linear,
  (width // 8) % 2 AS css_x, scan_bytes * 16 + code % 8 AS packed, scan_bytes AS byte, code % 8 AS bit, printf('0x%08X.%d', scan_bytes, code % 8) AS pos_text FROM facts""",
    "scalar_numeric": f"""{_F}, f AS (SELECT *, scan_bytes * 37 % 4294967296 AS word FROM facts),
g AS (SELECT *, word // 2147483648 AS sg, word // 8388608 % 256 AS ex, word % 8388608 AS fr, word % 1000 * 4294967296 + word AS lo FROM f)
SELECT path, n, scan_bytes, word AS be32, word % 256 * 16777216 + word // 256 % 256 * 65536 + word // 65536 % 256 * 256 + word // 16777216 AS le32,
  word // 256 % 65536 AS be16, CASE WHEN word % 65536 >= 32768 THEN word % 65536 - 65536 ELSE word % 65536 END AS i16, CAST(NULL AS BIGINT) AS short,
  word / 65536.0::DOUBLE AS fixed, (CASE WHEN sg = 1 THEN -1 ELSE 1 END) * CASE WHEN ex = 0 THEN fr * pow(2.0::DOUBLE, -149)
    WHEN ex = 255 THEN CASE WHEN fr = 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE (1 + fr / 8388608.0::DOUBLE) * pow(2.0::DOUBLE, ex - 127) END AS single,
  round((1 + lo / 4503599627370496.0::DOUBLE) * 64, 5) AS double, CASE WHEN code - 6 BETWEEN -3 AND 8 THEN code - 2 ELSE 0 END AS quality,
  CASE code % 3 + CASE WHEN n = 1 THEN 256 ELSE 0 END WHEN 0 THEN 'Standard' WHEN 1 THEN 'Optimized' WHEN 257 THEN 'Progressive' ELSE '???' END AS format,
  CASE WHEN code % 5 BETWEEN 1 AND 3 THEN (code % 5 + 2) || ' Scans' ELSE '???' END AS scans,
  round(width / nullif(n - 3, 0)::DOUBLE, 6) AS ratio, round(code + n / 60.0::DOUBLE + width / 100.0::DOUBLE / 3600.0::DOUBLE, 6) AS deg FROM g""",
    "scalar_fractions": f"""{_F} SELECT path, n, scan_bytes,
  CASE WHEN n <> 3 AND width % (n - 3) = 0 THEN CAST(width // (n - 3) AS VARCHAR) ELSE width || '/' || (n - 3) END AS fraction,
  CASE WHEN code % (n * 2) = 0 THEN CAST(code // (n * 2) AS VARCHAR) ELSE code || '/' || (n * 2) END AS half,
  printf('%d deg %d'' %.3f"', code, n, (width // 8) / 8.0::DOUBLE) AS dms FROM facts""",
    "scalar_md5": "SELECT doc_id AS path, upper(md5(text)) AS md5 FROM documents",
    "scalar_url": """WITH e AS (SELECT doc_id AS path, replace(replace(replace(replace(replace(url_encode('{a}(b)*~+|' || text), '~', '%7E'), '%7B', '{'), '%28', '('), '%29', ')'), '%2A', '*') AS esc FROM documents)
SELECT path, CAST(length(esc) AS INTEGER) AS n, md5(esc) AS md5, true AS same FROM e""",
}
