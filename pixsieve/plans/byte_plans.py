"""Queries on byte corpora, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixsieve.operators import carving as cv
from pixsieve.operators import needles as nd
from pixsieve.operators import patches as pt
from pixsieve.operators import signatures as sg
from pixsieve.plans import inputs as inp
from pixsieve.sources.dims import STD_QUANT_LUMA

NEEDLES = (b"the", b"der", b"que", b"zzzz")
OPEN, CLOSE = b"<p>", b"</p>"
MARKERS = ("the", "Der", "qu")
IJG = ("que", "und")
SEGMENT = b"=" * 0x1A4
MAX_FRAME = 0xFFFFFFFF  # what a file format of 32-bit sizes can hold


def _html(spark, d):
    return inp.html_files(spark, d).select("path", F.encode("html", "UTF-8").alias("content"))


def _docs(spark, d):
    return inp.byte_files(spark, d).select("path", "content")


def byte_search(spark, d):
    needles = spark.createDataFrame([(i, bytearray(n)) for i, n in enumerate(NEEDLES)], "needle_no INT, needle BINARY")
    hits = nd.find_needles(_docs(spark, d), needles)
    # a list of Python has no size to the optimizer, and hits shuffled by needle are as few tasks as needles
    hits = hits.join(F.broadcast(needles), "needle")
    return hits.select("path", "needle_no", F.col("pos").cast("int").alias("pos"))


def next_prev(spark, d):
    return cv.next_previous(_html(spark, d), OPEN, F.expr("length(content) DIV 2"))


def offset_mode(spark, d):
    return cv.start_offsets(_html(spark, d), b"<p>", (F.col("path") % 100).cast("int"))


def first_embedded(spark, d):
    return cv.first_embedded(_html(spark, d), OPEN)


def carve_extent(spark, d):
    return cv.carve_extents(_html(spark, d), OPEN, CLOSE)


def carve_no_end(spark, d):
    return cv.carve_extents(_html(spark, d), OPEN, CLOSE, ignore_end=True)


def _frames(spark, d):
    return cv.number_frames(carve_extent(spark, d), F.col("terminated"), MAX_FRAME)


def frame_number(spark, d):
    return _frames(spark, d)


def _cut(spark, d):
    return cv.cut_frames(_html(spark, d), OPEN, CLOSE, max_size=MAX_FRAME)


def frame_names(spark, d):
    got = _cut(spark, d).where("written")
    root = F.concat(F.lit("page"), F.col("path").cast("string"))
    return got.select("path", cv.frame_name(root, F.col("frame_no")).alias("name"), F.length("frame").alias("size"), F.md5("frame").alias("md5"))


def mjpeg_dht(spark, d):
    out = cv.insert_tables(_cut(spark, d), SEGMENT, b"que", b"de")
    return out.select("path", "frame_no", "has_tables", F.length("frame").alias("size"), F.md5("frame").alias("md5"))


def scan_census(spark, d):
    return cv.scan_census(_html(spark, d), 0xC3, (0xA9, 0xA9), None, (0xA0, 0xA7))


def hex_rows(spark, d):
    return cv.hex_rows(_docs(spark, d))


def _containers(spark, d):
    k = F.col("path") % 6
    pad = F.unhex(F.lit("00" * 128))
    lead = (
        F.when(k == 0, F.unhex(F.lit("FFD8FFE0"))).when(k == 1, F.unhex(F.lit("384250530001")))
        .when(k == 2, F.unhex(F.lit("384250530002"))).when(k == 3, F.concat(pad, F.lit(b"DICM")))
        .when(k == 4, F.lit(b"RIFF....AVI ")).otherwise(F.lit(b""))
    )
    return _docs(spark, d).select("path", F.concat(lead, "content").alias("content"))


def classify_container(spark, d):
    return _containers(spark, d).select("path", F.length("content").alias("size"), cv.container_kind(F.col("content")).alias("kind"))


def _needles(spark, d):
    """Beginnings of the benchmark texts, in three lengths: nested needles, and such as overlap themselves."""
    b = inp.table(spark, d, "benchmark").select("text")
    each = b.select(F.explode(F.array(*[F.substring("text", 1, n) for n in (2, 4, 9)])).alias("t"))
    return each.select(F.encode("t", "UTF-8").alias("needle"))


def needle_table(spark, d):
    hits = nd.find_needles(_docs(spark, d), _needles(spark, d))
    return hits.select("path", F.decode("needle", "UTF-8").alias("needle"), "pos")


def marker_table(spark, d):
    """Markers by rank: the first words of the benchmark texts; of those in a document the first one."""
    words = inp.table(spark, d, "benchmark").select(F.col("item_id").alias("rank"), F.split_part("text", F.lit(" "), F.lit(2)).alias("marker"))
    return nd.first_listed(inp.byte_files(spark, d).select("path", "text"), words)


def comment_sw(spark, d):
    t = inp.byte_files(spark, d)
    return t.select("path", sg.contains_any(F.col("text"), MARKERS).alias("is_software"))


def ijg_sw(spark, d):
    t = inp.byte_files(spark, d)
    hit = sg.first_marker(F.col("text"), IJG)
    return t.select("path", hit.alias("encoder")).where("encoder IS NOT NULL")


def _patches(spark, d):
    docs = inp.table(spark, d, "documents").select(F.col("doc_id").alias("path"))
    each = docs.select("path", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ordinal"))
    start, size = (F.col("path") % 50).cast("int"), F.col("ordinal") + 4
    data = F.encode(F.rpad(F.concat(F.lit("#"), F.col("ordinal").cast("string"), F.col("path").cast("string")), size, "*"), "UTF-8")
    return each.select("path", "ordinal", start.alias("start"), size.alias("len"), data.alias("data"))


def byte_patch(spark, d):
    out = pt.apply_patches(_docs(spark, d), _patches(spark, d))
    return out.select("path", F.length("content").alias("size"), F.md5("content").alias("md5"))


def patch_bytes(spark, d):
    return pt.patched_bytes(_patches(spark, d)).withColumn("off", F.col("off").cast("int"))


def dqt_hunt(spark, d):
    b = inp.table(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("c")).where(F.length("c") >= 64)
    starts = F.sequence(F.lit(0), F.length("c") - 64, F.lit(64))
    t = b.select("item_id", F.explode(starts).alias("at"), "c")
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: cv.byte_at("c", F.col("at") + i))
    tables = t.select(F.concat_ws("-", "item_id", "at").alias("table_id"), values.alias("table")).unionByName(cv.standard_table(spark))
    return cv.hunt(_docs(spark, d), cv.hunt_needles(tables))


QUERIES = {f.__name__: f for f in (
    byte_search, next_prev, offset_mode, first_embedded, carve_extent, carve_no_end, frame_number, frame_names, mjpeg_dht,
    scan_census, hex_rows, classify_container, comment_sw, ijg_sw, needle_table, marker_table, byte_patch, patch_bytes, dqt_hunt,
)}

_DOCS = "docs AS (SELECT doc_id AS path, text, hex(encode(text)) AS hx FROM documents)"
_HTML = "html AS (SELECT page_id AS path, hex(encode(html)) AS hx FROM pages)"


def _hits(name: str, src: str, needle: bytes) -> str:
    """Byte offsets of a needle (that cannot overlap itself), by splitting text at it."""
    txt = needle.decode()
    return f"""{name} AS (SELECT path, pos FROM (SELECT path, i, n, CAST(sum(octet_length(encode(piece))) OVER (PARTITION BY path ORDER BY i) + (i - 1) * {len(needle)} AS INTEGER) AS pos
  FROM (SELECT path, unnest(string_split(t, '{txt}')) AS piece, generate_subscripts(string_split(t, '{txt}'), 1) AS i, len(string_split(t, '{txt}')) AS n FROM {src}))
  WHERE i < n)"""


_T = "src AS (SELECT page_id AS path, html AS t, octet_length(encode(html)) AS len FROM pages)"
_D = "src AS (SELECT doc_id AS path, text AS t, octet_length(encode(text)) AS len FROM documents)"
_FR = f"""{_T}, {_hits('o', 'src', OPEN)}, {_hits('c', 'src', CLOSE)},
x AS (SELECT path, pos, min(pos) FILTER (k = 1) OVER w AS ne, min(pos) FILTER (k = 0) OVER w AS ns, k FROM (
    SELECT path, pos, 0 AS k FROM o UNION ALL SELECT path, pos, 1 FROM c) WINDOW w AS (PARTITION BY path ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
f AS (SELECT x.path, CAST(pos AS BIGINT) AS pos, CAST(coalesce(ne + 4, ns, len) AS BIGINT) AS end_pos, ne IS NOT NULL AS terminated,
  CAST(coalesce(ns, len) AS BIGINT) AS next_or_len FROM x JOIN src ON x.path = src.path WHERE k = 0)"""
_NUM = f"""{_FR}, fn AS (SELECT path, pos, end_pos, row_number() OVER (PARTITION BY path ORDER BY pos) AS frame_no,
  end_pos - pos <= {MAX_FRAME} AS written FROM f WHERE terminated)"""
_FB = f"""{_NUM}, {_HTML}, fb AS (SELECT fn.*, substr(hx, pos * 2 + 1, (end_pos - pos) * 2) AS fx FROM fn JOIN html ON fn.path = html.path)"""
_CONT = f"""{_DOCS}, c AS (SELECT path, CASE path % 6 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '384250530001' WHEN 2 THEN '384250530002'
  WHEN 3 THEN repeat('00', 128) || hex(encode('DICM')) WHEN 4 THEN hex(encode('RIFF....AVI ')) ELSE '' END || hx AS hx FROM docs)"""
_PATCH = """p AS (SELECT doc_id AS path, o.i AS ordinal, doc_id % 50 AS start, 4 + o.i AS len,
  hex(encode(substr(rpad('#' || o.i || doc_id, 64, '*'), 1, 4 + o.i))) AS dx FROM documents, range(3) o(i))"""


def _lay(content: str, o: int) -> str:
    data = f"max(dx) FILTER (ordinal = {o})"
    at = "max(start) * 2"
    fit = f"substr({data}, 1, greatest(length({content}) - {at}, 0))"
    return f"substr({content}, 1, {at}) || {fit} || substr({content}, {at} + length({fit}) + 1)"


_BYTE = "('0x' || substr(hx, 2 * i + 1, 2))::INTEGER"

ORACLE = {
    "byte_search": f"WITH {_D}, " + ", ".join(_hits(f"n{i}", "src", n) for i, n in enumerate(NEEDLES)) + " " + " UNION ALL ".join(
        f"SELECT path, CAST({i} AS INTEGER) AS needle_no, pos FROM n{i}" for i in range(len(NEEDLES))),
    "next_prev": f"""WITH {_T}, {_hits('o', 'src', OPEN)} SELECT o.path, CAST(max(len // 2) AS BIGINT) AS start, min(pos) FILTER (pos > len // 2) AS next_pos,
  max(pos) FILTER (pos < len // 2) AS prev_pos FROM o JOIN src ON o.path = src.path GROUP BY o.path""",
    "offset_mode": f"""WITH {_T}, {_hits('o', 'src', OPEN)}, m AS (SELECT src.path, coalesce(min(pos) FILTER (pos > 0), 0) AS nx,
  starts_with(any_value(t), '<p>') AS ok FROM src LEFT JOIN o ON o.path = src.path GROUP BY src.path)
SELECT path, 0 AS start, CASE WHEN ok THEN 0 ELSE nx END AS srch1, nx AS srch2, CAST(path % 100 AS INTEGER) AS pos FROM m""",
    "first_embedded": f"WITH {_T}, {_hits('o', 'src', OPEN)} SELECT path, min(pos) AS first_pos FROM o GROUP BY path",
    "carve_extent": f"WITH {_FR} SELECT path, pos, end_pos, terminated FROM f",
    "carve_no_end": f"WITH {_FR} SELECT path, pos, next_or_len AS end_pos, terminated FROM f",
    "frame_number": f"WITH {_NUM} SELECT * FROM fn",
    "frame_names": f"""WITH {_FB} SELECT path, printf('page%d.%06d.jpg', path, frame_no) AS name, CAST(length(fx) // 2 AS INTEGER) AS size, md5(unhex(fx)) AS md5 FROM fb WHERE written""",
    "mjpeg_dht": f"""WITH {_FB}, d AS (SELECT path, frame_no, fx, unhex(fx) AS b, contains(decode(unhex(fx)), 'que') AS has_tables,
  instr(decode(unhex(fx)), 'de') AS cut FROM fb),
e AS (SELECT path, frame_no, has_tables, CASE WHEN has_tables OR cut = 0 THEN decode(b)
  ELSE substr(decode(b), 1, cut - 1) || repeat('=', {len(SEGMENT)}) || substr(decode(b), cut) END AS r FROM d)
SELECT path, frame_no, has_tables, CAST(octet_length(encode(r)) AS INTEGER) AS size, md5(r) AS md5 FROM e""",
    "scan_census": f"""WITH {_HTML}, b AS (SELECT path, hx, unnest(range(length(hx) // 2)) AS i FROM html), l AS (SELECT path, CAST(i AS INTEGER) AS pos,
  CASE WHEN 2 * i + 4 <= length(hx) THEN ('0x' || substr(hx, 2 * i + 3, 2))::INTEGER END AS code FROM b WHERE substr(hx, 2 * i + 1, 2) = 'C3')
SELECT path, pos, code, CASE WHEN code IS NULL THEN 'end' WHEN code = 169 THEN 'stuffed' WHEN code BETWEEN 160 AND 167 THEN 'restart' ELSE 'marker' END AS kind FROM l""",
    "hex_rows": f"""WITH {_DOCS}, r AS (SELECT path, hx, unnest(range(0, least(length(hx) // 2, 128), 16)) AS off FROM docs),
s AS (SELECT path, off, hx, substr(hx, off * 2 + 1, 32) AS sx FROM r),
t AS (SELECT path, CAST(off AS INTEGER) AS off, length(hx) <= 32 AS in_line, rpad(regexp_replace(sx, '(..)', '\\1 ', 'g'), 48, ' ') AS hex_text,
  rpad((SELECT string_agg(CASE WHEN v BETWEEN 32 AND 126 THEN chr(v) ELSE '.' END, '' ORDER BY i) FROM (
    SELECT i, ('0x' || substr(sx, 2 * i + 1, 2))::INTEGER AS v FROM range(length(sx) // 2) q(i))), 16, ' ') AS ascii_text FROM s)
SELECT * FROM t UNION ALL SELECT path, 128, false, '...', '' FROM docs WHERE length(hx) > 256""",
    "classify_container": f"""WITH {_CONT} SELECT path, CAST(length(hx) // 2 AS INTEGER) AS size, CASE WHEN starts_with(hx, '384250530001') THEN 'psd'
  WHEN substr(hx, 257, 8) = '4449434D' THEN 'dicom' WHEN starts_with(hx, 'FFD8FF') THEN 'jpeg'
  WHEN starts_with(hx, '52494646') AND substr(hx, 17, 8) = '41564920' THEN 'avi' ELSE 'unknown' END AS kind FROM c""",
    "needle_table": f"""WITH c AS (SELECT path, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT doc_id AS path, string_split(text, '') AS l FROM documents)),
g AS (SELECT path, CAST(coalesce(sum(octet_length(encode(c))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos,
  unnest([{', '.join(' || '.join(['c', *(f'lead(c, {j}) OVER w' for j in range(1, n))]) for n in (2, 4, 9))}]) AS t FROM c WINDOW w AS (PARTITION BY path ORDER BY i)),
n AS (SELECT DISTINCT t FROM (SELECT unnest([text[1:2], text[1:4], text[1:9]]) AS t FROM benchmark) WHERE t <> '')
SELECT DISTINCT g.path, g.t AS needle, g.pos FROM g JOIN n ON g.t = n.t""",
    "marker_table": """WITH w AS (SELECT item_id AS rank, split_part(text, ' ', 2) AS marker FROM benchmark),
h AS (SELECT d.doc_id AS path, rank, marker FROM documents d, w WHERE marker <> '' AND contains(d.text, marker))
SELECT path, marker FROM h QUALIFY row_number() OVER (PARTITION BY path ORDER BY rank, marker) = 1""",
    "comment_sw": f"WITH {_DOCS} SELECT path, " + " OR ".join(f"contains(text, '{m}')" for m in MARKERS) + " AS is_software FROM docs",
    "ijg_sw": f"""WITH {_DOCS}, e AS (SELECT path, CASE WHEN contains(text, 'que') THEN 'que' WHEN contains(text, 'und') THEN 'und' END AS encoder FROM docs)
SELECT * FROM e WHERE encoder IS NOT NULL""",
    "byte_patch": f"""WITH {_DOCS}, {_PATCH}, j AS (SELECT docs.path, hx, ordinal, start, dx FROM docs JOIN p ON docs.path = p.path),
a AS (SELECT path, any_value(hx) AS hx, max(start) AS start, {_lay('any_value(hx)', 0)} AS h0, max(dx) FILTER (ordinal = 1) AS d1, max(dx) FILTER (ordinal = 2) AS d2 FROM j GROUP BY path),
b AS (SELECT *, substr(h0, 1, start * 2) || substr(d1, 1, greatest(length(h0) - start * 2, 0)) || substr(h0, start * 2 + length(d1) + 1) AS h1 FROM a),
c AS (SELECT path, substr(h1, 1, start * 2) || substr(d2, 1, greatest(length(h1) - start * 2, 0)) || substr(h1, start * 2 + length(d2) + 1) AS h2 FROM b)
SELECT path, CAST(length(h2) // 2 AS INTEGER) AS size, md5(unhex(h2)) AS md5 FROM c""",
    "patch_bytes": f"""WITH {_PATCH}, e AS (SELECT path, ordinal, CAST(start + b.i AS INTEGER) AS off, ('0x' || substr(dx, 2 * b.i + 1, 2))::INTEGER AS value
  FROM p, range(6) b(i) WHERE b.i < len) SELECT path, off, arg_max(value, ordinal) AS value FROM e GROUP BY path, off""",
    "dqt_hunt": f"""WITH {_DOCS}, b AS (SELECT item_id, hex(encode(text)) AS hx FROM benchmark),
t0 AS (SELECT item_id || '-' || a AS table_id, list_transform(range(64), lambda i: ('0x' || substr(hx, 2 * (a + i) + 1, 2))::INTEGER) AS t
  FROM (SELECT item_id, hx, unnest(range(0, length(hx) // 2 - 63, 64)) AS a FROM b)),
t AS (SELECT * FROM t0 UNION ALL SELECT 'standard', {inp.sql_list(STD_QUANT_LUMA)}),
o AS (SELECT table_id, 'pre' AS z, t FROM t WHERE list_min(t) <> list_max(t)
  UNION ALL SELECT table_id, 'post', list_transform({inp.ZZ_SQL}, lambda i: t[i + 1]) FROM t WHERE list_min(t) <> list_max(t)),
e AS (SELECT table_id, z || '-1' AS form, list_transform(t, lambda v: printf('%02X', v)) AS l FROM o
  UNION ALL SELECT table_id, z || '-2', list_transform(t, lambda v: printf('%04X', v)) FROM o
  UNION ALL SELECT table_id, z || '-2s', list_transform(t, lambda v: printf('%02X00', v)) FROM o
  UNION ALL SELECT table_id, z || '-4', list_transform(t, lambda v: printf('%08X', v)) FROM o
  UNION ALL SELECT table_id, z || '-4s', list_transform(t, lambda v: printf('%02X000000', v)) FROM o),
n AS (SELECT table_id, form, array_to_string(l, '') AS nx FROM e),
m AS (SELECT path, table_id, form, hx, nx FROM docs, n WHERE contains(hx, nx))
SELECT path, table_id, form, CAST(i AS INTEGER) AS pos FROM (SELECT *, unnest(range(length(hx) // 2)) AS i FROM m) WHERE substr(hx, 2 * i + 1, length(nx)) = nx""",
}
