"""Queries on ordered code streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixsieve.operators import chains as ch
from pixsieve.operators import stats
from pixsieve.plans import inputs as inp

CAP = 40
INTERVAL = 4
GRID = 8


def dc_running(spark, d):
    return ch.dc_values(inp.codes(spark, d).select("path", "seq", "comp", "delta", "is_rst")).select("path", "seq", "comp", "rst_seg", "dc")


def rst_sequence(spark, d):
    return ch.restart_check(inp.codes(spark, d))


def rst_overrun(spark, d):
    return ch.restart_overruns(inp.codes(spark, d).select("path", "seq", "is_rst"), INTERVAL)


def first_n_errors(spark, d):
    return ch.first_n(inp.codes(spark, d), {"error": 20, "warn": 10})


def report_cap(spark, d):
    lines = inp.codes(spark, d).select("path", "seq", "severity", F.concat(F.lit("code "), F.col("seq").cast("string")).alias("text"))
    return ch.report_cap(lines, CAP)


def last_n_marks(spark, d):
    return ch.last_n(inp.codes(spark, d).where("severity = 'good'").select("path", "seq", "comp"), 10)


def tlv_offsets(spark, d):
    return ch.record_offsets(inp.codes(spark, d).select("path", "seq", "rec_len"), 12, {"start_even": 2, "start_quad": 4})


def tlv_audit(spark, d):
    c = inp.codes(spark, d)
    drift = F.when(F.col("seq") % 29 == 0, F.col("zrl") - 3).otherwise(F.lit(0))
    return ch.record_audit(c.select("path", "seq", F.col("rec_len").alias("declared"), (F.col("rec_len") + drift).alias("consumed")))


def iptc_abort(spark, d):
    c = inp.codes(spark, d)
    first_byte = F.when(F.col("bits1") == 16, F.lit(0)).otherwise(F.lit(0x1C))
    rows = c.select("path", "seq", first_byte.alias("first_byte"), "rec_len")
    return ch.cut_after_bad(rows, F.col("first_byte") != 0x1C)


def bit_positions(spark, d):
    return ch.bit_positions(inp.codes(spark, d).select("path", "seq", "bits1", "bits2"))


def coef_index(spark, d):
    c = inp.codes(spark, d).select("path", "seq", "zrl", "bits2", "is_rst")
    return ch.coefficient_index(c, ["path"], (F.col("zrl") == 0) & (F.col("bits2") == 0), reset=F.col("is_rst"))


def block_dc(spark, d):
    return ch.block_dc_map(ch.dc_values(inp.codes(spark, d).select("path", "seq", "comp", "delta", "is_rst")), GRID)


def mcu_range(spark, d):
    c = inp.codes(spark, d).select("path", "seq", "severity")
    marks = c.groupBy("path").agg(
        F.max(F.when(F.col("severity") == "good", F.col("seq"))).alias("a"),
        F.max(F.when(F.col("severity") == "header", F.col("seq"))).alias("b"),
    ).where("a IS NOT NULL AND b IS NOT NULL")
    return ch.mcu_range(ch.row_index(c.select("path", "seq"), ["path"], "seq"), marks, "seq")


def pos_lookup(spark, d):
    c = inp.codes(spark, d)
    points = c.select("path", F.col("seq").alias("point"), F.expr("seq % 64").cast("int").alias("px"), F.expr("rec_len % 96").alias("py"))
    return ch.look_up_positions(points, ch.mcu_map(c.select("path", "seq", "bits1", "bits2"), GRID), 8, 8)


def dht_hist(spark, d):
    c = inp.codes(spark, d)
    return stats.code_lengths(c.select(
        "path", F.expr("CAST(seq % 2 AS INT)").alias("class"), (F.col("comp") - 1).alias("dest_id"), F.col("bits1").alias("bitlen")
    ))


def rst_count(spark, d):
    return stats.restart_counts(inp.codes(spark, d))


def dht_expand(spark, d):
    c = inp.codes(spark, d).select("path", "seq", F.col("bits1").alias("bitlen"), F.col("rst").alias("value"))
    return ch.huffman_prefixes(ch.huffman_codes(c))


def dht_codes(spark, d):
    c = inp.codes(spark, d).select("path", "seq", F.col("bits1").alias("bitlen"), F.col("rst").alias("value"))
    return ch.huffman_codes(c)


def _runs(spark, d):
    segs = ch.restart_segments(inp.codes(spark, d).select("path", "seq", "comp", "bits2", "is_rst"))
    return segs.select("path", "rst_seg", "seq", (F.col("bits2") - 5).alias("run"), F.col("comp").alias("val"))


def rle_expand(spark, d):
    c = inp.codes(spark, d).select("path", "seq", (F.col("bits2") - 5).alias("run"), F.col("comp").alias("val"), "is_rst")
    return ch.expand_runs(c, ["path"], reset=F.col("is_rst"))


def rle_audit(spark, d):
    return ch.run_widths(_runs(spark, d), ["path", "rst_seg"], 16)


def dicom_items(spark, d):
    kind = F.when(F.col("severity") == "good", "start").when(F.col("severity") == "warn", "item").when(
        F.col("is_rst"), "end").otherwise("other")
    return ch.encapsulated_items(inp.codes(spark, d).select("path", "seq", kind.alias("kind")))


QUERIES = {
    "dc_running": dc_running,
    "rst_sequence": rst_sequence,
    "rst_overrun": rst_overrun,
    "first_n_errors": first_n_errors,
    "report_cap": report_cap,
    "last_n_marks": last_n_marks,
    "tlv_offsets": tlv_offsets,
    "tlv_audit": tlv_audit,
    "iptc_abort": iptc_abort,
    "bit_positions": bit_positions,
    "coef_index": coef_index,
    "block_dc": block_dc,
    "mcu_range": mcu_range,
    "pos_lookup": pos_lookup,
    "dht_hist": dht_hist,
    "rst_count": rst_count,
    "dht_expand": dht_expand,
    "dht_codes": dht_codes,
    "rle_expand": rle_expand,
    "rle_audit": rle_audit,
    "dicom_items": dicom_items,
}

_C = f"WITH {inp.CODES}"
_S = f"WITH {inp.CODES}, {inp.SEGS}"
_DC = """dc AS (SELECT path, seq, comp, rst_seg, CAST(sum(delta) OVER (PARTITION BY path, comp, rst_seg ORDER BY seq
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS dc FROM segs)"""
_BITS = """bits AS (SELECT path, seq, bits1, bits2, CAST(coalesce(sum(bits1 + bits2) OVER (PARTITION BY path ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM codes)"""
_HUFF = """huff AS (SELECT path, seq, bits1 AS bitlen, rst AS value,
  CAST(coalesce(sum(CAST(1 AS BIGINT) << (16 - bits1)) OVER (PARTITION BY path ORDER BY bits1, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bits, CAST(1 AS BIGINT) << (16 - bits1) AS w FROM codes)"""
_RUNS = """runs AS (SELECT path, rst_seg, seq, comp AS val, CASE WHEN bits2 - 5 < 0 THEN 1 - (bits2 - 5) ELSE 1 + (bits2 - 5) END AS n
  FROM segs)"""

ORACLE = {
    "dc_running": f"{_S}, {_DC} SELECT * FROM dc",
    "rst_sequence": f"""{_C}, e AS (SELECT path, seq, rst,
  coalesce((lag(rst) OVER (PARTITION BY path ORDER BY seq) + 1) % 8, 0) AS expected FROM codes WHERE is_rst)
SELECT *, expected <> rst AS mismatch FROM e""",
    "rst_overrun": f"""{_S}, r AS (SELECT path, seq, rst_seg, row_number() OVER (PARTITION BY path, rst_seg ORDER BY seq) AS rn FROM segs)
SELECT path, seq, rst_seg FROM r WHERE rn = {INTERVAL} + 1""",
    "first_n_errors": f"""{_C}, r AS (SELECT path, severity, seq, CAST(row_number() OVER (PARTITION BY path, severity ORDER BY seq) AS INTEGER) AS rn,
  CASE severity WHEN 'error' THEN 20 ELSE 10 END AS lim FROM codes WHERE severity IN ('error', 'warn'))
SELECT path, severity, seq, rn, rn = lim AS last_reported FROM r WHERE rn <= lim""",
    "report_cap": f"""{_C}, r AS (SELECT path, seq, severity, row_number() OVER (PARTITION BY path ORDER BY seq) AS line_no FROM codes)
SELECT path, seq, line_no, CASE WHEN line_no = {CAP} + 1 THEN 'error' ELSE severity END AS severity,
  CASE WHEN line_no = {CAP} + 1 THEN 'report truncated' ELSE 'code ' || seq END AS text FROM r WHERE line_no <= {CAP} + 1""",
    "last_n_marks": f"""{_C}, r AS (SELECT path, seq, comp, CAST(row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS INTEGER) AS age
  FROM codes WHERE severity = 'good') SELECT * FROM r WHERE age <= 10""",
    "tlv_offsets": f"""{_C} SELECT path, seq, rec_len,
  CAST(coalesce(sum((rec_len + 13) // 2 * 2) OVER w, 0) AS BIGINT) AS start_even,
  CAST(coalesce(sum((rec_len + 15) // 4 * 4) OVER w, 0) AS BIGINT) AS start_quad FROM codes
WINDOW w AS (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "tlv_audit": f"""{_C}, r AS (SELECT path, seq, rec_len AS declared,
    rec_len + CASE WHEN seq % 29 = 0 THEN zrl - 3 ELSE 0 END AS consumed FROM codes),
f AS (SELECT path, min(seq) AS bad FROM r WHERE declared <> consumed GROUP BY path)
SELECT r.path, seq, declared, consumed, CASE WHEN consumed > declared THEN 'error' WHEN consumed < declared THEN 'warn' ELSE 'ok' END AS status
FROM r LEFT JOIN f ON r.path = f.path WHERE bad IS NULL OR seq <= bad""",
    "iptc_abort": f"""{_C}, r AS (SELECT path, seq, CASE WHEN bits1 = 16 THEN 0 ELSE 28 END AS first_byte, rec_len FROM codes),
f AS (SELECT path, min(seq) AS bad FROM r WHERE first_byte <> 28 GROUP BY path)
SELECT r.* FROM r LEFT JOIN f ON r.path = f.path WHERE bad IS NULL OR seq < bad""",
    "bit_positions": f"""{_C}, {_BITS} SELECT path, seq, bits1, bits2, b // 8 AS byte, CAST(b % 8 AS INTEGER) AS bit,
  printf('0x%08X.%d', b // 8, b % 8) AS pos_text FROM bits""",
    "coef_index": f"""{_S}, e AS (SELECT *, zrl = 0 AND bits2 = 0 AS eob FROM segs),
r AS (SELECT path, rst_seg, seq, eob, CASE WHEN eob THEN 0 ELSE zrl + 1 END AS step,
  coalesce(sum(CASE WHEN eob THEN 0 ELSE zrl + 1 END) OVER w, 0) AS before_, coalesce(sum(CASE WHEN eob THEN 1 ELSE 0 END) OVER w, 0) AS ends_
  FROM e WINDOW w AS (PARTITION BY path, rst_seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT path, rst_seg, seq, CAST(least(before_ + step, 64) AS BIGINT) AS coef_idx,
  CASE WHEN eob THEN 'eob' WHEN before_ + step > 64 THEN 'overrun' WHEN before_ + step = 64 THEN 'full' ELSE 'open' END AS status
FROM r WHERE before_ < 64 AND ends_ = 0""",
    "block_dc": f"""{_S}, {_DC}, r AS (SELECT *, row_number() OVER (PARTITION BY path, comp ORDER BY seq) - 1 AS i FROM dc)
SELECT path, i % {GRID} AS bx, i // {GRID} AS by, coalesce(max(dc) FILTER (comp = 1), 0) AS y,
  coalesce(max(dc) FILTER (comp = 2), 0) AS cb, coalesce(max(dc) FILTER (comp = 3), 0) AS cr FROM r GROUP BY path, i""",
    "mcu_range": f"""{_C}, r AS (SELECT path, seq, severity, row_number() OVER (PARTITION BY path ORDER BY seq) - 1 AS idx FROM codes),
m AS (SELECT path, max(idx) FILTER (severity = 'good') AS a, max(idx) FILTER (severity = 'header') AS b FROM r GROUP BY path)
SELECT r.path, seq, idx FROM r JOIN m ON r.path = m.path WHERE idx BETWEEN least(a, b) AND greatest(a, b)
  AND a IS NOT NULL AND b IS NOT NULL""",
    "pos_lookup": f"""{_C}, {_BITS}, m AS (SELECT path, b, row_number() OVER (PARTITION BY path ORDER BY seq) - 1 AS mcu FROM bits),
p AS (SELECT path, seq AS point, CAST(seq % 64 AS INTEGER) AS px, rec_len % 96 AS py FROM codes)
SELECT p.path, point, px, py, CAST(px // 8 AS BIGINT) AS mcu_x, CAST(py // 8 AS BIGINT) AS mcu_y, b // 8 AS byte, CAST(b % 8 AS INTEGER) AS bit
FROM p LEFT JOIN m ON p.path = m.path AND m.mcu = (py // 8) * {GRID} + px // 8""",
    "dht_hist": f"""{_C}, t AS (SELECT path, CAST(seq % 2 AS INTEGER) AS class, comp - 1 AS dest_id, bits1 FROM codes),
g AS (SELECT path, class, dest_id, count(*) AS total FROM t GROUP BY ALL),
h AS (SELECT path, class, dest_id, bits1, count(*) AS n FROM t GROUP BY ALL)
SELECT g.path, g.class, g.dest_id, CAST(l.i AS INTEGER) AS bitlen, coalesce(h.n, 0) AS n, coalesce(h.n, 0) * 100.0::DOUBLE / total AS pct
FROM g CROSS JOIN range(1, 17) l(i) LEFT JOIN h ON g.path = h.path AND g.class = h.class AND g.dest_id = h.dest_id AND h.bits1 = l.i""",
    "rst_count": f"{_C} SELECT path, count(*) FILTER (is_rst) AS n_rst FROM codes GROUP BY path",
    "dht_expand": f"""{_C}, {_HUFF} SELECT path, seq, bitlen, value, bits // 128 + r.i AS prefix FROM huff, range(256) r(i)
WHERE bits + w <= 65536 AND bitlen <= 9 AND r.i < (1 << (9 - bitlen))""",
    "dht_codes": f"""{_C}, {_HUFF} SELECT path, seq, bitlen, value, bits, 65536 - w AS mask, bits + w <= 65536 AS valid FROM huff""",
    "rle_expand": f"""{_S}, {_RUNS}, a AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY path, rst_seg ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x0 FROM runs)
SELECT path, rst_seg, x0 + r.i AS x, val FROM a, range(16) r(i) WHERE r.i < n""",
    "rle_audit": f"""{_S}, {_RUNS} SELECT path, rst_seg, CAST(sum(n) AS BIGINT) AS expanded, sum(n) = 16 AS ok FROM runs GROUP BY path, rst_seg""",
    "dicom_items": f"""{_C}, k AS (SELECT path, seq, CASE WHEN severity = 'good' THEN 'start' WHEN severity = 'warn' THEN 'item'
    WHEN is_rst THEN 'end' ELSE 'other' END AS kind FROM codes),
r AS (SELECT *, coalesce(sum(CASE WHEN kind = 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM k),
o AS (SELECT path, run, min(seq) AS opened FROM r WHERE kind = 'start' GROUP BY path, run),
i AS (SELECT r.path, r.seq, kind, kind = 'item' AND opened IS NOT NULL AND seq > opened AS item, r.run FROM r LEFT JOIN o ON r.path = o.path AND r.run = o.run),
n AS (SELECT *, sum(CASE WHEN item THEN 1 ELSE 0 END) OVER (PARTITION BY path, run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS item_no FROM i)
SELECT path, seq, kind, item AND item_no = 1 AS is_offset_table, item AND item_no > 1 AS is_jpeg FROM n""",
}
