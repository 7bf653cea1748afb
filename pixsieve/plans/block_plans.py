"""Queries on blocks, tables, pixels and frame facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixsieve.operators import blocks as blk
from pixsieve.operators import chains
from pixsieve.operators import stats
from pixsieve.plans import inputs as inp
from pixsieve.sources.dims import STD_QUANT_LUMA, idct_weights

SHIFT_FROM, SHIFT = 200, (40, -16, 24)


def _coloured(spark, d, fixed_point=False):
    return blk.with_colour(inp.pixels(spark, d), fixed_point)


def _tables(spark, d, scale=1):
    """block_id, image_id, table of 64 in zigzag order: every block read as a quantisation table."""
    return inp.block_arrays(spark, d).select(
        "block_id", "image_id", F.transform("q", lambda v: (F.lit(1) + (F.abs(v) * scale) % (255 * scale)).cast("int")).alias("t")
    )


def zigzag(spark, d):
    b = inp.block_arrays(spark, d)
    z = b.select("block_id", F.arrays_zip(
        F.col("q").alias("q"), blk.to_zigzag_order(F.col("q")).alias("zz"), blk.to_normal_order(F.col("q")).alias("unzz"),
        blk.permute(F.col("q"), inp.ROTATE).alias("rot")).alias("a"))
    return z.select("block_id", F.posexplode("a").alias("pos", "c")).select("block_id", "pos", "c.zz", "c.unzz", "c.rot")


def _dequantised(spark, d):
    c = inp.block_arrays(spark, d).withColumn("comp", (F.col("block_id") % 3 + 1).cast("int"))
    return blk.dequantise(c, inp.dqt_arrays(spark, d))


def dequant(spark, d):
    return _dequantised(spark, d).select("image_id", "block_id", "comp", F.posexplode("coef").alias("pos", "value"))


def idct(spark, d):
    x = inp.block_arrays(spark, d).select("block_id", F.posexplode(blk.idct_ac("q")).alias("yx", "v"))
    return x.select("block_id", "yx", F.round("v", 4).alias("value"))


def idct_fixed(spark, d):
    return inp.block_arrays(spark, d).select("block_id", F.posexplode(blk.idct_ac_fixed("q")).alias("yx", "value"))


def expand_pixels(spark, d):
    c = _dequantised(spark, d)
    ready = c.select("block_id", "comp", "coef", F.get("coef", 0).alias("dc"))
    rep = F.when(F.col("comp") == 1, F.lit(1)).otherwise(F.lit(2))
    return blk.expand_pixels(ready, blk.idct_ac("coef"), "dc", rep, rep).drop("coef")


_RGB = ("block_id", "idx", "pre_y", "pre_cb", "pre_cr", "fin_y", "fin_cb", "fin_cr", "pre_r", "pre_g", "pre_b", "fin_r", "fin_g", "fin_b")


def ycc_rgb(spark, d):
    return _coloured(spark, d).select(*_RGB)


def ycc_rgb_fixed(spark, d):
    return _coloured(spark, d, fixed_point=True).select(*_RGB)


def color_stats(spark, d):
    s = stats.color_stats(_coloured(spark, d))
    return s.withColumn("mean", F.round("mean", 4))


def clip_counts(spark, d):
    return stats.clip_counts(_coloured(spark, d).withColumn("clip_mask", blk.clip_mask()))


def rgb_hist(spark, d):
    return stats.rgb_histogram(_coloured(spark, d))


def y_hist(spark, d):
    return stats.y_histogram(inp.pixels(spark, d))


def y_hist_rows(spark, d):
    return stats.y_histogram_rows(inp.pixels(spark, d))


def hist_norm(spark, d):
    return stats.histogram_bars(_coloured(spark, d))


def brightest(spark, d):
    return stats.brightest(inp.pixel_cells(spark, d))


def avg_luma(spark, d):
    return stats.mean_luminance(_coloured(spark, d))


def channel_extract(spark, d):
    mode = (F.col("block_id") % 9).cast("int")
    return blk.channel_extract(_coloured(spark, d).withColumn("mode", mode), F.col("mode")).select(
        "block_id", "idx", "mode", "out_r", "out_g", "out_b")


def ycc_shift(spark, d):
    return blk.shift_ycc(inp.pixels(spark, d), F.col("block_id"), F.lit(SHIFT_FROM), *SHIFT)


def export_scale(spark, d):
    modes = {"rgb8": ("rgb", 8), "rgb16": ("rgb", 16), "ycc8": ("ycc", 8)}
    forms = [F.struct(F.lit(mode).alias("mode"), *blk.export_samples(colour, bits)) for mode, (colour, bits) in modes.items()]
    return _coloured(spark, d).select("block_id", "idx", F.inline(F.array(*forms)))


def plane_pivot(spark, d):
    b = inp.block_arrays(spark, d)
    planes = F.array(
        F.col("q"), blk.permute(F.col("q"), inp.ROTATE), F.reverse("q"), F.transform("q", lambda v: -v)
    )
    rows = b.select(F.col("block_id").alias("path"), F.posexplode(planes).alias("chan", "plane"))
    lines = rows.select("path", "chan", "plane", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"))
    lines = lines.select("path", "y", "chan", F.slice("plane", F.col("y") * 8 + 1, F.lit(8)).alias("samples"))
    return blk.planes_to_rgb(lines)


def signature(spark, d):
    t = _tables(spark, d)
    tables = t.select(
        F.col("block_id").alias("image_id"),
        F.posexplode(F.array(F.col("t"), F.reverse("t"))).alias("dest_id", "table_zz"),
        F.when(F.col("block_id") % 2 == 0, "2x2").otherwise("1x1").alias("subsampling"),
    )
    return blk.compression_signature(tables)


def dqt_flags(spark, d):
    return blk.table_flags(_tables(spark, d, 9), "t").select("block_id", "all_same", "baseline")


def dqt_quality(spark, d):
    t = _tables(spark, d).select("block_id", F.round(blk.table_quality(blk.to_normal_order(F.col("t"))), 4).alias("quality"))
    return t


def bounds_check(spark, d):
    a = F.abs("q")
    rows = inp.blocks(spark, d).select(
        "block_id", "pos", (a % 5).alias("dest"), (F.col("pos") + a % 8).alias("coeff"), (a * 7).alias("comp"),
        (a % 6).alias("scan_comp"), (a % 3).alias("cls"), (a * 13).alias("code"))
    return rows.select("block_id", "pos", blk.bounds_reason(
        *[F.col(c) for c in ("dest", "coeff", "comp", "scan_comp", "cls", "code")]).alias("reason"))


def validate_value(spark, d):
    b = inp.blocks(spark, d)
    return b.select("block_id", "pos", "q", blk.validate_value(F.col("q"), -10, 12, F.col("pos") % 2 == 0, 7).alias("value"))


def support_gate(spark, d):
    b, a = inp.blocks(spark, d), F.abs("q")
    return b.select("block_id", "pos", blk.support_reason(
        (a % 4).cast("int"), (a % 6).cast("int"), (F.col("pos") % 4 + 1).cast("int"), a % 3).alias("reason"))


def table_binding(spark, d):
    b = inp.block_arrays(spark, d).withColumnRenamed("block_id", "path")

    def pick(at):
        v = F.abs(F.get("q", at)) % 5
        return F.when(v < 4, v)

    comps = b.select("path", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("comp"), "q").select(
        "path", "comp", pick(F.col("comp")).alias("tq"), pick(F.col("comp") + 8).alias("td"), pick(F.col("comp") + 16).alias("ta"))
    dqt = b.select("path", F.posexplode(F.slice("q", 25, 4)).alias("dest_id", "v")).select(
        "path", "dest_id", F.greatest(F.col("v") + 8, F.lit(0)).alias("n"))
    dht = b.select("path", F.posexplode(F.slice("q", 33, 8)).alias("k", "v")).select(
        "path", F.expr("k DIV 4").alias("class"), (F.col("k") % 4).alias("dest_id"), F.greatest(F.col("v") + 12, F.lit(0)).alias("n"))
    return blk.bind_tables(comps, dqt, dht)


def blk_lookup(spark, d):
    dc = inp.block_arrays(spark, d).select("image_id", "block_id", F.get("q", 0).alias("v"))
    grid = dc.groupBy("image_id", F.expr("block_id DIV 3").alias("cell")).agg(
        *[F.max(F.when(F.col("block_id") % 3 == i, F.col("v"))).alias(n) for i, n in ((0, "y"), (1, "cb"), (2, "cr"))])
    points = dc.select("image_id", F.col("block_id").alias("point"), F.expr("(block_id + 7) DIV 3").alias("cell"))
    found = chains.look_up_blocks(points, grid, ["image_id", "cell"])
    return found.select("image_id", "point", "cell", "y", F.col("cb").cast("int").alias("cb"), F.col("cr").cast("int").alias("cr"))


def mcu_geometry(spark, d):
    return blk.mcu_geometry(inp.facts(spark, d))


def comp_ratio(spark, d):
    f = inp.facts(spark, d)
    rows = f.select("path", "width", "height", F.lit(3).alias("ncomp"), F.lit(0).cast("bigint").alias("first_byte"), F.col("scan_bytes").alias("last_byte"))
    s = stats.compression(rows)
    return s.select("path", "scan_bytes", F.round("ratio", 4).alias("ratio"), F.round("bits_per_pixel", 4).alias("bits_per_pixel"))


def frame_flags(spark, d):
    return blk.frame_flags(inp.facts(spark, d)).select("path", "n", "width", "height", "landscape", "subsampling")


QUERIES = {f.__name__: f for f in (
    zigzag, dequant, idct, idct_fixed, expand_pixels, ycc_rgb, ycc_rgb_fixed, color_stats, clip_counts,
    rgb_hist, y_hist, y_hist_rows, hist_norm, brightest, avg_luma, channel_extract, ycc_shift, export_scale, plane_pivot,
    signature, dqt_flags, dqt_quality, bounds_check, validate_value, support_gate, table_binding, blk_lookup,
    mcu_geometry, comp_ratio, frame_flags,
)}

_B = f"WITH {inp.BLOCKS}"
_P = f"WITH {inp.BLOCKS}, {inp.PIXELS}"
_W = idct_weights()
_IDCT_DIM = """w AS (SELECT CAST(y.i * 8 + x.i AS INTEGER) AS yx, CAST(v.i * 8 + u.i AS INTEGER) AS vu,
  0.25 * (CASE u.i WHEN 0 THEN sqrt(0.5) ELSE 1 END) * (CASE v.i WHEN 0 THEN sqrt(0.5) ELSE 1 END)
  * cos((2 * x.i + 1) * u.i * pi() / 16) * cos((2 * y.i + 1) * v.i * pi() / 16) AS k
  FROM range(8) y(i), range(8) x(i), range(8) v(i), range(8) u(i) WHERE v.i + u.i > 0)"""
_DEQ = f"""deq AS (SELECT b.image_id, b.block_id, CAST(b.block_id % 3 + 1 AS INTEGER) AS comp,
  CAST(({inp.ZZ_SQL})[b.pos + 1] AS INTEGER) AS pos,
  CAST(((b.q * t.value + 32768) % 65536 + 65536) % 65536 - 32768 AS INTEGER) AS value
  FROM blocks b JOIN dqt t ON b.image_id = t.image_id AND b.pos = t.zz)"""


def _colour_sql(fixed: bool = False) -> str:
    """col: pixels with the colour chain."""
    if fixed:
        rgb = """CAST(((1436 * (fin_cr - 128) + 1024 * (fin_y - 128)) >> 10) + 128 AS INTEGER) AS pre_r,
      CAST(floor(trunc((1048576 * (fin_y - 128) - 116 * (1816 * (fin_cb - 128) + 1024 * (fin_y - 128))
         - 306 * (1436 * (fin_cr - 128) + 1024 * (fin_y - 128))) / 601.0::DOUBLE) / 1024) + 128 AS INTEGER) AS pre_g,
      CAST(((1816 * (fin_cb - 128) + 1024 * (fin_y - 128)) >> 10) + 128 AS INTEGER) AS pre_b"""
    else:
        rgb = """CAST(trunc(r_ + 128) AS INTEGER) AS pre_r, CAST(trunc((((fin_y - 128) - 0.114::DOUBLE * b_) - 0.299::DOUBLE * r_) / 0.587::DOUBLE + 128) AS INTEGER) AS pre_g,
      CAST(trunc(b_ + 128) AS INTEGER) AS pre_b"""
    return f"""c1 AS (SELECT *, CAST(floor(yv / 8.0::DOUBLE) + 128 AS INTEGER) AS pre_y, CAST(floor(cb / 8.0::DOUBLE) + 128 AS INTEGER) AS pre_cb,
    CAST(floor(cr / 8.0::DOUBLE) + 128 AS INTEGER) AS pre_cr FROM pixels),
  c2 AS (SELECT *, least(greatest(pre_y, 0), 255) AS fin_y, least(greatest(pre_cb, 0), 255) AS fin_cb,
    least(greatest(pre_cr, 0), 255) AS fin_cr FROM c1),
  c3 AS (SELECT *, (fin_cr - 128) * (2 - 2 * 0.299::DOUBLE) + (fin_y - 128) AS r_, (fin_cb - 128) * (2 - 2 * 0.114::DOUBLE) + (fin_y - 128) AS b_ FROM c2),
  c4 AS (SELECT *, {rgb} FROM c3),
  col AS (SELECT *, least(greatest(pre_r, 0), 255) AS fin_r, least(greatest(pre_g, 0), 255) AS fin_g,
    least(greatest(pre_b, 0), 255) AS fin_b FROM c4)"""


_K = f"{_P}, {_colour_sql()}"
_MASK = " | ".join(
    f"CASE WHEN pre_{n} < 0 THEN {u}::BIGINT WHEN pre_{n} > 255 THEN {o}::BIGINT ELSE 0::BIGINT END" for n, (u, o) in blk.CLIP_BITS.items()
)
_COUNTS = ", ".join(
    f"count(*) FILTER (pre_{n} < 0) AS {n}_under, count(*) FILTER (pre_{n} > 255) AS {n}_over" for n in ("y", "cb", "cr", "r", "g", "b")
)
_YH = """yh AS (SELECT image_id, least(greatest(yv, -1024), 1023) + 1024 AS bin, count(*) AS n FROM pixels GROUP BY ALL)"""
_RH = """rh AS (SELECT image_id, channel, bin, count(*) AS n FROM (
  SELECT image_id, 'r' AS channel, CAST(fin_r // 2 AS BIGINT) AS bin FROM col UNION ALL SELECT image_id, 'g', fin_g // 2 FROM col
  UNION ALL SELECT image_id, 'b', fin_b // 2 FROM col) GROUP BY ALL)"""


def _pick_sql(slot: int) -> str:
    names = {"r": "fin_r", "g": "fin_g", "b": "fin_b", "y": "fin_y", "cb": "fin_cb", "cr": "fin_cr"}
    whens = " ".join(f"WHEN {m} THEN {names[c[slot]]}" for m, c in blk.PREVIEW_MODES.items())
    return f"CASE block_id % 9 {whens} END"


ORACLE = {
    "zigzag": f"""WITH {inp.ARRAYS} SELECT block_id, CAST(r.i AS INTEGER) AS pos, q[({inp.ZZ_SQL})[r.i + 1] + 1] AS zz,
  q[({inp.UNZZ_SQL})[r.i + 1] + 1] AS unzz, q[({inp.ROT_SQL})[r.i + 1] + 1] AS rot FROM arrays, range(64) r(i)""",
    "dequant": f"{_B}, {inp.DQT}, {_DEQ} SELECT * FROM deq",
    "idct": f"""{_B}, {_IDCT_DIM} SELECT block_id, yx, round(sum(k * q), 4) AS value FROM blocks JOIN w ON pos = vu GROUP BY block_id, yx""",
    "idct_fixed": f"""{_B}, {_IDCT_DIM}, s AS (SELECT block_id, yx, sum(CAST(trunc(k * 4 * 1024) AS BIGINT) * q) AS t
  FROM blocks JOIN w ON pos = vu GROUP BY block_id, yx)
SELECT block_id, yx, CAST(floor(trunc(t / 4.0::DOUBLE) / 1024) AS INTEGER) AS value FROM s""",
    "expand_pixels": f"""{_B}, {inp.DQT}, {_DEQ}, {_IDCT_DIM},
i AS (SELECT block_id, comp, yx, sum(k * value) AS v FROM deq JOIN w ON pos = vu GROUP BY block_id, comp, yx),
e AS (SELECT i.block_id, i.comp, yx, CAST(trunc(v * 8) AS INTEGER) + value AS value, CASE WHEN i.comp = 1 THEN 1 ELSE 2 END AS rep
  FROM i JOIN deq d ON i.block_id = d.block_id AND d.pos = 0)
SELECT block_id, comp, CAST((yx % 8) * rep + h.i AS INTEGER) AS x, CAST((yx // 8) * rep + v.i AS INTEGER) AS y, value
FROM e, range(2) h(i), range(2) v(i) WHERE h.i < rep AND v.i < rep""",
    "ycc_rgb": f"{_K} SELECT {', '.join(_RGB)} FROM col",
    "ycc_rgb_fixed": f"{_P}, {_colour_sql(True)} SELECT {', '.join(_RGB)} FROM col",
    "color_stats": f"{_K} " + " UNION ALL ".join(
        f"SELECT image_id, '{s}' AS stage, '{n}' AS channel, min({c}) AS lo, max({c}) AS hi, round(avg({c}), 4) AS mean FROM col GROUP BY image_id"
        for s, n, c in stats.STAGES),
    "clip_counts": f"{_K} SELECT image_id, {_COUNTS}, bit_or({_MASK}) AS mask FROM col GROUP BY image_id",
    "rgb_hist": f"{_K}, {_RH} SELECT * FROM rh",
    "y_hist": f"{_P}, {_YH} SELECT * FROM yh",
    "y_hist_rows": f"""{_P}, {_YH} SELECT i.image_id, CAST(b.i // 8 AS INTEGER) AS row_no,
  string_agg(CAST(coalesce(n, 0) AS VARCHAR), ' ' ORDER BY b.i) AS counts
FROM (SELECT DISTINCT image_id FROM yh) i CROSS JOIN range(2048) b(i) LEFT JOIN yh ON yh.image_id = i.image_id AND yh.bin = b.i
GROUP BY i.image_id, b.i // 8""",
    "hist_norm": f"""{_K}, {_YH}, {_RH}, a AS (SELECT image_id, 'y' AS channel, CAST(bin // 4 AS BIGINT) AS bin, CAST(sum(n) AS BIGINT) AS n FROM yh GROUP BY ALL
  UNION ALL SELECT image_id, channel, bin, n FROM rh),
p AS (SELECT *, greatest(max(n) OVER (PARTITION BY image_id, channel = 'y'), 1) AS peak FROM a)
SELECT image_id, channel, bin, n, CAST(30 * n // peak AS BIGINT) AS height FROM p""",
    "brightest": f"""{_K}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY yv DESC, block_id, idx) AS rn FROM col)
SELECT image_id, block_id, idx, yv, cb, cr, fin_r, fin_g, fin_b FROM r WHERE rn = 1""",
    "avg_luma": f"{_K} SELECT image_id, CAST(sum(fin_y) AS BIGINT) // count(*) AS avg_luma FROM col GROUP BY image_id",
    "channel_extract": f"""{_K} SELECT block_id, idx, CAST(block_id % 9 AS INTEGER) AS mode, {_pick_sql(0)} AS out_r, {_pick_sql(1)} AS out_g,
  {_pick_sql(2)} AS out_b FROM col""",
    "ycc_shift": f"""{_P} SELECT image_id, block_id, idx, yv + CASE WHEN block_id >= {SHIFT_FROM} THEN {SHIFT[0]} ELSE 0 END AS yv,
  cb + CASE WHEN block_id >= {SHIFT_FROM} THEN {SHIFT[1]} ELSE 0 END AS cb, cr + CASE WHEN block_id >= {SHIFT_FROM} THEN {SHIFT[2]} ELSE 0 END AS cr FROM pixels""",
    "export_scale": f"""{_K} SELECT block_id, idx, 'rgb8' AS mode, fin_r AS e0, fin_g AS e1, fin_b AS e2 FROM col
UNION ALL SELECT block_id, idx, 'rgb16', ((fin_r * 256) % 256) * 256 + (fin_r * 256) // 256, ((fin_g * 256) % 256) * 256 + (fin_g * 256) // 256,
  ((fin_b * 256) % 256) * 256 + (fin_b * 256) // 256 FROM col
UNION ALL SELECT block_id, idx, 'ycc8', (least(greatest(yv, -1024), 1023) + 1024) // 8, (least(greatest(cb, -1024), 1023) + 1024) // 8,
  (least(greatest(cr, -1024), 1023) + 1024) // 8 FROM col""",
    "plane_pivot": f"""WITH {inp.ARRAYS} SELECT block_id AS path, CAST(r.i // 8 AS INTEGER) AS y, CAST(r.i % 8 AS INTEGER) AS x, q[r.i + 1] AS r,
  q[(r.i % 8) * 8 + r.i // 8 + 1] AS g, q[64 - r.i] AS b FROM arrays, range(64) r(i)""",
    "signature": f"""{_B}, t AS (SELECT block_id, pos, 1 + abs(q) % 255 AS v FROM blocks),
o AS (SELECT block_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS p0, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos DESC) AS p1,
  string_agg(CAST(v AS VARCHAR), ',' ORDER BY ({inp.UNZZ_SQL})[({inp.ROT_SQL})[({inp.ZZ_SQL})[pos+1]+1]+1]) AS r0,
  string_agg(CAST(v AS VARCHAR), ',' ORDER BY ({inp.UNZZ_SQL})[({inp.ROT_SQL})[({inp.ZZ_SQL})[63-pos+1]+1]+1]) AS r1
  FROM t GROUP BY block_id)
SELECT block_id AS image_id, upper(md5(concat_ws(';', CASE WHEN block_id % 2 = 0 THEN '2x2' ELSE '1x1' END, p0, p1))) AS csig,
  upper(md5(concat_ws(';', CASE WHEN block_id % 2 = 0 THEN '2x2' ELSE '1x1' END, r0, r1))) AS csig_rot FROM o""",
    "dqt_flags": f"""{_B}, t AS (SELECT block_id, 1 + (abs(q) * 9) % (255 * 9) AS v FROM blocks)
SELECT block_id, min(v) = max(v) AS all_same, max(v) <= 255 AS baseline FROM t GROUP BY block_id""",
    "dqt_quality": f"""{_B}, s AS (SELECT block_id, sum(100.0::DOUBLE * (1 + abs(q) % 255) / ({inp.sql_list(STD_QUANT_LUMA)})[({inp.ZZ_SQL})[pos + 1] + 1]) / 64 AS s
  FROM blocks GROUP BY block_id)
SELECT block_id, round(CASE WHEN s <= 100 THEN (200 - s) / 2 ELSE 5000 / s END, 4) AS quality FROM s""",
    "bounds_check": f"""{_B} SELECT block_id, pos, CASE WHEN abs(q) % 5 >= 4 THEN 'dest' WHEN pos + abs(q) % 8 >= 64 THEN 'coeff'
  WHEN abs(q) * 7 >= 256 THEN 'comp' WHEN abs(q) % 6 NOT BETWEEN 1 AND 4 THEN 'scan_comp' WHEN abs(q) % 3 >= 2 THEN 'class'
  WHEN abs(q) * 13 >= 260 THEN 'code' END AS reason FROM blocks""",
    "validate_value": f"""{_B} SELECT block_id, pos, q, CASE WHEN q BETWEEN -10 AND 12 THEN q WHEN pos % 2 = 0 THEN 7 END AS value FROM blocks""",
    "support_gate": f"""{_B} SELECT block_id, pos, CASE WHEN abs(q) % 4 NOT IN (1, 3) THEN 'components'
  WHEN abs(q) % 6 NOT BETWEEN 1 AND 4 OR pos % 4 + 1 NOT BETWEEN 1 AND 4 THEN 'sampling' WHEN abs(q) % 3 = 0 THEN 'empty' END AS reason FROM blocks""",
    "table_binding": f"""{_B}, comps AS (SELECT block_id AS path, c.i AS comp,
    (SELECT CASE WHEN abs(q) % 5 < 4 THEN abs(q) % 5 END FROM blocks x WHERE x.block_id = b.block_id AND x.pos = c.i) AS tq,
    (SELECT CASE WHEN abs(q) % 5 < 4 THEN abs(q) % 5 END FROM blocks x WHERE x.block_id = b.block_id AND x.pos = c.i + 8) AS td,
    (SELECT CASE WHEN abs(q) % 5 < 4 THEN abs(q) % 5 END FROM blocks x WHERE x.block_id = b.block_id AND x.pos = c.i + 16) AS ta
  FROM (SELECT DISTINCT block_id FROM blocks) b, range(1, 4) c(i)),
m AS (SELECT c.*, q.block_id IS NOT NULL AS hq, d.block_id IS NOT NULL AS hd, a.block_id IS NOT NULL AS ha FROM comps c
  LEFT JOIN blocks q ON q.block_id = path AND q.pos = 24 + tq AND q.q + 8 > 0
  LEFT JOIN blocks d ON d.block_id = path AND d.pos = 32 + td AND d.q + 12 > 0
  LEFT JOIN blocks a ON a.block_id = path AND a.pos = 36 + ta AND a.q + 12 > 0)
SELECT path, count(*) AS n_comp, count(*) FILTER (NOT hq) AS no_dqt, count(*) FILTER (NOT hd) AS no_dc, count(*) FILTER (NOT ha) AS no_ac,
  bool_and(hq AND hd AND ha) AS ready FROM m GROUP BY path""",
    "blk_lookup": f"""{_B}, dc AS (SELECT image_id, block_id, q FROM blocks WHERE pos = 0),
g AS (SELECT image_id, block_id // 3 AS cell, max(q) FILTER (block_id % 3 = 0) AS y, max(q) FILTER (block_id % 3 = 1) AS cb,
  max(q) FILTER (block_id % 3 = 2) AS cr FROM dc GROUP BY ALL)
SELECT dc.image_id, block_id AS point, (block_id + 7) // 3 AS cell, y, coalesce(cb, 0) AS cb, coalesce(cr, 0) AS cr
FROM dc LEFT JOIN g ON g.image_id = dc.image_id AND g.cell = (block_id + 7) // 3""",
    "mcu_geometry": f"""WITH {inp.FACTS}, p AS (SELECT path, count(*) AS ncomp, max(width) AS w, max(height) AS h,
  CASE WHEN count(*) = 1 THEN 1 ELSE max(hmax) END AS h_hi, CASE WHEN count(*) = 1 THEN 1 ELSE max(vmax) END AS v_hi,
  CASE WHEN count(*) = 1 THEN 1 ELSE min(hmax) END AS h_lo, CASE WHEN count(*) = 1 THEN 1 ELSE min(vmax) END AS v_lo FROM facts GROUP BY path),
g AS (SELECT *, h_hi * 8 AS mcu_w, v_hi * 8 AS mcu_h, CAST(ceil(w / (h_hi * 8.0::DOUBLE)) AS INTEGER) AS mcu_x,
  CAST(ceil(h / (v_hi * 8.0::DOUBLE)) AS INTEGER) AS mcu_y FROM p)
SELECT path, ncomp, h_hi, v_hi, h_lo, v_lo, mcu_w, mcu_h, mcu_x, mcu_y, mcu_x * h_hi AS blk_x, mcu_y * v_hi AS blk_y,
  mcu_x * mcu_w AS padded_w, mcu_y * mcu_h AS padded_h FROM g""",
    "comp_ratio": f"""WITH {inp.FACTS}, p AS (SELECT path, CAST(max(width) AS BIGINT) AS w, CAST(max(height) AS BIGINT) AS h, max(scan_bytes) AS scan_bytes FROM facts GROUP BY path)
SELECT path, scan_bytes, round(w * h * 3 / nullif(scan_bytes, 0)::DOUBLE, 4) AS ratio, round(scan_bytes * 8 / (w * h)::DOUBLE, 4) AS bits_per_pixel FROM p""",
    "frame_flags": f"""WITH {inp.FACTS} SELECT path, n, width, height, CASE WHEN width > height THEN 'yes' ELSE 'no' END AS landscape,
  hmax || 'x' || vmax AS subsampling FROM facts""",
}
