import math
import random

import pytest
from pyspark.sql import functions as F

from pixsieve.functions import scalars as sc
from pixsieve.operators import blocks as blk
from pixsieve.operators import stats
from pixsieve.sources.dims import ROTATE, STD_QUANT_CHROMA, STD_QUANT_LUMA, UNZIGZAG, ZIGZAG


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in cols.items()])


def test_orders_are_permutations():
    assert sorted(ZIGZAG) == list(range(64)) and [UNZIGZAG[z] for z in ZIGZAG] == list(range(64))
    assert [ROTATE[ROTATE[p]] for p in range(64)] == list(range(64))
    assert ZIGZAG[:10] == (0, 1, 8, 16, 9, 2, 3, 10, 17, 24) and ZIGZAG[-3:] == (55, 62, 63)


def test_reordering_round_trips(spark):
    vals = list(range(100, 164))
    r = one(spark, t=vals).select(
        blk.to_normal_order(blk.to_zigzag_order(F.col("t"))).alias("a"), blk.rotate_table(blk.rotate_table(F.col("t"))).alias("b"),
        blk.rotate_table(F.col("t")).alias("c")).collect()[0]
    assert list(r.a) == vals and list(r.b) == vals and list(r.c) != vals


def test_dequantise_wraps_and_skips(spark):
    c = spark.createDataFrame([(1, "a", [30000, -30000] + [1] * 62), (1, "long", [2] * 70)], "image_id INT, name STRING, q ARRAY<INT>")
    t = spark.createDataFrame([(1, [2] * 64)], "image_id INT, table_zz ARRAY<INT>")
    r = {x.name: list(x.coef) for x in blk.dequantise(c, t).collect()}
    assert r["a"][:2] == [60000 - 65536, -60000 + 65536] and r["a"][8] == 2
    assert r["long"] == [4] * 64


def test_idct_matches_the_definition(spark):
    rng = random.Random(1)
    q = [rng.randint(-99, 99) for _ in range(64)]
    df = spark.createDataFrame([(q,), ([5] + [0] * 63,)], "q ARRAY<INT>")
    c = lambda k: math.sqrt(0.5) if k == 0 else 1.0
    want = [sum(0.25 * c(u) * c(v) * q[v * 8 + u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)
                for v in range(8) for u in range(8) if u + v) for y in range(8) for x in range(8)]
    rows = df.select(blk.idct_ac("q").alias("v"), blk.idct_ac_fixed("q").alias("f")).collect()
    assert list(rows[0].v) == pytest.approx(want, abs=1e-9)
    assert max(abs(a - b) for a, b in zip(rows[0].f, want)) < 3
    assert list(rows[1].v) == [0.0] * 64  # the constant term is left out


def test_expand_replicates(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(64)], 10)], "b INT, ac ARRAY<DOUBLE>, dc INT")
    rows = {(r.x, r.y): r.value for r in blk.expand_pixels(df, "ac", "dc", F.lit(2), F.lit(1)).collect()}
    assert len(rows) == 128 and rows[0, 0] == rows[1, 0] == 10 and rows[15, 7] == 63 * 8 + 10 and rows[2, 1] == 9 * 8 + 10


def test_colour_range_edges(spark):
    vals = (-1033, -1025, -1024, -1, 0, 1023, 1024, 1040)
    df = spark.createDataFrame([(1, i, 0, v, 0, 0) for i, v in enumerate(vals)], "image_id INT, block_id INT, idx INT, yv INT, cb INT, cr INT")
    col = blk.with_colour(df).withColumn("clip_mask", blk.clip_mask())
    rows = {r.yv: r for r in col.collect()}
    assert {v: rows[v].pre_y for v in vals} == {-1033: -2, -1025: -1, -1024: 0, -1: 127, 0: 128, 1023: 255, 1024: 256, 1040: 258}
    assert rows[-1025].clip_mask & 0x80000000 and not rows[-1024].clip_mask & 0x80000000
    assert (rows[1024].fin_y, rows[1024].fin_r, rows[1024].fin_g) == (255, 255, 255)
    n = stats.clip_counts(col).collect()[0]
    assert (n.y_under, n.y_over) == (2, 2)
    cells = df.groupBy("image_id", "block_id").agg(F.collect_list(F.struct("idx", "yv", "cb", "cr")).alias("cells"))
    top = stats.brightest(cells).collect()[0]
    assert (top.yv, top.block_id, top.idx, top.fin_r) == (1040, 7, 0, 255)
    hist = {r.bin: r.n for r in stats.y_histogram(df).collect()}
    assert hist == {0: 3, 1023: 1, 1024: 1, 2047: 3} and sum(hist.values()) == len(vals)


def test_export_modes(spark):
    df = blk.with_colour(one(spark, yv=-2000, cb=0, cr=1023))
    assert blk.export_scale(df, "ycc", 8).select("e0", "e1", "e2").collect()[0] == (0, 128, 255)
    r = blk.export_scale(df, "rgb", 16).select("e0", "fin_r").collect()[0]
    assert r.e0 == r.fin_r
    with pytest.raises(ValueError):
        blk.export_scale(df, "ycc", 16)


def test_quality_of_scaled_standard_tables(spark):
    r = one(spark, a=list(STD_QUANT_LUMA), b=[v * 2 for v in STD_QUANT_LUMA], c=list(STD_QUANT_CHROMA)).select(
        blk.table_quality(F.col("a")).alias("a"), blk.table_quality(F.col("b")).alias("b"), blk.table_quality(F.col("c"), STD_QUANT_CHROMA).alias("c")).collect()[0]
    assert (round(r.a, 6), round(r.b, 6), round(r.c, 6)) == (50.0, 25.0, 50.0)


def test_single_component_geometry(spark):
    df = spark.createDataFrame([("a", 17, 9, 2, 2), ("b", 17, 9, 2, 2), ("b", 17, 9, 1, 1)], "path STRING, width INT, height INT, hmax INT, vmax INT")
    r = {x.path: x for x in blk.mcu_geometry(df).collect()}
    assert (r["a"].mcu_w, r["a"].mcu_x, r["a"].blk_x, r["a"].padded_w) == (8, 3, 3, 24)
    assert (r["b"].mcu_w, r["b"].mcu_x, r["b"].mcu_y, r["b"].blk_x, r["b"].h_lo) == (16, 2, 1, 4, 1)


def test_scalars(spark):
    r = one(spark, v=0xABCD, t=0x61620063, z=0).select(
        sc.to_binary(F.col("v"), 16, True).alias("bin"), sc.four_chars(F.col("t")).alias("four"), sc.dotted_bytes(F.col("t")).alias("dot"),
        sc.parse_uint32(F.lit("0xFf"), 16).alias("h"), sc.parse_uint32(F.lit("12x"), 10).alias("bad"), sc.parse_uint32(F.lit("77"), 10).alias("d"),
        sc.signed_value(F.lit(3), F.lit(3)).alias("neg"), sc.signed_value(F.lit(5), F.lit(3)).alias("pos"), sc.scale_precision(F.lit(-100), F.lit(12)).alias("p"),
        sc.save_quality(F.lit(0xFFFD)).alias("q1"), sc.save_quality(F.lit(8)).alias("q12"), sc.save_quality(F.lit(9)).alias("q0"),
        sc.unpack_bit(sc.pack_offset(F.lit(1 << 40), F.lit(5))).alias("bit"), sc.unpack_byte(sc.pack_offset(F.lit(1 << 40), F.lit(5))).alias("byte"),
        sc.float32(F.lit(0x3FC00000).cast("bigint")).alias("f"), sc.float64(F.lit(0xC0020000).cast("bigint"), F.lit(0).cast("bigint")).alias("g"),
        sc.url_escape(F.lit("a b/{x}~")).alias("u"), sc.url_unescape(sc.url_escape(F.lit("a+b é/{x}~"))).alias("w"),
    ).collect()[0]
    assert r.bin == "10101011 11001101" and r.four == "'ab.c' (0x61620063)" and r.dot == "'97.98.0.99' (0x61620063)"
    assert (r.h, r.bad, r.d, r.neg, r.pos, r.p) == (255, None, 77, -4, 5, -6)
    assert (r.q1, r.q12, r.q0, r.bit, r.byte, r.f, r.g) == (1, 12, 0, 5, 1 << 40, 1.5, -2.25)
    assert r.u == "a%20b%2F{x%7D%7E" and r.w == "a+b é/{x}~"


def test_reads_at_the_end_of_the_data(spark):
    r = one(spark, z=0).select(
        sc.read_uint(F.unhex(F.lit("00010203")), 2, 2).alias("last"), sc.read_uint(F.unhex(F.lit("00010203")), 3, 2).alias("past"),
        sc.read_uint(F.unhex(F.lit("01020304")), 0, 4, True).alias("le"), sc.read_int16(F.unhex(F.lit("fffe")), 0).alias("i16")).collect()[0]
    assert (r.last, r.past, r.le, r.i16) == (0x0203, None, 0x04030201, -2)


def test_transform_bears_null_and_short_blocks(spark):
    whole = [float(i) for i in range(64)]
    df = spark.createDataFrame([(1, whole), (2, None), (3, whole[:5]), (4, whole[:63] + [None]), (5, whole)], "id INT, q ARRAY<DOUBLE>")
    got = {r.id: r.v for r in df.select("id", blk.idct_ac("q").alias("v")).collect()}
    assert got[2] is None and got[3] is None and got[4] is None and got[1] == got[5] and len(got[1]) == 64


def test_pixel_expansion_runs_python_once(spark):
    df = spark.createDataFrame([(1, [1.0] * 64, 3)], "id INT, coef ARRAY<DOUBLE>, dc INT")
    plan = blk.expand_pixels(df, blk.idct_ac("coef"), "dc", F.lit(1), F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
