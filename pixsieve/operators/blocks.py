"""Block and pixel algebra on 8x8 blocks kept as arrays of 64, plus table checks and geometry.

A block stays one row until an aggregate needs pixels, so nothing here shuffles 64 rows per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixsieve.sources.dims import (
    ROTATE,
    STD_QUANT_LUMA,
    UNZIGZAG,
    ZIGZAG,
    idct_weights,
    int_array,
)

# Limits of the table stores.
MAX_DQT_DEST, MAX_DQT_COEFF, MAX_COMP, MAX_DHT_CLASS, MAX_DHT_CODES, MAX_SAMPLING = 4, 64, 256, 2, 260, 4
# Luma weights, and the same weights scaled to 10 bits.
RED, GREEN, BLUE = 0.299, 0.587, 0.114
FIX_RED, FIX_GREEN, FIX_BLUE = 306, 601, 116
# Clip bits per channel, under and over the valid range.
CLIP_BITS = {
    "y": (0x80000000, 0x00800000),
    "cb": (0x40000000, 0x00400000),
    "cr": (0x20000000, 0x00200000),
    "r": (0x00008000, 0x00000080),
    "g": (0x00004000, 0x00000040),
    "b": (0x00002000, 0x00000020),
}


# --- reordering and signatures -------------------------------------------------------------------

def permute(values: Column, order) -> Column:
    """Array whose element i is values[order[i]]; plain element reads, so that they are compiled."""
    return F.array(*[F.get(values, F.lit(int(i))) for i in order])


def to_normal_order(table_zz: Column) -> Column:
    return permute(table_zz, UNZIGZAG)


def to_zigzag_order(table: Column) -> Column:
    return permute(table, ZIGZAG)


def rotate_table(table_zz: Column) -> Column:
    """The table of the same image turned by 90 degrees, zigzag order in and out."""
    return permute(table_zz, [UNZIGZAG[ROTATE[p]] for p in ZIGZAG])


def table_signature(table_zz: Column) -> Column:
    """Upper-case MD5 over the comma-separated table values."""
    return F.upper(F.md5(F.concat_ws(",", table_zz.cast("array<string>"))))


def compression_signature(tables: DataFrame) -> DataFrame:
    """MD5 over all tables of an image (dest_id order) and its subsampling, plain and rotated.

    tables: image_id, dest_id, table_zz, subsampling. An image has at most four tables.
    """
    text = F.concat_ws(",", F.col("table_zz").cast("array<string>"))
    turned = F.concat_ws(",", rotate_table(F.col("table_zz")).cast("array<string>"))
    per_dest = tables.select("image_id", "dest_id", "subsampling", text.alias("plain"), turned.alias("turned"))
    slots = [
        F.max(F.when(F.col("dest_id") == d, F.col(c))).alias(f"{c}{d}") for c in ("plain", "turned") for d in range(MAX_DQT_DEST)
    ]
    wide = per_dest.groupBy("image_id").agg(F.max("subsampling").alias("subsampling"), *slots)

    def digest(kind: str) -> Column:
        return F.upper(F.md5(F.concat_ws(";", F.col("subsampling"), *[F.col(f"{kind}{d}") for d in range(MAX_DQT_DEST)])))

    return wide.select("image_id", digest("plain").alias("csig"), digest("turned").alias("csig_rot"))


# --- coefficients --------------------------------------------------------------------------------

def wrap16(v: Column) -> Column:
    """Two's complement wrap to 16 bits, kept as INT."""
    return (F.pmod(v.cast("bigint") + 32768, F.lit(65536)) - 32768).cast("int")


def dequantise(coeffs: DataFrame, tables: DataFrame) -> DataFrame:
    """Multiply zigzag coefficients with the image's table; result in row order, 16-bit wrapped.

    coeffs: image_id, ..., q (at most 64 values); tables: image_id, table_zz.
    """
    joined = coeffs.join(tables, "image_id")
    product = F.zip_with(F.slice("q", 1, 64), "table_zz", lambda a, b: wrap16(F.coalesce(a, F.lit(0)).cast("bigint") * b))
    return joined.withColumn("__p", product).withColumn("coef", permute(F.col("__p"), UNZIGZAG)).drop("q", "table_zz", "__p")


_WEIGHTS = np.array(idct_weights())


def _per_block(coef: pa.Array, kind, transform) -> pa.Array:
    """The transform of all whole blocks of a batch at once; null for null, short and long arrays and arrays with nulls."""
    size = pc.fill_null(pc.list_value_length(coef), 0).to_numpy(zero_copy_only=False)
    whole = size == 64
    if coef.flatten().null_count:
        whole &= np.array([v is not None and None not in v for v in coef.to_pylist()], bool)
    blocks = coef if whole.all() else coef.filter(pa.array(whole))
    out = transform(blocks.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, 64)).ravel()
    found = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, 64, dtype=np.int32)), pa.array(out))
    return found if whole.all() else found.take(pa.array(np.cumsum(whole) - 1, mask=~whole))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def idct_ac(coef: pa.Array) -> pa.Array:
    """Inverse DCT of 64 row-order coefficients without the constant term, one matrix product per batch."""
    return _per_block(coef, np.float64, lambda flat: flat @ _WEIGHTS.T + 0.0)


_FIXED = np.trunc(_WEIGHTS * 4 * 1024).astype(np.int64)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def idct_ac_fixed(coef: pa.Array) -> pa.Array:
    """The same transform with 10-bit integer weights; the quarter truncates, the final shift floors."""
    def transform(flat: np.ndarray) -> np.ndarray:
        total = flat @ _FIXED.T
        return ((np.sign(total) * (np.abs(total) // 4)) >> 10).astype(np.int32)

    return _per_block(coef, np.int64, transform)


def expand_pixels(df: DataFrame, ac: Column | str, dc: str, rep_h: Column, rep_v: Column) -> DataFrame:
    """Blocks to pixels: trunc(ac * 8) + dc, each value repeated rep_h by rep_v times.

    Adds x, y (inside the expanded block) and value; all other columns are kept but ``ac`` and ``dc``. Give ``ac`` as the
    expression of the transform, so that it feeds the generator and is evaluated once.
    """
    keep = [c for c in df.columns if c not in ((ac, dc) if isinstance(ac, str) else (dc,))]
    cells = df.select(*keep, F.col(dc).alias("__dc"), rep_h.alias("__h"), rep_v.alias("__v"), F.posexplode(ac).alias("__p", "__a"))
    rows = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("__h") * F.col("__v") - 1)).alias("__r"))
    return rows.select(
        *keep,
        ((F.col("__p") % 8) * F.col("__h") + F.col("__r") % F.col("__h")).cast("int").alias("x"),
        (F.expr("__p DIV 8") * F.col("__v") + F.expr("__r DIV __h")).cast("int").alias("y"),
        ((F.col("__a") * 8).cast("int") + F.col("__dc")).alias("value"),
    )


# --- colour --------------------------------------------------------------------------------------

def clip(v: Column, lo: int, hi: int) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def shift_range(v: Column) -> Column:
    """Pre-range value (-1024..1023) to the 0..255 scale, floored, not yet clipped."""
    return F.shiftright(v, 3) + 128


def with_colour(df: DataFrame, fixed_point: bool = False) -> DataFrame:
    """Add the colour chain for yv, cb, cr: pre-clip and final YCC, pre-clip and final RGB, clip bits."""
    ycc = df.select("*", *[shift_range(F.col(s)).alias(f"pre_{n}") for s, n in (("yv", "y"), ("cb", "cb"), ("cr", "cr"))])
    fin = ycc.select("*", *[clip(F.col(f"pre_{n}"), 0, 255).alias(f"fin_{n}") for n in ("y", "cb", "cr")])
    y, b, r = F.col("fin_y") - 128, F.col("fin_cb") - 128, F.col("fin_cr") - 128
    if fixed_point:
        rr = 2 * (1024 - FIX_RED) * r.cast("bigint") + 1024 * y
        bb = 2 * (1024 - FIX_BLUE) * b.cast("bigint") + 1024 * y
        raw = fin.select("*", rr.alias("__r"), bb.alias("__b"), y.cast("bigint").alias("__y"))
        green = F.expr(f"(1048576 * __y - {FIX_BLUE} * __b - {FIX_RED} * __r) DIV {FIX_GREEN}")
        pre = raw.select(
            "*",
            *[(F.shiftright(c, 10) + 128).cast("int").alias(f"pre_{n}") for n, c in (("r", F.col("__r")), ("g", green), ("b", F.col("__b")))],
        ).drop("__r", "__b", "__y")
    else:
        rr = r * (2 - 2 * RED) + y
        bb = b * (2 - 2 * BLUE) + y
        raw = fin.select("*", rr.alias("__r"), bb.alias("__b"), y.alias("__y"))
        green = (F.col("__y") - BLUE * F.col("__b") - RED * F.col("__r")) / GREEN
        pre = raw.select(
            "*",
            *[(c + 128).cast("int").alias(f"pre_{n}") for n, c in (("r", F.col("__r")), ("g", green), ("b", F.col("__b")))],
        ).drop("__r", "__b", "__y")
    return pre.select("*", *[clip(F.col(f"pre_{n}"), 0, 255).alias(f"fin_{n}") for n in ("r", "g", "b")])


def clip_mask() -> Column:
    """Bit set of the channels that left 0..255, one bit for under and one for over."""
    mask = F.lit(0).cast("bigint")
    for n, (under, over) in CLIP_BITS.items():
        v = F.col(f"pre_{n}")
        mask = mask.bitwiseOR(F.when(v < 0, F.lit(under)).when(v > 255, F.lit(over)).otherwise(F.lit(0)).cast("bigint"))
    return mask


# Preview mode number to the channels shown as red, green, blue.
PREVIEW_MODES = {
    0: ("r", "g", "b"),
    1: ("r", "g", "b"),
    2: ("cr", "y", "cb"),
    3: ("r", "r", "r"),
    4: ("g", "g", "g"),
    5: ("b", "b", "b"),
    6: ("y", "y", "y"),
    7: ("cb", "cb", "cb"),
    8: ("cr", "cr", "cr"),
}


def channel_extract(df: DataFrame, mode: Column) -> DataFrame:
    """Add out_r, out_g, out_b: the channels that a preview mode shows."""
    def pick(slot: int) -> Column:
        out = F.col(f"fin_{PREVIEW_MODES[0][slot]}")
        for m, chans in PREVIEW_MODES.items():
            if chans[slot] != PREVIEW_MODES[0][slot]:
                out = F.when(mode == m, F.col(f"fin_{chans[slot]}")).otherwise(out)
        return out

    return df.select("*", pick(0).alias("out_r"), pick(1).alias("out_g"), pick(2).alias("out_b"))


def shift_ycc(df: DataFrame, mcu: Column, start: Column, dy: int, dcb: int, dcr: int) -> DataFrame:
    """Add a level offset to every pixel from a linear MCU index on."""
    on = mcu >= start
    return df.withColumns({c: F.col(c) + F.when(on, F.lit(d)).otherwise(F.lit(0)) for c, d in (("yv", dy), ("cb", dcb), ("cr", dcr))})


def swap16(v: Column) -> Column:
    return F.shiftleft(v.bitwiseAND(255), 8) + F.shiftright(v, 8).bitwiseAND(255)


def export_samples(colour: str = "rgb", bits: int = 8) -> list[Column]:
    """The three exported samples e0, e1, e2 of a pixel."""
    if (colour, bits) == ("ycc", 16):
        raise ValueError("16-bit YCC export is not defined")
    if colour == "ycc":
        e = [F.shiftright(clip(F.col(c), -1024, 1023) + 1024, 3) for c in ("yv", "cb", "cr")]
    elif bits == 16:
        e = [swap16(F.shiftleft(F.col(f"fin_{c}"), 8)) for c in ("r", "g", "b")]
    else:
        e = [F.col(f"fin_{c}") for c in ("r", "g", "b")]
    return [c.cast("int").alias(f"e{i}") for i, c in enumerate(e)]


def export_scale(df: DataFrame, colour: str = "rgb", bits: int = 8) -> DataFrame:
    """Add the three exported samples e0, e1, e2 of a pixel."""
    return df.select("*", *export_samples(colour, bits))


def planes_to_rgb(rows: DataFrame) -> DataFrame:
    """Scan lines of channel planes to RGB pixels; channels other than 0, 1, 2 are ignored.

    rows: path, y, chan, samples ARRAY. Lines meet as arrays, so one row per line is shuffled, not one
    per pixel.
    """
    lines = rows.where(F.col("chan").between(0, 2)).groupBy("path", "y").agg(
        *[F.max(F.when(F.col("chan") == c, F.col("samples"))).alias(n) for c, n in ((0, "r"), (1, "g"), (2, "b"))]
    )
    longest = F.greatest(*[F.coalesce(F.size(F.col(n)), F.lit(0)) for n in ("r", "g", "b")])
    cells = F.transform(
        F.sequence(F.lit(0), longest - 1),
        lambda x: F.struct(x.alias("x"), F.get("r", x).alias("r"), F.get("g", x).alias("g"), F.get("b", x).alias("b")),
    )
    return lines.where(longest > 0).select("path", "y", F.inline(cells))


# --- table checks --------------------------------------------------------------------------------

def bounds_reason(dest: Column, coeff: Column, comp: Column, scan_comp: Column, cls: Column, code: Column) -> Column:
    """First index that is out of range, null when all fit."""
    return (
        F.when((dest < 0) | (dest >= MAX_DQT_DEST), "dest")
        .when((coeff < 0) | (coeff >= MAX_DQT_COEFF), "coeff")
        .when((comp < 0) | (comp >= MAX_COMP), "comp")
        .when((scan_comp < 1) | (scan_comp > 4), "scan_comp")
        .when((cls < 0) | (cls >= MAX_DHT_CLASS), "class")
        .when((code < 0) | (code >= MAX_DHT_CODES), "code")
    )


def validate_value(v: Column, lo: int, hi: int, override: Column, substitute: int) -> Column:
    """The value when in range, a substitute when out of range and overriding, else null."""
    return F.when(v.between(lo, hi), v).when(override, F.lit(substitute))


def support_reason(ncomp: Column, h: Column, v: Column, blocks: Column) -> Column:
    """Why a scan cannot be decoded, null when it can."""
    return (
        F.when(~ncomp.isin(1, 3), "components")
        .when(~h.between(1, MAX_SAMPLING) | ~v.between(1, MAX_SAMPLING), "sampling")
        .when(blocks == 0, "empty")
    )


def bind_tables(selectors: DataFrame, dqt: DataFrame, dht: DataFrame) -> DataFrame:
    """Readiness per image: every component has its quantisation table and both Huffman tables.

    selectors: path, comp, tq, td, ta (null = unset); dqt: path, dest_id, n; dht: path, class, dest_id, n.
    Tables of zero entries count as missing.
    """
    q = dqt.where("n > 0").select("path", F.col("dest_id").alias("tq"), F.lit(True).alias("has_q"))
    h = dht.where("n > 0")
    dc = h.where("class = 0").select("path", F.col("dest_id").alias("td"), F.lit(True).alias("has_dc"))
    ac = h.where("class = 1").select("path", F.col("dest_id").alias("ta"), F.lit(True).alias("has_ac"))
    bound = selectors.join(q, ["path", "tq"], "left").join(dc, ["path", "td"], "left").join(ac, ["path", "ta"], "left")
    return bound.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_comp"),
        F.count_if(F.col("has_q").isNull()).alias("no_dqt"),
        F.count_if(F.col("has_dc").isNull()).alias("no_dc"),
        F.count_if(F.col("has_ac").isNull()).alias("no_ac"),
        F.bool_and(F.col("has_q").isNotNull() & F.col("has_dc").isNotNull() & F.col("has_ac").isNotNull()).alias("ready"),
    )


def table_flags(df: DataFrame, table: str) -> DataFrame:
    """Add all_same (constant table) and baseline (all values fit a byte)."""
    lo, hi = F.array_min(table), F.array_max(table)
    return df.select("*", (lo == hi).alias("all_same"), (hi <= 255).alias("baseline"))


def table_quality(table: Column, standard=STD_QUANT_LUMA) -> Column:
    """Quality 0..100 of a row-order table from its mean scale against a standard table."""
    std = int_array(standard)
    ratio = F.zip_with(table, std, lambda a, s: F.lit(100.0) * a / s)
    scale = F.aggregate(ratio, F.lit(0.0), lambda acc, x: acc + x) / 64
    return F.when(scale <= 100, (F.lit(200.0) - scale) / 2).otherwise(F.lit(5000.0) / scale)


# --- geometry ------------------------------------------------------------------------------------

def mcu_geometry(comps: DataFrame) -> DataFrame:
    """MCU and block grid per image from one row per scan component (path, width, height, hmax, vmax).

    A single-component scan has its sampling factors forced to 1.
    """
    per = comps.groupBy("path").agg(
        F.count(F.lit(1)).alias("ncomp"),
        F.max("width").alias("width"),
        F.max("height").alias("height"),
        F.max("hmax").alias("h_hi"),
        F.max("vmax").alias("v_hi"),
        F.min("hmax").alias("h_lo"),
        F.min("vmax").alias("v_lo"),
    )
    one = F.col("ncomp") == 1
    per = per.withColumns({c: F.when(one, F.lit(1)).otherwise(F.col(c)) for c in ("h_hi", "v_hi", "h_lo", "v_lo")})
    per = per.withColumns({"mcu_w": F.col("h_hi") * 8, "mcu_h": F.col("v_hi") * 8})
    per = per.withColumns({
        "mcu_x": F.expr("CAST((width + mcu_w - 1) DIV mcu_w AS INT)"),
        "mcu_y": F.expr("CAST((height + mcu_h - 1) DIV mcu_h AS INT)"),
    })
    return per.select(
        "path", "ncomp", "h_hi", "v_hi", "h_lo", "v_lo", "mcu_w", "mcu_h", "mcu_x", "mcu_y",
        (F.col("mcu_x") * F.col("h_hi")).alias("blk_x"),
        (F.col("mcu_y") * F.col("v_hi")).alias("blk_y"),
        (F.col("mcu_x") * F.col("mcu_w")).alias("padded_w"),
        (F.col("mcu_y") * F.col("mcu_h")).alias("padded_h"),
    )


def frame_flags(df: DataFrame) -> DataFrame:
    """Add landscape (yes/no) and the subsampling text."""
    return df.select(
        "*",
        F.when(F.col("width") > F.col("height"), "yes").otherwise("no").alias("landscape"),
        F.format_string("%dx%d", "hmax", "vmax").alias("subsampling"),
    )
