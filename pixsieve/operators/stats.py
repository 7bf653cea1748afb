"""Per-image statistics. All are plain aggregates, combined map-side, so a hot image costs nothing extra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixsieve.operators.blocks import clip, with_colour

STAGES = (
    ("prerange", "y", "yv"), ("prerange", "cb", "cb"), ("prerange", "cr", "cr"),
    ("preclip", "y", "pre_y"), ("preclip", "cb", "pre_cb"), ("preclip", "cr", "pre_cr"),
    ("preclip", "r", "pre_r"), ("preclip", "g", "pre_g"), ("preclip", "b", "pre_b"),
    ("final", "r", "fin_r"), ("final", "g", "fin_g"), ("final", "b", "fin_b"),
)
Y_BINS, RGB_BINS, SUBSET_BINS, BAR_HEIGHT = 2048, 128, 512, 30


def compression(df: DataFrame) -> DataFrame:
    """Ratio and bits per pixel from path, width, height, ncomp, first_byte, last_byte rows of a scan.

    A path may have several rows (restarts): the first offset and the last one count.
    """
    per = df.groupBy("path").agg(
        F.max("width").cast("bigint").alias("w"),
        F.max("height").cast("bigint").alias("h"),
        F.max("ncomp").cast("bigint").alias("nc"),
        (F.max("last_byte") - F.min("first_byte")).alias("scan_bytes"),
    )
    return per.select(
        "path",
        "scan_bytes",
        F.try_divide(F.col("w") * F.col("h") * F.col("nc"), F.col("scan_bytes")).alias("ratio"),
        F.try_divide(F.col("scan_bytes") * 8, F.col("w") * F.col("h")).alias("bits_per_pixel"),
    )


def code_lengths(df: DataFrame) -> DataFrame:
    """Histogram of code lengths 1..16 per path, class, dest_id, with empty bins and percentages."""
    per = df.groupBy("path", "class", "dest_id").agg(
        F.array(*[F.count_if(F.col("bitlen") == n) for n in range(1, 17)]).alias("bins"),
        F.count_if(F.col("bitlen").between(1, 16)).alias("total"),
    )
    rows = per.select("path", "class", "dest_id", "total", F.posexplode("bins").alias("i", "n"))
    return rows.select(
        "path", "class", "dest_id", (F.col("i") + 1).alias("bitlen"), "n",
        F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("total")), F.lit(0.0)).alias("pct"),
    )


def color_stats(df: DataFrame) -> DataFrame:
    """min, max and mean of twelve values per image (before range, before clip, final)."""
    aggs = []
    for i, (_, _, c) in enumerate(STAGES):
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.avg(c).alias(f"av{i}")]
    per = df.groupBy("image_id").agg(*aggs)
    body = ", ".join(f"'{s}', '{n}', lo{i}, hi{i}, av{i}" for i, (s, n, _) in enumerate(STAGES))
    return per.select("image_id", F.expr(f"stack({len(STAGES)}, {body}) AS (stage, channel, lo, hi, mean)"))


def clip_counts(df: DataFrame) -> DataFrame:
    """Pixels under and over the range per channel, and the OR of all clip bits."""
    aggs = []
    for n in ("y", "cb", "cr", "r", "g", "b"):
        aggs += [F.count_if(F.col(f"pre_{n}") < 0).alias(f"{n}_under"), F.count_if(F.col(f"pre_{n}") > 255).alias(f"{n}_over")]
    return df.groupBy("image_id").agg(*aggs, F.bit_or("clip_mask").alias("mask"))


def rgb_histogram(df: DataFrame) -> DataFrame:
    """128 bins of width 2 per channel."""
    width = 256 // RGB_BINS
    per = df.select(
        "image_id",
        F.expr(f"stack(3, 'r', fin_r DIV {width}, 'g', fin_g DIV {width}, 'b', fin_b DIV {width}) AS (channel, bin)"),
    )
    return per.groupBy("image_id", "channel", "bin").agg(F.count(F.lit(1)).alias("n"))


def y_histogram(df: DataFrame) -> DataFrame:
    """2048 bins over the clamped pre-range luminance."""
    b = (clip(F.col("yv"), -1024, 1023) + 1024).alias("bin")
    return df.select("image_id", b).groupBy("image_id", "bin").agg(F.count(F.lit(1)).alias("n"))


def y_histogram_rows(df: DataFrame) -> DataFrame:
    """The luminance histogram as report rows of eight bins; empty rows included.

    An image has at most 2048 bins, so they may meet in one map.
    """
    per = y_histogram(df).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    rows = per.select("image_id", "m", F.explode(F.sequence(F.lit(0), F.lit(Y_BINS // 8 - 1))).alias("row_no"))
    eight = F.array(*[F.coalesce(F.try_element_at("m", F.col("row_no") * 8 + i), F.lit(0)).cast("string") for i in range(8)])
    return rows.select("image_id", "row_no", F.array_join(eight, " ").alias("counts"))


def histogram_bars(df: DataFrame) -> DataFrame:
    """Bar heights 0..30: luminance in 512 bins with its own peak, RGB with one peak for all channels."""
    step, width = Y_BINS // SUBSET_BINS, 256 // RGB_BINS
    y = (clip(F.col("yv"), -1024, 1023) + 1024).alias("__y")
    cells = df.select("image_id", y, "fin_r", "fin_g", "fin_b").select("image_id", F.expr(
        f"stack(4, 'y', __y DIV {step}, 'r', fin_r DIV {width}, 'g', fin_g DIV {width}, 'b', fin_b DIV {width}) AS (channel, bin)"))
    bins = cells.groupBy("image_id", "channel", "bin").agg(F.count(F.lit(1)).alias("n"))
    group = W.partitionBy("image_id", F.col("channel") == "y")
    peaks = bins.withColumn("peak", F.greatest(F.max("n").over(group), F.lit(1)))
    return peaks.select("image_id", "channel", "bin", "n", F.expr(f"{BAR_HEIGHT} * n DIV peak").alias("height"))


def brightest(blocks: DataFrame) -> DataFrame:
    """First pixel in raster order (block, index) with the highest pre-range luminance, and its colour.

    blocks: image_id, block_id, cells ARRAY of (idx, yv, cb, cr). Each block names its own brightest
    pixel before anything is grouped, and colour is computed for the winners only.
    """
    keyed = F.transform("cells", lambda c: F.struct(c["yv"].alias("yv"), (-c["idx"]).alias("back"), c["cb"].alias("cb"), c["cr"].alias("cr")))
    best = blocks.select("image_id", "block_id", F.array_max(keyed).alias("c"))
    top = best.groupBy("image_id").agg(F.max(F.struct(F.col("c.yv").alias("yv"), (-F.col("block_id")).alias("bback"), F.col("c.back").alias("back"), F.col("c.cb").alias("cb"), F.col("c.cr").alias("cr"))).alias("t"))
    px = top.select("image_id", (-F.col("t.bback")).alias("block_id"), (-F.col("t.back")).alias("idx"), "t.yv", "t.cb", "t.cr")
    return with_colour(px).select("image_id", "block_id", "idx", "yv", "cb", "cr", "fin_r", "fin_g", "fin_b")


def mean_luminance(df: DataFrame) -> DataFrame:
    """Average final luminance, integer division."""
    return df.groupBy("image_id").agg(
        F.sum("fin_y").alias("s"), F.count(F.lit(1)).alias("n")
    ).select("image_id", F.expr("s DIV n").alias("avg_luma"))


def restart_counts(codes: DataFrame) -> DataFrame:
    return codes.groupBy("path").agg(F.count_if(F.col("is_rst")).alias("n_rst"))
