"""Running decoder state as prefix aggregates over ordered rows.

Every operator orders by an integer that is unique per path and uses ``running``, so one path with
most of the rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixsieve.running import SPAN, row_index, running, segmented


def flag(c: Column) -> Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def restart_segments(codes: DataFrame, span: int | None = SPAN) -> DataFrame:
    """Add rst_seg: how many restarts a path has seen up to and with this row."""
    return running(codes, ["path"], "seq", {"rst_seg": ("sum", flag(F.col("is_rst")))}, span=span)


def dc_values(codes: DataFrame, span: int | None = SPAN) -> DataFrame:
    """Add rst_seg, dc (running sum of the DC deltas per component, starting again at each restart) and
    comp_block (place of the block among those of its component)."""
    return segmented(
        codes, ["path"], "seq", F.col("is_rst"), {"dc": ("sum", F.col("delta").cast("bigint"))},
        whole={"comp_block": ("sum", F.lit(1).cast("bigint"))}, seg="rst_seg", within="comp", span=span,
    ).withColumn("comp_block", F.col("comp_block") - 1)


def restart_check(codes: DataFrame, span: int | None = SPAN) -> DataFrame:
    """Expected against seen restart index; the next expectation follows the seen one."""
    marks = codes.where("is_rst").select("path", "seq", "rst")
    # the latest mark before a row, packed into one number so that the totals stay a hash aggregate
    seen = running(marks, ["path"], "seq", {"__prev": ("max", F.col("seq") * 8 + F.col("rst"))}, inclusive=False, span=span)
    expected = F.coalesce((F.pmod(F.col("__prev"), F.lit(8)).cast("int") + 1) % 8, F.lit(0))
    return seen.select("path", "seq", "rst", expected.alias("expected"), (expected != F.col("rst")).alias("mismatch"))


def restart_overruns(codes: DataFrame, interval: int, span: int | None = SPAN) -> DataFrame:
    """The first unit of each segment that should have been preceded by a restart; one row per segment."""
    at = segmented(codes, ["path"], "seq", F.col("is_rst"), {"unit": ("sum", F.lit(1).cast("bigint"))}, seg="rst_seg", inclusive=False, span=span)
    return at.where(F.col("unit") == interval).select("path", "seq", "rst_seg")


def first_n(codes: DataFrame, limits: dict[str, int]) -> DataFrame:
    """At most the first n rows of each severity per path; the nth carries a marker.

    Rows are limited inside each map task before the shuffle (a literal rank bound), then globally.
    """
    per = W.partitionBy("path", "severity").orderBy("seq")
    ranked = codes.where(F.col("severity").isin(list(limits))).select(
        "path", "severity", "seq", F.row_number().over(per).alias("rn")
    ).where(F.col("rn") <= max(limits.values()))
    limit = F.lit(None).cast("int")
    for name, n in limits.items():
        limit = F.when(F.col("severity") == name, F.lit(n)).otherwise(limit)
    kept = ranked.withColumn("__n", limit).where("rn <= __n")
    return kept.select("path", "severity", "seq", "rn", (F.col("rn") == F.col("__n")).alias("last_reported"))


def report_cap(lines: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` lines of each path; the line after them becomes a notice, the rest go.

    The rank has a literal bound, so each map task sends that many lines of a path at most.
    """
    rank = F.row_number().over(W.partitionBy("path").orderBy("seq"))
    at = lines.withColumn("__i", rank).where(F.col("__i") <= cap + 1)
    notice = F.col("__i") == cap + 1
    return at.select(
        "path", "seq", F.col("__i").cast("bigint").alias("line_no"),
        F.when(notice, "error").otherwise(F.col("severity")).alias("severity"),
        F.when(notice, F.lit("report truncated")).otherwise(F.col("text")).alias("text"),
    )


def last_n(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows per path, newest first; ranks are bounded before the shuffle."""
    per = W.partitionBy("path").orderBy(F.col("seq").desc())
    return rows.select("*", F.row_number().over(per).alias("age")).where(F.col("age") <= n)


def padded(length: Column, to: int) -> Column:
    """Length rounded up to a multiple."""
    return length + F.pmod(-length, F.lit(to))


def record_offsets(records: DataFrame, header: int, pads: dict[str, int], span: int | None = SPAN) -> DataFrame:
    """Start offsets of a chain of length-prefixed records, one column per padding rule."""
    aggs = {n: ("sum", padded(F.col("rec_len").cast("bigint") + header, p)) for n, p in pads.items()}
    return running(records, ["path"], "seq", aggs, inclusive=False, span=span)


def record_audit(records: DataFrame, span: int | None = SPAN) -> DataFrame:
    """Declared against consumed length; the first bad record is reported and ends its path.

    Consuming too much is an error (the reader rolls back to the declared end), too little a warning.
    """
    diff = F.col("consumed") - F.col("declared")
    bad = running(records, ["path"], "seq", {"__bad": ("min", F.when(diff != 0, F.col("seq")))}, span=span)
    kept = bad.where(F.col("__bad").isNull() | (F.col("seq") == F.col("__bad")))
    return kept.select(
        "path", "seq", "declared", "consumed",
        F.when(diff > 0, "error").when(diff < 0, "warn").otherwise("ok").alias("status"),
    )


def cut_after_bad(records: DataFrame, is_bad: Column, span: int | None = SPAN) -> DataFrame:
    """Rows of each path before its first bad row."""
    bad = running(records, ["path"], "seq", {"__bad": ("min", F.when(is_bad, F.col("seq")))}, span=span)
    return bad.where(F.col("__bad").isNull()).drop("__bad")


def bit_positions(codes: DataFrame, span: int | None = SPAN) -> DataFrame:
    """Start of every code in the scan: whole bytes, bits within the byte, and the position text."""
    used = (F.col("bits1") + F.col("bits2")).cast("bigint")
    at = running(codes, ["path"], "seq", {"__bit": ("sum", used)}, inclusive=False, span=span)
    at = at.select("*", F.expr("__bit DIV 8").alias("byte"), (F.col("__bit") % 8).cast("int").alias("bit")).drop("__bit")
    return at.withColumn("pos_text", F.format_string("0x%08X.%d", "byte", "bit"))


def coefficient_index(codes: DataFrame, block: list[str], is_eob: Column, reset: Column | None = None, span: int | None = SPAN) -> DataFrame:
    """Coefficient index after each code of a block; a block ends at its EOB or at index 64.

    Blocks are told apart by the ``block`` columns, or begin at each ``reset`` row (then numbered as
    rst_seg). An index beyond 64 is an error and is clamped; codes after the end of a block are dropped.
    """
    step = (F.col("zrl") + 1).cast("bigint")
    aggs = {
        "__before": ("sum", F.when(F.col("__eob"), F.lit(0).cast("bigint")).otherwise(step)),
        "__ends": ("sum", flag(F.col("__eob"))),
    }
    marked = codes.withColumn("__eob", is_eob)
    if reset is None:
        at, ids = running(marked, block, "seq", aggs, inclusive=False, span=span), block
    else:
        at, ids = segmented(marked, block, "seq", reset, aggs, seg="rst_seg", inclusive=False, span=span), [*block, "rst_seg"]
    live = at.where((F.col("__before") < 64) & (F.col("__ends") == 0))
    after = F.when(F.col("__eob"), F.col("__before")).otherwise(F.col("__before") + step)
    return live.select(
        *ids, "seq",
        F.least(after, F.lit(64)).alias("coef_idx"),
        F.when(F.col("__eob"), "eob").when(after > 64, "overrun").when(after == 64, "full").otherwise("open").alias("status"),
    )


def block_dc_map(dc: DataFrame, blocks_per_row: int) -> DataFrame:
    """Per-component DC values on the block grid: the nth block of each component is the nth cell."""
    grid = dc.groupBy("path", "comp_block").agg(
        *[F.max(F.when(F.col("comp") == c, F.col("dc"))).alias(n) for c, n in ((1, "y"), (2, "cb"), (3, "cr"))]
    )
    return grid.select(
        "path", (F.col("comp_block") % blocks_per_row).alias("bx"), F.expr(f"comp_block DIV {blocks_per_row}").alias("by"),
        *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("y", "cb", "cr")],
    )


def look_up_blocks(points: DataFrame, grid: DataFrame, on: list[str]) -> DataFrame:
    """Points with the DC values (y, cb, cr) of their cell on the grid of ``block_dc_map``; outside the image y is null."""
    found = points.join(grid.select(*on, "y", "cb", "cr"), on, "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("cb", "cr")})


def mcu_map(codes: DataFrame, mcus_per_row: int, span: int | None = SPAN) -> DataFrame:
    """File position (byte, bit) of every MCU, one code per MCU."""
    used = (F.col("bits1") + F.col("bits2")).cast("bigint")
    at = running(codes, ["path"], "seq", {"__bit": ("sum", used), "mcu": ("sum", F.lit(1).cast("bigint"))}, inclusive=False, span=span)
    return at.select(
        "path", (F.col("mcu") % mcus_per_row).alias("mcu_x"), F.expr(f"mcu DIV {mcus_per_row}").alias("mcu_y"),
        F.expr("__bit DIV 8").alias("byte"), (F.col("__bit") % 8).cast("int").alias("bit"),
    )


def look_up_positions(points: DataFrame, mcus: DataFrame, mcu_w: int, mcu_h: int) -> DataFrame:
    """Pixel coordinates to the file position of their MCU; null outside the image."""
    keyed = points.select(
        "*", F.expr(f"CAST(px DIV {mcu_w} AS BIGINT)").alias("mcu_x"), F.expr(f"CAST(py DIV {mcu_h} AS BIGINT)").alias("mcu_y")
    )
    return keyed.join(mcus, ["path", "mcu_x", "mcu_y"], "left")


def mcu_range(mcus: DataFrame, marks: DataFrame, order: str = "idx", span: int = SPAN) -> DataFrame:
    """Rows whose place (``order``, not negative) lies between two marked ones (path, a, b), whichever was marked first.

    Both sides are cut to spans of places, so a path with most rows meets its marks in as many tasks as it has spans: in
    the spans at a range's ends the place decides, those between are whole. A row in two marked ranges comes twice.
    """
    ends = marks.select("path", F.least("a", "b").cast("bigint").alias("__lo"), F.greatest("a", "b").cast("bigint").alias("__hi")).where("__hi >= 0")
    low, high = F.floor(F.greatest("__lo", F.lit(0)) / span), F.floor(F.col("__hi") / span)
    held = ends.select("path", "__lo", "__hi", F.explode(F.sequence(low, high)).alias("__span"))
    inner = (F.col("__span") * span >= F.col("__lo")) & ((F.col("__span") + 1) * span - 1 <= F.col("__hi"))
    cut = mcus.withColumn("__span", F.floor(F.col(order) / span)).join(held.withColumn("__whole", inner), ["path", "__span"])
    return cut.where(F.col("__whole") | F.col(order).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi", "__span", "__whole")


def huffman_codes(lengths: DataFrame, span: int | None = SPAN) -> DataFrame:
    """Canonical codes of a table: left-justified 16-bit code and mask from (path, seq, bitlen, value).

    Codes run by length, then by listing order. A list that needs more than the whole code space is
    not a valid table from that point on.
    """
    keyed = lengths.withColumn("__ord", F.col("bitlen").cast("bigint") * F.lit(1 << 44) + F.col("seq"))
    width = F.expr("shiftleft(CAST(1 AS BIGINT), 16 - bitlen)")
    at = running(keyed, ["path"], "__ord", {"bits": ("sum", width)}, inclusive=False, span=span)
    return at.select(
        "path", "seq", "bitlen", "value", "bits",
        (F.lit(65536) - width).alias("mask"),
        (F.col("bits") + width <= 65536).alias("valid"),
    )


def huffman_prefixes(codes: DataFrame, fast_bits: int = 9) -> DataFrame:
    """All ``fast_bits``-wide prefixes that a short valid code answers."""
    short = codes.where(F.col("valid") & (F.col("bitlen") <= fast_bits))
    first = F.shiftright("bits", 16 - fast_bits)
    count = F.expr(f"shiftleft(CAST(1 AS BIGINT), {fast_bits} - bitlen)")
    return short.select("path", "seq", "bitlen", "value", F.explode(F.sequence(first, first + count - 1)).alias("prefix"))


def expand_runs(runs: DataFrame, row: list[str], reset: Column | None = None, span: int | None = SPAN) -> DataFrame:
    """Run-length rows to samples: n < 0 repeats its value 1 - n times, n >= 0 copies 1 + n samples.

    Image rows are told apart by the ``row`` columns, or begin at each ``reset`` (then numbered rst_seg).
    """
    size = F.when(F.col("run") < 0, 1 - F.col("run")).otherwise(1 + F.col("run")).cast("bigint")
    sized, aggs = runs.withColumn("__n", size), {"__x": ("sum", F.col("__n"))}
    if reset is None:
        at, ids = running(sized, row, "seq", aggs, inclusive=False, span=span), row
    else:
        at, ids = segmented(sized, row, "seq", reset, aggs, seg="rst_seg", inclusive=False, span=span), [*row, "rst_seg"]
    return at.select(*ids, F.explode(F.sequence(F.col("__x"), F.col("__x") + F.col("__n") - 1)).alias("x"), "val")


def run_widths(runs: DataFrame, row: list[str], width: int) -> DataFrame:
    """Expanded width of each row against the declared width."""
    size = F.when(F.col("run") < 0, 1 - F.col("run")).otherwise(1 + F.col("run")).cast("bigint")
    return runs.groupBy(*row).agg(F.sum(size).alias("expanded")).select(*row, "expanded", (F.col("expanded") == width).alias("ok"))


def encapsulated_items(elements: DataFrame, span: int | None = SPAN) -> DataFrame:
    """Add is_offset_table and is_jpeg to elements (path, seq, kind, ...; kind start | item | end | other).

    Encapsulation runs from a start element to the next end; a start inside it changes nothing. Its
    first item is the offset table, all later ones hold images.
    """
    kind = F.col("kind")
    opened = segmented(elements, ["path"], "seq", kind == "end", {"__open": ("min", F.when(kind == "start", F.col("seq")))}, seg="__run", span=span)
    inside = F.col("__open").isNotNull() & (F.col("seq") > F.col("__open"))
    marked = opened.withColumn("__item", inside & (kind == "item"))
    ranked = running(marked, ["path", "__run"], "seq", {"__no": ("sum", flag(F.col("__item")))}, span=span)
    return ranked.select(
        *elements.columns,
        (F.col("__item") & (F.col("__no") == 1)).alias("is_offset_table"),
        (F.col("__item") & (F.col("__no") > 1)).alias("is_jpeg"),
    )
