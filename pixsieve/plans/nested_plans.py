"""Queries over packed files whose records nest or come in pieces: movies, sequences in elements, profiles in chunks, damaged tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixsieve.operators import carving as cv
from pixsieve.operators import extract as ex
from pixsieve.operators import walks
from pixsieve.plans import byte_plans, camera_plans, extract_plans, packed
from pixsieve.plans import inputs as inp
from pixsieve.plans.packed import be, hx, ordered, sealed, text
from pixsieve.sources import dims

SCAN = "FFDA0008010100003F00"
#: Entries of a block of tags that all claim endless values.
TAGS = 40


def le(v, width: int = 4) -> Column:
    return F.hex(ordered(v, width, F.lit(True)))


# --- movies --------------------------------------------------------------------------------------

def movie_files(spark, sf_dir: str) -> DataFrame:
    """Parts as movies of one to four frames, sound between them, some frames without tables.

    The index lacks the last frame of every seventh and names one that is not there in every eleventh.
    """
    p = inp.spread(spark, sf_dir, "part").withColumns({"k": F.col("p_partkey"), "n": (F.col("p_partkey") % 4 + 1).cast("int")})
    numbers = F.sequence(F.lit(0), F.col("n") - 1)

    def frame(j):
        tables = F.when((F.col("k") + j) % 3 > 0, camera_plans.DHT).otherwise("")
        return F.concat(F.lit("FFD8"), tables, F.lit(SCAN), F.lpad(F.hex((F.col("k") + j) % 250), 2, "0"), F.lit("FF00FFD9"))

    p = p.select("*", sealed(F.transform(numbers, frame), "frames"))
    size = lambda f: (F.length(f) / 2).cast("int")
    chunks = F.transform("frames", lambda f: F.concat(F.lit("3031776203000000AAAAAA00" + "30306463"), le(size(f)), f, F.lit("00")))
    before = F.transform(numbers, lambda j: F.aggregate(F.slice("frames", F.lit(1), j), F.lit(16), lambda acc, f: acc + 21 + size(f)))
    entries = F.transform(numbers, lambda j: F.when((F.col("k") % 7 > 0) | (j < F.col("n") - 1), F.concat(
        F.lit("30306463"), F.when(j == 0, "10000000").otherwise("00000000"), le(F.get(F.col("before"), j)), le(size(F.get("frames", j))))))
    stray = F.when(F.col("k") % 11 == 0, "30306463000000000900000001000000").otherwise("")
    p = p.select("k", "frames", "n", sealed(before, "before"), sealed(F.array_join(chunks, ""), "chunks"))
    p = p.select("k", "chunks", sealed(F.concat(F.array_join(F.array_compact(entries), ""), stray), "index"))
    movie = F.concat(F.lit("4C495354"), le(4 + F.length("chunks") / 2), F.lit("6D6F7669"), "chunks")
    body = F.concat(F.lit("41564920" + "4C495354100000006864726C" + "617669680400000000000000"), movie,
                    F.lit("69647831"), le(F.length("index") / 2), "index")
    p = p.select("k", sealed(body, "body"))
    return p.select(F.col("k").alias("path"), sealed(F.unhex(F.concat(F.lit("52494646"), le(F.length("body") / 2), "body")), "content"))


def avi_tables(spark, d):
    """The frames of movies, those without tables with a standard segment before their scan."""
    out = cv.insert_tables(ex.avi_frames(movie_files(spark, d)), byte_plans.SEGMENT)
    return out.select("path", "frame_no", "stream", "pos", "indexed", "key", "has_tables", F.length("frame").alias("size"), F.md5("frame").alias("md5"))


def avi_index(spark, d):
    return ex.avi_index_audit(movie_files(spark, d))


# --- sequences -----------------------------------------------------------------------------------

def nested_files(spark, sf_dir: str) -> DataFrame:
    """Parts as DICOM files: a sequence with a length holds two items, the second another sequence without one."""
    p = inp.spread(spark, sf_dir, "part")
    brand = text(F.when(F.length("p_brand") % 2 == 1, F.concat("p_brand", F.lit(" "))).otherwise(F.col("p_brand")))
    b = F.length(brand)
    o = lambda v, width: ordered(v, width, F.lit(True))
    content = F.concat(
        hx("00" * 128), text("DICM"), hx("0800 4011"), text("SQ"), hx("0000"), o(72 + b, 4),
        hx("FEFF 00E0 0C000000 0800 5011"), text("UI"), hx("0400 312E3200"), hx("FEFF 00E0"), o(44 + b, 4),
        hx("4000 30A7"), text("SQ"), hx("0000 FFFFFFFF FEFF 00E0 FFFFFFFF 0800 0401"), text("LO"), o(b, 2), brand,
        hx("FEFF 0DE0 00000000 FEFF DDE0 00000000 1000 2000"), text("LO"), hx("0800"), text(F.rpad(F.col("p_partkey").cast("string"), 8, " ")),
    )
    return p.select(F.col("p_partkey").alias("path"), sealed(content, "content"))


def dicom_nested(spark, d):
    rows = ex.dicom_elements(nested_files(spark, d), dims.dim_dicom(spark), dims.dim_dicom_enum(spark), places=True)
    return rows.select("path", "seq", "offset", "grp", "elem", "vr", "len", "depth", "parent", "item", "value")


# --- profiles ------------------------------------------------------------------------------------

def profiled_files(spark, sf_dir: str) -> DataFrame:
    """Orders' profiles in chunks of 50 bytes: backwards in every third file, the last one missing in every seventh, the first
    one twice in every fifth."""
    o = packed.icc_profiles(spark, sf_dir).withColumn("k", F.col("path"))
    tail = F.unhex(F.repeat(F.lit("78"), (F.col("k") % 100).cast("int")))
    o = o.select("k", sealed(F.concat("data", tail), "data"))
    n = F.ceil(F.length("data") / 50).cast("int")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.hex(F.concat(
        hx("FFE2"), be(F.least(F.lit(50), F.length("data") - (i - 1) * 50) + 16, 2), text("ICC_PROFILE"), hx("00"), be(i, 1), be(n, 1),
        F.substring("data", (i - 1) * 50 + 1, F.lit(50)))))
    o = o.select("k", sealed(each, "each"))
    held = F.when(F.col("k") % 7 == 0, F.slice("each", F.lit(1), F.size("each") - 1)).otherwise(F.col("each"))
    o = o.select("k", "each", sealed(F.when(F.col("k") % 3 == 0, F.reverse(held)).otherwise(held), "held"))
    again = F.when(F.col("k") % 5 == 0, F.get("each", 0)).otherwise("")
    return o.select(F.col("k").alias("path"), sealed(F.unhex(F.concat(F.lit("FFD8"), F.array_join("held", ""), again, F.lit("FFD9"))), "content"))


def icc_from_files(spark, d):
    """Headers of the profiles that are whole."""
    h = ex.icc_header(ex.icc_profiles(profiled_files(spark, d)).where("complete"))
    return h.withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


def icc_chunks(spark, d):
    rows = ex.icc_profiles(profiled_files(spark, d))
    return rows.select("path", "chunks", "held", F.array_join("missing", ",").alias("missing"), "repeated", "in_order", "complete", F.length("data").alias("size"))


# --- damage --------------------------------------------------------------------------------------

def endless_tags(spark, d):
    """Blocks of 40 tags that each claim 4 GiB: all are given, and no more bytes than the block holds twice."""
    p = inp.spread(spark, d, "part")
    entry = "0100" + "0100" + "FFFFFFFF" + "0A000000"
    data = F.concat(hx("49492A0008000000" + f"{TAGS:02X}00" + entry * TAGS + "00000000"), F.unhex(F.repeat(F.lit("11"), F.col("p_size"))))
    rows = p.select(F.col("p_partkey").alias("path"), sealed(data, "data")).select("path", F.inline(walks.tiff_tags("data")))
    return rows.groupBy("path").agg(F.count("*").alias("n_tags"), F.count_if(~F.col("complete")).alias("n_incomplete"), F.sum(F.length("data")).alias("n_bytes"))


def iptc_extended(spark, d):
    """Datasets with lengths in four and two bytes of their own between plain ones."""
    p = inp.spread(spark, d, "part")

    def extended(dataset: int, width: int, data: Column) -> Column:
        return F.concat(hx(f"1C02{dataset:02X}80{width:02X}"), be(F.length(data), width), data)

    name, kind = text(F.col("p_name")), text(F.col("p_type"))
    block = F.concat(packed._iptc(2, 5, name), extended(25, 4, kind), extended(25, 2, name), packed._iptc(2, 5, kind))
    res = p.select(F.col("p_partkey").alias("path"), F.lit(0x0404).alias("bim_id"), sealed(block, "data"))
    return ex.iptc_records(res, dims.dim_iptc(spark))


QUERIES = {f.__name__: f for f in (avi_tables, avi_index, dicom_nested, icc_from_files, icc_chunks, endless_tags, iptc_extended)}

_SEGMENT = "3D" * len(byte_plans.SEGMENT)
_NESTED = (
    ("132", 8, 0x1140, "SQ", "72 + b", 0, -1, 0, "''"), ("144", 0xFFFE, 0xE000, "??", "12", 1, 0, 1, "''"), ("152", 8, 0x1150, "UI", "4", 1, 0, 1, "'1.2'"),
    ("164", 0xFFFE, 0xE000, "??", "44 + b", 1, 0, 2, "''"), ("172", 0x40, 0xA730, "SQ", "0", 1, 0, 2, "''"), ("184", 0xFFFE, 0xE000, "??", "0", 2, 4, 1, "''"),
    ("192", 8, 0x0104, "LO", "b", 2, 4, 1, "brand"), ("200 + b", 0xFFFE, 0xE00D, "??", "0", 2, 4, 1, "''"), ("208 + b", 0xFFFE, 0xE0DD, "??", "0", 2, 4, 1, "''"),
    ("216 + b", 0x10, 0x20, "LO", "8", 0, -1, 0, "rpad(CAST(p_partkey AS VARCHAR), 8, ' ')"),
)
_CHUNKS = """o AS (SELECT o_orderkey AS k, CAST(128 + o_orderkey % 100 AS INTEGER) AS size, CAST(ceil((128 + o_orderkey % 100) / 50.0::DOUBLE) AS INTEGER) AS n FROM orders),
c AS (SELECT *, list_concat(CASE WHEN k % 3 = 0 THEN list_reverse(l) ELSE l END, CASE WHEN k % 5 = 0 THEN [1] ELSE [] END) AS held
  FROM (SELECT *, CAST(range(1, n + CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END) AS INTEGER[]) AS l FROM o))"""

ORACLE = {
    "avi_tables": f"""WITH f AS (SELECT p_partkey AS k, CAST(j.i AS INTEGER) AS j, p_partkey % 4 + 1 AS n FROM part, range(4) j(i) WHERE j.i < p_partkey % 4 + 1),
g AS (SELECT *, (k + j) % 3 > 0 AS has_tables, 17 + CASE WHEN (k + j) % 3 > 0 THEN 22 ELSE 0 END AS len FROM f),
h AS (SELECT *, CAST(68 + coalesce(sum(21 + len) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos,
  unhex('FFD8' || CASE WHEN has_tables THEN '{camera_plans.DHT}' ELSE '{_SEGMENT}' END || '{SCAN}' || printf('%02X', (k + j) % 250) || 'FF00FFD9') AS frame,
  k % 7 > 0 OR j < n - 1 AS indexed FROM g)
SELECT k AS path, j + 1 AS frame_no, 0 AS stream, pos, indexed, indexed AND j = 0 AS key, has_tables, CAST(octet_length(frame) AS INTEGER) AS size, md5(frame) AS md5 FROM h""",
    "avi_index": """SELECT p_partkey AS path, p_partkey % 4 + 1 AS frames, p_partkey % 4 + 1 - CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS indexed,
  CAST(CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS stray, p_partkey % 7 > 0 AND p_partkey % 11 > 0 AS agree FROM part""",
    "dicom_nested": "WITH p AS (SELECT p_partkey, p_brand || CASE WHEN length(p_brand) % 2 = 1 THEN ' ' ELSE '' END AS brand, length(p_brand) + length(p_brand) % 2 AS b FROM part) " + " UNION ALL ".join(
        f"""SELECT p_partkey AS path, {i} AS seq, CAST({at} AS BIGINT) AS "offset", {g} AS grp, {e} AS elem, '{vr}' AS vr, CAST({n} AS BIGINT) AS len,
  {depth} AS depth, {parent} AS parent, {item} AS item, {value} AS value FROM p""" for i, (at, g, e, vr, n, depth, parent, item, value) in enumerate(_NESTED)),
    "icc_from_files": extract_plans.ORACLE["icc_header"] + " WHERE o_orderkey % 7 > 0",
    "icc_chunks": f"""WITH {_CHUNKS} SELECT k AS path, n AS chunks, CAST(len(held) AS INTEGER) AS held, CASE WHEN k % 7 = 0 THEN CAST(n AS VARCHAR) ELSE '' END AS missing,
  CAST(len(held) - len(list_distinct(held)) AS INTEGER) AS repeated, held = list_sort(held) AS in_order, k % 7 > 0 AS complete, CASE WHEN k % 7 > 0 THEN size END AS size FROM c""",
    "endless_tags": f"""SELECT p_partkey AS path, CAST({TAGS} AS BIGINT) AS n_tags, CAST({TAGS} AS BIGINT) AS n_incomplete, CAST(2 * ({14 + 12 * TAGS} + p_size - 10) AS BIGINT) AS n_bytes FROM part""",
    "iptc_extended": " UNION ALL ".join(
        f"""SELECT p_partkey AS path, {i} AS seq, 2 AS record, {s} AS dataset, '{n}' AS name, CAST(length({v}) AS INTEGER) AS len, '"' || {v} || '"' AS value FROM part"""
        for i, (s, n, v) in enumerate(((5, "Object Name", "p_name"), (25, "Keywords", "p_type"), (25, "Keywords", "p_name"), (5, "Object Name", "p_type")))),
}
