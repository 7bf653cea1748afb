"""Queries over packed documents with picture data, raw and by run lengths, some rows damaged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixsieve.operators import extract as ex
from pixsieve.operators import pictures
from pixsieve.plans import inputs as inp
from pixsieve.plans.packed import be, hx, sealed


def picture_files(spark, sf_dir: str) -> DataFrame:
    """Parts as documents without layers: width by size, one to seven lines, three channels.

    Odd parts are stored by run lengths: half a line repeated, the rest copied. Every fifth of them has a first run that is
    one too short, if it has two; every fifth raw one lacks its last byte.
    """
    p = inp.spread(spark, sf_dir, "part").withColumns({"k": F.col("p_partkey"), "w": F.col("p_size"), "h": (F.col("p_partkey") % 7 + 1).cast("int")})
    half = F.floor(F.col("w") / 2).cast("int")

    def byte(v):
        return F.lpad(F.hex(v % 256), 2, "0")

    def line(c, y):
        flat = byte(F.col("k") + c * 31 + y * 7)
        rest = F.array_join(F.transform(F.sequence(half, F.col("w") - 1), lambda x: byte(F.col("k") + x * 5 + c * 64 + y)), "")
        short = F.when((F.col("k") % 5 == 0) & (c == 0) & (y == 0) & (half > 1), 1).otherwise(0)
        coded = F.concat(F.when(half > 0, F.concat(byte(F.lit(257) - half + short), flat)).otherwise(""), byte(F.col("w") - half - 1), rest)
        return F.when(F.col("k") % 2 == 1, coded).otherwise(F.concat(F.repeat(flat, half), rest))

    lines = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda y: line(c, y))))
    p = p.select("*", sealed(lines, "lines"))
    table = F.array_join(F.transform("lines", lambda x: F.lpad(F.hex(F.length(x) / 2), 4, "0")), "")
    body = F.concat(F.when(F.col("k") % 2 == 1, F.concat(F.lit("0001"), table)).otherwise("0000"), F.array_join("lines", ""))
    lost = F.when(F.col("k") % 10 == 0, 2).otherwise(0)
    body = F.unhex(F.substring(body, F.lit(1), F.length(body) - lost))
    content = F.concat(hx("38425053 0001 000000000000 0003"), be(F.col("h"), 4), be(F.col("w"), 4), hx("0008 0003 00000000 00000000 00000000"), body)
    return p.select(F.col("k").alias("path"), sealed(content, "content"))


def psd_pixels(spark, d):
    return pictures.pixels(picture_files(spark, d)).select("path", "y", "x", *[F.col(c).cast("int").alias(c) for c in "rgb"])


def psd_row_audit(spark, d):
    rows = pictures.expanded_rows(pictures.picture_rows(picture_files(spark, d)))
    return rows.select("path", "chan", "y", "method", "offset", "len", "expanded", "ok")


def psd_global_mask(spark, d):
    """Parts as documents with a global mask behind a few bytes of layer records; none in every fourth, a short one in every fifth."""
    p = inp.spread(spark, d, "part").withColumn("k", F.col("p_partkey"))
    mask = F.concat(be(F.col("k") % 10, 4), *[be((F.col("k") + i) % 65536, 2) for i in range(4)], be(F.col("p_size"), 2), be(F.col("k") % 3 + 126, 1), hx("00"))
    held = F.when(F.col("k") % 4 == 0, hx("")).when(F.col("k") % 5 == 0, F.substring(mask, 1, 6)).otherwise(mask)
    p = p.select("k", sealed(held, "held"))
    records = F.unhex(F.repeat(F.lit("00"), (F.col("k") % 6).cast("int")))
    section = F.concat(be(F.length(records), 4), records, be(F.length("held"), 4), "held")
    content = F.concat(hx("38425053 0001 000000000000 0003 00000001 00000001 0008 0003 00000000 00000000"), be(F.length(section), 4), section, hx("0000 010203"))
    return ex.psd_global_mask(p.select(F.col("k").alias("path"), sealed(content, "content")))


QUERIES = {f.__name__: f for f in (psd_pixels, psd_row_audit, psd_global_mask)}

_ROWS = """p AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS w, CAST(p_partkey % 7 + 1 AS INTEGER) AS h, CAST(p_size // 2 AS BIGINT) AS half FROM part),
r AS (SELECT *, CAST(c.i AS INTEGER) AS chan, CAST(l.i AS INTEGER) AS y FROM p, range(3) c(i), range(7) l(i) WHERE l.i < h)"""
#: The sample of a stored line at place x, counted in stored samples.
_AT = "CASE WHEN {x} < half THEN (k + {c} * 31 + y * 7) % 256 ELSE (k + ({x}) * 5 + {c} * 64 + y) % 256 END"
#: A run that is one too short moves the line's samples to the left, if it has two.
_RED = "CASE WHEN k % 10 = 5 AND y = 0 AND half > 1 THEN CASE WHEN x + 1 < w THEN " + _AT.format(x="x + 1", c=0) + " END ELSE " + _AT.format(x="x", c=0) + " END"
_BLUE = "CASE WHEN k % 10 = 0 AND y = h - 1 AND x = w - 1 THEN NULL ELSE " + _AT.format(x="x", c=2) + " END"

ORACLE = {
    "psd_pixels": f"""WITH {_ROWS}, c AS (SELECT * FROM r, range(64) q(x) WHERE x < w AND chan = 0)
SELECT k AS path, y, CAST(x AS INTEGER) AS x, CAST({_RED} AS INTEGER) AS r, CAST({_AT.format(x='x', c=1)} AS INTEGER) AS g, CAST({_BLUE} AS INTEGER) AS b FROM c""",
    "psd_row_audit": f"""WITH {_ROWS}, s AS (SELECT *, CASE WHEN k % 2 = 1 THEN 1 + (w - half) + CASE WHEN half > 0 THEN 2 ELSE 0 END ELSE w END AS n FROM r)
SELECT k AS path, chan, y, CAST(k % 2 AS INTEGER) AS method, CAST(40 + CASE WHEN k % 2 = 1 THEN 6 * h ELSE 0 END + n * (chan * h + y) AS BIGINT) AS "offset", CAST(n AS INTEGER) AS len,
  w - CASE WHEN (k % 10 = 5 AND chan = 0 AND y = 0 AND half > 1) OR (k % 10 = 0 AND chan = 2 AND y = h - 1) THEN 1 ELSE 0 END AS expanded,
  NOT ((k % 10 = 5 AND chan = 0 AND y = 0 AND half > 1) OR (k % 10 = 0 AND chan = 2 AND y = h - 1)) AS ok FROM s""",
    "psd_global_mask": """WITH p AS (SELECT p_partkey AS k, p_size AS w, CASE WHEN p_partkey % 5 = 0 THEN 6 ELSE 16 END AS n FROM part WHERE p_partkey % 4 > 0)
SELECT k AS path, 42 + k % 6 AS "offset", CAST(n AS BIGINT) AS len, k % 10 AS color_space, k % 65536 AS c1, CASE WHEN n = 16 THEN (k + 1) % 65536 END AS c2,
  CASE WHEN n = 16 THEN (k + 2) % 65536 END AS c3, CASE WHEN n = 16 THEN (k + 3) % 65536 END AS c4, CAST(CASE WHEN n = 16 THEN w END AS BIGINT) AS opacity,
  CASE WHEN n = 16 THEN k % 3 + 126 END AS kind FROM p""",
}
