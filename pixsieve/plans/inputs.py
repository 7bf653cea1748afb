"""Forensic views over the given tables, and the same views as SQL text for the checks.

blocks/codes/bytes/html/signatures/facts stand in for decoded corpora: each is a projection of one
given table, so everything built on them grows with that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixsieve.sources.dims import ROTATE, UNZIGZAG, ZIGZAG


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that become files in one task.
TASK_ROWS = 1 << 12


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows become files, dealt evenly over as many tasks as it has rows for.

    A row of some dozen bytes becomes hundreds of bytes of file and is walked in Python, yet Spark cuts a scan by the bytes it
    reads: a million rows may be one task. The count comes from the files' footers.
    """
    t = table(spark, sf_dir, name)
    tasks = -(-t.count() // TASK_ROWS)
    return t.repartition(tasks) if tasks > 1 else t


def sql_list(values) -> str:
    return "[" + ",".join(str(v) for v in values) + "]"


# --- blocks: one 8x8 block per row, coefficients as one array -----------------------------------

def block_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("block_id"),
        F.col("label").alias("image_id"),
        F.transform("embedding", lambda e: F.floor(e.cast("double") * 100).cast("int")).alias("q"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_arrays(spark, sf_dir).select("block_id", "image_id", F.posexplode("q").alias("pos", "q"))


BLOCKS = """blocks AS MATERIALIZED (
  SELECT vec_id AS block_id, label AS image_id, CAST(r.pos AS INTEGER) AS pos,
         CAST(floor(CAST(embedding[r.pos+1] AS DOUBLE)*100) AS INTEGER) AS q
  FROM embeddings, range(64) r(pos))"""


def dqt_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of 64 values (zigzag order) per image, from its first block."""
    first = block_arrays(spark, sf_dir).groupBy("image_id").agg(F.min_by("q", "block_id").alias("q"))
    return first.select(
        "image_id", F.transform("q", lambda v: (F.lit(1) + F.abs(v) % 255).cast("int")).alias("table_zz")
    )


DQT = """dqt AS MATERIALIZED (
  SELECT image_id, pos AS zz, 1 + abs(q) % 255 AS value FROM blocks
  WHERE block_id IN (SELECT min(block_id) FROM blocks GROUP BY image_id))"""


def _cells() -> Column:
    """64 pixels (idx, yv, cb, cr) of a block; values beyond +-1024 occur, so that clipping fires."""
    rot = F.array(*[F.lit(r) for r in ROTATE])
    return F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.struct(
            i.alias("idx"),
            (F.get("q", i) * 32).alias("yv"),
            (F.get("q", F.get(rot, i)) * 8).alias("cb"),
            (F.get("q", F.lit(63) - i) * 8).alias("cr"),
        ),
    )


def pixel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, block_id, cells: one row per block."""
    return block_arrays(spark, sf_dir).select("image_id", "block_id", _cells().alias("cells"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, block_id, idx, yv, cb, cr: one row per pixel."""
    return block_arrays(spark, sf_dir).select("image_id", "block_id", F.inline(_cells()))


#: Blocks as arrays: places are read by index, so no view joins itself.
ARRAYS = """arrays AS MATERIALIZED (
  SELECT vec_id AS block_id, label AS image_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE)*100) AS INTEGER)) AS q FROM embeddings)"""
PIXELS = f"""{ARRAYS},
pixels AS MATERIALIZED (
  SELECT image_id, block_id, CAST(r.i AS INTEGER) AS idx, q[r.i + 1]*32 AS yv, q[(r.i % 8)*8 + r.i // 8 + 1]*8 AS cb, q[64 - r.i]*8 AS cr
  FROM arrays, range(64) r(i))"""

ZZ_SQL = sql_list(ZIGZAG)
UNZZ_SQL = sql_list(UNZIGZAG)
ROT_SQL = sql_list(ROTATE)


# --- codes: ordered code stream, one user per image ----------------------------------------------

CODES_BODY = """
  SELECT user_id AS path, event_id AS seq,
         CAST(event_id % 3 + 1 AS INT) AS comp,
         CAST(event_id % 16 + 1 AS INT) AS bits1,
         CAST(event_id % 11 AS INT) AS bits2,
         CAST(floor(value) AS INT) % 200 - 100 AS delta,
         CAST(event_id % 7 AS INT) AS zrl,
         event_type = 'signup' AS is_rst,
         CAST((event_id + user_id) % 8 AS INT) AS rst,
         event_type = 'error' AS is_error,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'header'
              WHEN 'purchase' THEN 'good' WHEN 'view' THEN 'warn' ELSE 'normal' END AS severity,
         CAST(floor(value) AS INT) % 300 AS rec_len
  FROM events"""
CODES = f"codes AS ({CODES_BODY})"
SEGS = """segs AS (SELECT *, CAST(sum(CASE WHEN is_rst THEN 1 ELSE 0 END) OVER (
  PARTITION BY path ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rst_seg FROM codes)"""


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid, whole, kind = F.col("event_id"), F.floor("value").cast("int"), F.col("event_type")
    return e.select(
        F.col("user_id").alias("path"),
        eid.alias("seq"),
        (eid % 3 + 1).cast("int").alias("comp"),
        (eid % 16 + 1).cast("int").alias("bits1"),
        (eid % 11).cast("int").alias("bits2"),
        (whole % 200 - 100).alias("delta"),
        (eid % 7).cast("int").alias("zrl"),
        (kind == "signup").alias("is_rst"),
        ((eid + F.col("user_id")) % 8).cast("int").alias("rst"),
        (kind == "error").alias("is_error"),
        F.when(kind == "error", "error").when(kind == "signup", "header").when(kind == "purchase", "good")
        .when(kind == "view", "warn").otherwise("normal").alias("severity"),
        (whole % 300).alias("rec_len"),
    )


def event_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, seq, tag_id: one GPS-section tag per event."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"),
        F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").cast("int").alias("tag_id"),
    )


EVENT_TAGS = """event_tags AS (
  SELECT user_id AS path, event_id AS seq, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS tag_id FROM events)"""


# --- byte corpora --------------------------------------------------------------------------------

def byte_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"), F.col("text"), F.encode("text", "UTF-8").alias("content")
    )


def html_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), "html")


# --- signature database --------------------------------------------------------------------------

SIGNATURES = """signatures AS (
  SELECT p_partkey AS sig_id, p_partkey % 5 = 0 AS is_user, p_partkey % 7 <> 0 AS valid,
         CASE p_partkey % 3 WHEN 0 THEN 'camera' WHEN 1 THEN 'software' ELSE 'unsure' END AS editor_class,
         p_brand AS make, p_type AS model, CAST(p_size AS VARCHAR) AS quality,
         upper(md5(p_name)) AS csig, upper(md5(reverse(p_name))) AS csig_rot FROM part)"""
IMAGES = """images AS (
  SELECT p_partkey AS image_id, p_brand AS make, p_type AS model,
         upper(md5(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE reverse(p_name) END)) AS sig
  FROM part)"""
EXC_NO_MAKERNOTE = (("Brand#1", ""), ("Brand#2", "ECO*"), ("Brand#3", "PRO"), ("Brand#4", "X*"))
EXC_IS_EDIT = (("Brand#5", ""), ("Brand#6", "PROMO"))


def values_sql(name: str, columns: str, rows) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (SELECT * FROM (VALUES {body}))"


def signatures(spark: SparkSession, sf_dir: str, hashed: Column | None = None) -> DataFrame:
    """The signature table over parts; ``hashed`` is the text behind the hashes, the part name unless given."""
    k, hashed = F.col("p_partkey"), F.col("p_name") if hashed is None else hashed
    return table(spark, sf_dir, "part").select(
        k.alias("sig_id"),
        (k % 5 == 0).alias("is_user"),
        (k % 7 != 0).alias("valid"),
        F.when(k % 3 == 0, "camera").when(k % 3 == 1, "software").otherwise("unsure").alias("editor_class"),
        F.col("p_brand").alias("make"),
        F.col("p_type").alias("model"),
        F.col("p_size").cast("string").alias("quality"),
        F.upper(F.md5(hashed)).alias("csig"),
        F.upper(F.md5(F.reverse(hashed))).alias("csig_rot"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("image_id"),
        F.col("p_brand").alias("make"),
        F.col("p_type").alias("model"),
        F.upper(F.md5(F.when(k % 2 == 0, F.col("p_name")).otherwise(F.reverse("p_name")))).alias("sig"),
    )


# --- order-independent facts ---------------------------------------------------------------------

FACTS = """facts AS (
  SELECT l_orderkey AS path, l_linenumber AS n,
         CAST(floor(l_extendedprice) AS INT) % 4000 + 1 AS width,
         CAST(floor(l_extendedprice / 7) AS INT) % 3000 + 1 AS height,
         CAST(l_quantity AS INT) AS code, l_linenumber % 4 + 1 AS hmax, l_linenumber % 2 + 1 AS vmax,
         CAST(floor(l_extendedprice * 100) AS BIGINT) AS scan_bytes
  FROM lineitem)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, n = F.col("l_extendedprice"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"),
        n.alias("n"),
        (F.floor(price).cast("int") % 4000 + 1).alias("width"),
        (F.floor(price / 7).cast("int") % 3000 + 1).alias("height"),
        F.col("l_quantity").cast("int").alias("code"),
        (n % 4 + 1).alias("hmax"),
        (n % 2 + 1).alias("vmax"),
        F.floor(price * 100).cast("bigint").alias("scan_bytes"),
    )
