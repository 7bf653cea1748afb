"""Queries over packed camera files: frames with thumbnails, damaged blocks, and the way from files to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixsieve.operators import carving as cv
from pixsieve.operators import extract as ex
from pixsieve.operators import signatures as sg
from pixsieve.plans import inputs as inp
from pixsieve.plans import packed
from pixsieve.plans.packed import be, hx, ordered, sealed, text
from pixsieve.sources import dims

SOS1, SOS3 = "FFDA0008010100003F00", "FFDA000C03010002110311003F00"
DHT = "FFC40014" + "00" + "01" + "00" * 15 + "07"
CUT = "FFD8FFDB00430001"
NO_MARKERS = ("\x00",)


def camera_files(spark, sf_dir: str) -> DataFrame:
    """Parts as camera files: some leading bytes, a JPEG whose APP1 holds make, model and a whole thumbnail JPEG, and for
    every fourth part the beginning of another one."""
    p = inp.spread(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    le = F.lit(True)

    def o(v, width):
        return ordered(v, width, le)

    def flat(v):
        return F.unhex(F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(64)))

    thumb = F.concat(hx("FFD8 FFDB 0043 00"), flat(size), hx("FFC0 000B 08 0008 0008 01 01 11 00" + SOS1), be(key % 200, 1), hx("FFD9"))
    p = p.select("*", sealed(thumb, "thumb"))
    tiff = F.concat(
        hx("49492A0008000000"),
        o(2, 2), o(0x010F, 2), o(2, 2), o(F.length("p_brand") + 1, 4), o(68, 4), o(0x0110, 2), o(2, 2), o(F.length("p_type") + 1, 4), o(100, 4), o(38, 4),
        o(2, 2), o(0x0201, 2), o(4, 2), o(1, 4), o(132, 4), o(0x0202, 2), o(4, 2), o(1, 4), o(F.length("thumb"), 4), o(0, 4),
        text(F.col("p_brand"), 32), text(F.col("p_type"), 32), F.col("thumb"),
    )
    p = p.select("*", sealed(tiff, "tiff"))
    main = F.concat(
        hx("FFD8FFE1"), be(F.length("tiff") + 8, 2), hx("457869660000"), F.col("tiff"), hx("FFDB 0043 00"), flat(size + 1),
        hx("FFC0 0011 08 0010 0010 03 01 22 00 02 11 01 03 11 01"), F.when(key % 3 > 0, hx(DHT)).otherwise(hx("")), hx(SOS3), be(key % 250, 1), hx("FF00FFD079FFD9"),
    )
    lead = F.unhex(F.repeat(F.lit("2A"), (key % 5).cast("int")))
    content = F.concat(lead, main, F.when(key % 4 == 0, hx(CUT)).otherwise(hx("")))
    return p.select(key.alias("path"), sealed(content, "content"))


def carved_jpegs(spark, d):
    f = cv.jpeg_frames(camera_files(spark, d))
    return f.select("path", "frame_no", "pos", "end_pos", "terminated", "has_tables", "scan_at", F.md5("frame").alias("md5"))


def _first_frames(spark, d) -> DataFrame:
    return cv.jpeg_frames(camera_files(spark, d)).where("frame_no = 1").select("path", F.col("frame").alias("content"))


def _exif(spark, d) -> DataFrame:
    return ex.segment_data(_first_frames(spark, d), 0xE1, b"Exif\x00\x00")


def thumbnail_signatures(spark, d):
    return ex.thumbnail_signatures(_exif(spark, d))


def file_verdicts(spark, d):
    """From file bytes to verdicts: frames, headers and tags, signatures, the signature table, the rules."""
    signed = ex.image_signatures(ex.header_segments(_first_frames(spark, d)))
    tags = ex.exif_tags(_exif(spark, d), dims.dim_exif(spark)).where("section = 'ifd0'")
    meta = tags.groupBy("path").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(c) for n, c in (("Make", "make"), ("Model", "model"), ("Software", "software"))])
    images = signed.join(meta.withColumnRenamed("path", "image_id"), "image_id").select(
        "image_id", "make", "model", F.col("csig").alias("sig"), F.coalesce("software", F.lit("")).alias("software"), F.lit(False).alias("has_makernote"))
    p = inp.table(spark, d, "part")
    csig = F.upper(F.md5(F.concat(F.lit("2x2;"), F.array_join(F.array_repeat((F.col("p_size") + 1).cast("string"), 64), ","))))
    kind = F.when(F.col("p_partkey") % 2 == 0, "camera").when(F.col("p_size") % 5 == 1, "software").otherwise("unsure")
    known = p.select(
        F.col("p_partkey").alias("sig_id"), F.lit(True).alias("valid"), kind.alias("editor_class"), F.col("p_brand").alias("make"),
        F.col("p_type").alias("model"), csig.alias("csig"), csig.alias("csig_rot"))
    none = spark.createDataFrame([], "make STRING, model STRING")
    return sg.verdicts(images, known, none, none, NO_MARKERS)


def damaged_exif(spark, d):
    """Blocks with an endless count, cut-off blocks and good ones together: tags read and tags incomplete."""
    t = packed.tiff_blocks(spark, d)
    endless = F.overlay("data", F.lit(b"\xff\xff\xff\xff"), F.lit(15), F.lit(4))
    bad = t.select("path", F.when(F.col("path") % 3 == 0, endless).when(F.col("path") % 3 == 1, F.substring("data", 1, 60)).otherwise(F.col("data")).alias("data"))
    tags = ex.exif_tags(bad, dims.dim_exif(spark))
    return tags.groupBy("path").agg(F.count("*").alias("n_tags"), F.count_if(~F.col("complete")).alias("n_incomplete"))


def damaged_psd(spark, d):
    """Layer sections cut at a third of the files' tails: layers read, layers incomplete."""
    f = packed.psd_files(spark, d)
    cut = F.when(F.col("path") % 3 == 0, F.substring("content", F.lit(1), F.length("content") - 9)).otherwise(F.col("content"))
    rows = ex.psd_layers(f.select("path", cut.alias("content")))
    return rows.groupBy("path").agg(F.count("*").alias("n_layers"), F.count_if(~F.col("complete")).alias("n_incomplete"))


QUERIES = {f.__name__: f for f in (carved_jpegs, thumbnail_signatures, file_verdicts, damaged_exif, damaged_psd)}

_HEX = f"""h AS (SELECT p_partkey AS path, p_partkey AS k, p_size AS s, p_brand, p_type,
  'FFD8FFDB004300' || repeat(printf('%02X', p_size), 64) || 'FFC0000B080008000801011100{SOS1}' || printf('%02X', p_partkey % 200) || 'FFD9' AS thumb FROM part),
t AS (SELECT *, '49492A0008000000' || '0200' || '0F010200' || printf('%02X', length(p_brand) + 1) || '000000' || '44000000' || '10010200'
  || printf('%02X', length(p_type) + 1) || '000000' || '64000000' || '26000000' || '0200' || '01020400' || '01000000' || '84000000' || '02020400' || '01000000'
  || printf('%02X', length(thumb) // 2) || '000000' || '00000000' || rpad(hex(encode(p_brand)), 64, '0') || rpad(hex(encode(p_type)), 64, '0') || thumb AS tiff FROM h),
m AS (SELECT *, 'FFD8FFE1' || printf('%04X', length(tiff) // 2 + 8) || '457869660000' || tiff || 'FFDB004300' || repeat(printf('%02X', s + 1), 64)
  || 'FFC00011080010001003012200021101031101' || CASE WHEN k % 3 > 0 THEN '{DHT}' ELSE '' END AS head FROM t),
w AS (SELECT *, head || '{SOS3}' || printf('%02X', k % 250) || 'FF00FFD079FFD9' AS jpeg FROM m)"""
_SIG = "upper(md5({sub} || array_to_string(list_transform(range(64), lambda i: CAST({v} AS VARCHAR)), ',')))"

ORACLE = {
    "carved_jpegs": f"""WITH {_HEX} SELECT path, 1 AS frame_no, CAST(k % 5 AS BIGINT) AS pos, CAST(k % 5 + length(jpeg) // 2 AS BIGINT) AS end_pos, true AS terminated,
  k % 3 > 0 AS has_tables, CAST(length(head) // 2 AS BIGINT) AS scan_at, md5(unhex(jpeg)) AS md5 FROM w
UNION ALL SELECT path, 2, CAST(k % 5 + length(jpeg) // 2 AS BIGINT), CAST(k % 5 + length(jpeg) // 2 + {len(CUT) // 2} AS BIGINT), false, false, CAST(-1 AS BIGINT),
  md5(unhex('{CUT}')) FROM w WHERE k % 4 = 0""",
    "thumbnail_signatures": f"SELECT p_partkey AS image_id, {_SIG.format(sub=chr(39) + '1x1;' + chr(39), v='p_size')} AS csig, {_SIG.format(sub=chr(39) + '1x1;' + chr(39), v='p_size')} AS csig_rot FROM part",
    "file_verdicts": """WITH sw AS (SELECT p_size AS s, count(*) AS n FROM part WHERE p_partkey % 2 = 1 AND p_size % 5 = 1 GROUP BY p_size),
cam AS (SELECT p_brand, p_type, p_size AS s, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
j AS (SELECT p.p_partkey AS image_id, coalesce(sw.n, 0) AS n_software, coalesce(cam.n, 0) AS n_camera FROM part p LEFT JOIN sw ON sw.s = p.p_size
  LEFT JOIN cam ON cam.s = p.p_size AND cam.p_brand = p.p_brand AND cam.p_type = p.p_type)
SELECT image_id, n_software, n_camera, CASE WHEN n_software > 0 AND n_camera = 0 THEN 'YES' WHEN n_software > 0 THEN 'UNSURE' WHEN n_camera > 0 THEN 'YESPROB' ELSE 'UNSURE' END AS edited,
  CASE WHEN n_software > 0 OR n_camera > 0 THEN 'unset' ELSE 'camera' END AS db_action FROM j""",
    "damaged_exif": """SELECT p_partkey AS path, CAST(CASE WHEN p_partkey % 3 = 1 THEN 4 ELSE 15 END AS BIGINT) AS n_tags,
  CAST(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS n_incomplete FROM part""",
    "damaged_psd": """SELECT p_partkey AS path, CAST(2 AS BIGINT) AS n_layers, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_incomplete FROM part""",
}
