"""Queries that write files as files and read them back: frames, reports, whole listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixsieve.operators import carving as cv
from pixsieve.plans import camera_plans, corpus_plans
from pixsieve.plans import inputs as inp
from pixsieve.sources import corpus, files, reports


def _below(root: str) -> Column:
    """The path below a folder whose name occurs once in it."""
    return F.substring_index("path", root.rsplit("/", 1)[1] + "/", -1)


def _written(spark, target: str) -> DataFrame:
    read = corpus.read_files(spark, target, recursive=True, extract_all=True)
    return read.select(_below(target).alias("name"), "length", F.md5("content").alias("md5"))


def frame_files(spark, d):
    """Every embedded JPEG as a file of its own, written, listed and read again."""
    target = files.shared_folder(spark)
    root = F.concat(F.lit("cam/"), (F.col("path") % 10).cast("string"), F.lit("/p"), F.col("path").cast("string"))
    cv.write_frame_files(cv.jpeg_frames(camera_plans.camera_files(spark, d)), target, root)
    return _written(spark, target)


def report_files(spark, d):
    """One text file of report lines per path, written and read again."""
    target = files.shared_folder(spark)
    reports.write_report_files(reports.numbered(corpus_plans.report_severity(spark, d)), target)
    return _written(spark, target)


def corpus_listing(spark, d):
    """Documents as files of several endings, some of them empty, listed and planned as a batch."""
    target = files.shared_folder(spark)
    docs = inp.table(spark, d, "documents").select(F.col("doc_id").alias("k"), "lang", F.encode("text", "UTF-8").alias("b"))
    names = F.get(F.array(*[F.lit(e) for e in corpus_plans.ENDINGS]), (F.col("k") % 6).cast("int"))
    name = F.concat(F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.coalesce("lang", F.lit("und")), F.lit("/"))), F.lit("a b+%"), F.col("k").cast("string"), names)
    content = F.when(F.col("k") % 17 > 0, F.col("b"))
    files.write_files(docs.select(name.alias("name"), content.alias("content")), target)
    listed = corpus.read_files(spark, target, recursive=True)
    planned = corpus.plan_batch(listed.select(F.concat(F.lit("/in/"), _below(target)).alias("path"), "length"), "/in", "/out")
    return planned.withColumn("status", corpus.size_status(F.col("length")))


QUERIES = {f.__name__: f for f in (frame_files, report_files, corpus_listing)}

_ENDS = str([*corpus_plans.ENDINGS])
ORACLE = {
    "frame_files": f"""WITH {camera_plans._HEX}, n AS (SELECT 'cam/' || k % 10 || '/p' || k AS root, k, jpeg FROM w)
SELECT root || '.000001.jpg' AS name, CAST(length(jpeg) // 2 AS BIGINT) AS length, md5(unhex(jpeg)) AS md5 FROM n
UNION ALL SELECT root || '.000002.jpg', {len(camera_plans.CUT) // 2}, md5(unhex('{camera_plans.CUT}')) FROM n WHERE k % 4 = 0""",
    "report_files": f"""WITH {corpus_plans._REP}, t AS (SELECT path, string_agg(text || chr(10), '' ORDER BY seq) AS body FROM rep GROUP BY path)
SELECT path || '.txt' AS name, CAST(octet_length(encode(body)) AS BIGINT) AS length, md5(body) AS md5 FROM t""",
    "corpus_listing": f"""WITH f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(lang, 'und') || '/' END || 'a b+%' || doc_id || {_ENDS}[doc_id % 6 + 1] AS rel,
  CAST(CASE WHEN doc_id % 17 > 0 THEN octet_length(encode(text)) ELSE 0 END AS BIGINT) AS length FROM documents)
SELECT '/in/' || rel AS path, length, '/out/' || rel AS dst_path, '/out/' || rel || '.txt' AS log_path,
  CASE WHEN length = 0 THEN 'empty' WHEN length > 4294967295 THEN 'too_large' ELSE 'ok' END AS status
FROM f WHERE lower(rel) LIKE '%.jpg' OR lower(rel) LIKE '%.jpeg'""",
}
