"""Corpus listing and report queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixsieve.plans import inputs as inp
from pixsieve.sources import corpus, reports

ENDINGS = (".jpg", ".JPEG", ".png", "", ".Jpg", ".jpeg.txt")


def _files(spark, d):
    """A file listing over the documents: two directory levels, mixed endings, some empty, some huge."""
    k = F.col("doc_id")
    folder = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat("lang", F.lit("/")))
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), (k % 6).cast("int"))
    return inp.table(spark, d, "documents").select(
        k.alias("file_no"),
        F.concat(F.lit("/corpus/"), folder, F.lit("img"), k.cast("string"), ending).alias("path"),
        F.when(k % 17 == 0, F.lit(0)).when(k % 19 == 0, F.col("n_chars") * 1000000000).otherwise(F.col("n_chars")).alias("length"),
    )


def corpus_scan(spark, d):
    return corpus.plan_batch(_files(spark, d), "/corpus", "/out")


def corpus_flat(spark, d):
    return corpus.plan_batch(_files(spark, d), "/corpus", "/out", recursive=False)


def corpus_all(spark, d):
    return corpus.plan_batch(_files(spark, d), "/corpus", "/out", extract_all=True)


def size_guard(spark, d):
    f = _files(spark, d)
    return f.select("path", "length", corpus.size_status(F.col("length")).alias("status"))


def batch_progress(spark, d):
    f = _files(spark, d).select("file_no", "path")
    return corpus.batch_progress(f, "file_no").withColumn("percent", F.round("percent", 4))


def _report(spark, d):
    c = inp.codes(spark, d)
    body = reports.lines(c, F.col("severity"), F.concat(F.lit("code "), F.col("bits1").cast("string")))
    marks = c.where("is_rst").select("path", F.col("seq"))
    extra = reports.lines(marks.withColumn("seq", -F.col("seq") - 1), "header_desc", F.lit("restart listed"))
    muted = reports.lines(c, "normal", F.lit("muted"), enabled=False)
    return body.unionByName(extra).unionByName(muted)


def report_severity(spark, d):
    return _report(spark, d)


def report_lines(spark, d):
    return reports.numbered(_report(spark, d))


QUERIES = {f.__name__: f for f in (corpus_scan, corpus_flat, corpus_all, size_guard, batch_progress, report_severity, report_lines)}

_ENDS = str([*ENDINGS])
_FILES = f"""files AS (SELECT doc_id AS file_no, '/corpus/' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || '/' END || 'img' || doc_id || {_ENDS}[doc_id % 6 + 1] AS path,
  CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 19 = 0 THEN n_chars * 1000000000 ELSE n_chars END AS length FROM documents)"""
_OUT = "file_no, path, length, '/out' || substr(path, 8) AS dst_path, '/out' || substr(path, 8) || '.txt' AS log_path FROM files"
_EXT = "(lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.jpeg')"
_REP = f"""{inp.CODES}, rep AS (SELECT path, seq, severity, 'code ' || bits1 AS text FROM codes
  UNION ALL SELECT path, -seq - 1, 'header_desc', 'restart listed' FROM codes WHERE is_rst)"""

ORACLE = {
    "corpus_scan": f"WITH {_FILES} SELECT {_OUT} WHERE {_EXT}",
    "corpus_flat": f"WITH {_FILES} SELECT {_OUT} WHERE {_EXT} AND NOT contains(substr(path, 9), '/')",
    "corpus_all": f"WITH {_FILES} SELECT {_OUT}",
    "size_guard": f"WITH {_FILES} SELECT path, length, CASE WHEN length = 0 THEN 'empty' WHEN length > 4294967295 THEN 'too_large' ELSE 'ok' END AS status FROM files",
    "batch_progress": f"""WITH {_FILES} SELECT file_no, path, row_number() OVER (ORDER BY file_no) AS i, count(*) OVER () AS n,
  round(row_number() OVER (ORDER BY file_no) * 100.0::DOUBLE / count(*) OVER (), 4) AS percent FROM files""",
    "report_severity": f"WITH {_REP} SELECT * FROM rep",
    "report_lines": f"WITH {_REP} SELECT path, row_number() OVER (PARTITION BY path ORDER BY seq) AS line_no, severity, text FROM rep",
}
