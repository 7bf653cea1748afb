"""Report rows and their sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixsieve.running import SPAN, row_index
from pixsieve.sources.files import write_files

SEVERITIES = ("normal", "header", "header_desc", "warn", "error", "good")
LINES_PER_FILE = 1 << 20


def lines(rows: DataFrame, severity: str | Column, text: Column, enabled: bool = True) -> DataFrame:
    """path, seq, severity, text; a disabled report takes no lines."""
    if isinstance(severity, str):
        if severity not in SEVERITIES:
            raise ValueError(f"unknown severity {severity}")
        severity = F.lit(severity)
    out = rows.select("path", "seq", severity.alias("severity"), text.alias("text"))
    return out if enabled else out.where(F.lit(False))


def numbered(report: DataFrame, span: int = SPAN) -> DataFrame:
    """path, line_no (from 1), severity, text."""
    at = row_index(report, ["path"], "seq", "__i", span=span)
    return at.select("path", (F.col("__i") + 1).alias("line_no"), "severity", "text")


def write_reports(report: DataFrame, target: str) -> None:
    """One directory of text lines per path, in order; a long report is split over several files."""
    part = F.expr(f"line_no DIV {LINES_PER_FILE}")
    (
        report.withColumn("part", part).repartition("path", "part").sortWithinPartitions("path", "part", "line_no")
        .select("path", "part", F.col("text").alias("value"))
        .write.mode("overwrite").partitionBy("path", "part").text(target)
    )


def write_report_files(report: DataFrame, target: str, overwrite: bool = False) -> None:
    """One text file per path, named after it with .txt behind: its lines in order, each with its end of line.

    A path's lines are sorted by Spark, which spills, and streamed into its file. A leading slash is left out.
    """
    name = F.concat(F.regexp_replace(F.col("path").cast("string"), "^/+", ""), F.lit(".txt"))
    rows = report.repartition("path").sortWithinPartitions("path", "line_no")
    write_files(rows.select(name.alias("name"), F.encode(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), "UTF-8").alias("content")), target, overwrite)


def write_report_rows(report: DataFrame, target: str) -> None:
    """The same lines as one sorted parquet table, for corpora with more files than directories are good for."""
    part = F.expr(f"line_no DIV {LINES_PER_FILE}")
    (
        report.withColumn("part", part).repartition("path", "part").sortWithinPartitions("path", "part", "line_no")
        .drop("part").write.mode("overwrite").parquet(target)
    )
