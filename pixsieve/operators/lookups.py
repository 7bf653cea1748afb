"""Code-to-name lookups as joins by key.

The constant dimensions are local rows, whose size the optimizer knows exactly, so it broadcasts them;
a registry handed in as a table is broadcast or shuffled by its own size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixsieve.sources.dims import marker_name_column


def single_codes(dim: DataFrame) -> DataFrame:
    """Range dimension (code, code_end or 0, name, ordinal) to one row per code; the first listed wins.

    Codes are 16-bit, so this has at most 65,536 rows however the ranges overlap.
    """
    last = F.when(F.col("code_end") == 0, F.col("code")).otherwise(F.col("code_end"))
    each = dim.select(F.explode(F.sequence("code", last)).alias("code"), "name", "ordinal")
    return each.groupBy("code").agg(F.min_by("name", "ordinal").alias("name"))


def name_codes(rows: DataFrame, code: str, dim: DataFrame) -> DataFrame:
    """Add name: the record whose single code or inclusive range holds the code, null when none."""
    names = single_codes(dim).withColumnRenamed("code", "__code")
    return rows.join(names, F.col(code) == F.col("__code"), "left").drop("__code")


def name_iptc(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Add name and type for (record, dataset); unknown ones are '?' of type UNK."""
    out = rows.join(dim, ["record", "dataset"], "left")
    return out.withColumns({"name": F.coalesce("name", F.lit("?")), "type": F.coalesce("type", F.lit("UNK"))})


def iptc_value(kind: Column, data: Column) -> Column:
    """Value text by type: number (big-endian, up to 8 bytes), hex list, quoted text, or ???."""
    hexed = F.hex(data)
    number = F.when(F.length(data) <= 8, F.coalesce(F.conv(hexed, 16, 10), F.lit("0")))
    listed = F.concat(F.lit("["), F.regexp_replace(hexed, "(..)", "0x$1 "), F.lit("]"))
    return (
        F.when(kind == "NUM", number).when(kind == "HEX", listed)
        .when(kind == "STR", F.concat(F.lit('"'), F.decode(data, "ISO-8859-1"), F.lit('"'))).otherwise("???")
    )


def name_dicom(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Add name and known for (grp, elem): element 0 is always a group length, others may be unknown."""
    d = dim.select("grp", "elem", F.col("name").alias("__name"))
    out = rows.join(d, ["grp", "elem"], "left")
    group_length = F.format_string("Group Length (Group=%04X)", "grp")
    unknown = F.format_string("??? (%04X,%04X)", "grp", "elem")
    name = F.coalesce("__name", F.when(F.col("elem") == 0, group_length).otherwise(unknown))
    return out.withColumns({"name": name, "known": F.col("__name").isNotNull() | (F.col("elem") == 0)}).drop("__name")


def describe_dicom(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Add text: the meaning of an enumerated (grp, elem, value), null when it has none."""
    return rows.join(dim, ["grp", "elem", "value"], "left")


def hex_word(value: Column) -> Column:
    """A 32-bit number as four hex bytes and its printable characters."""
    digits = F.lpad(F.hex(value), 8, "0")
    chars = F.regexp_replace(F.decode(F.unhex(digits), "ISO-8859-1"), "[^\\x20-\\x7e]", ".")
    return F.concat(F.lit("0x"), F.regexp_replace(digits, "(..)", "$1 "), F.lit(" | "), chars)


def name_psd_enum(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Add text for (field, value); values without an entry are shown as a hex word."""
    out = rows.join(dim, ["field", "value"], "left")
    return out.withColumn("text", F.coalesce("text", hex_word(F.col("value"))))


def name_exif(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Add name and is_unknown for (section, tag_id)."""
    out = rows.join(dim, ["section", "tag_id"], "left")
    return out.withColumns({
        "is_unknown": F.col("name").isNull(),
        "name": F.coalesce("name", F.format_string("Unknown Tag 0x%04X", "tag_id")),
    })


def hide_unknown(tags: DataFrame, hide: bool = True) -> DataFrame:
    return tags.where(~F.col("is_unknown")) if hide else tags


def name_markers(rows: DataFrame, code: str = "code") -> DataFrame:
    return rows.withColumn("marker", marker_name_column(F.col(code)))
