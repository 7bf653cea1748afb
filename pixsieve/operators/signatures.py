"""The compression-signature database and the edited-image verdict.

Signature rows: sig_id, is_user, valid, editor_class (camera|software|unsure), make, model, quality,
csig, csig_rot. Both hashes of a row count, so every lookup first turns a row into one row per hash;
lookups are then equi joins that the optimizer may broadcast or shuffle by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = ["make", "model", "sig"]


def hash_keys(sigs: DataFrame, *columns: str) -> DataFrame:
    """One row per (columns, sig) and hash, plain or rotated, without repeats."""
    hashes = F.explode(F.array_distinct(F.array("csig", "csig_rot"))).alias("sig")
    return sigs.select(*columns, hashes).where(F.col("sig").isNotNull()).distinct()


def exact_hits(images: DataFrame, builtin: DataFrame) -> DataFrame:
    """Images whose make, model and signature (plain or rotated) are in the built-in table."""
    return images.join(hash_keys(builtin, "make", "model"), MATCH, "left_semi")


def trim_known(user: DataFrame, builtin: DataFrame) -> DataFrame:
    """User rows that the built-in table does not already hold under their plain signature."""
    known = hash_keys(builtin, "make", "model").withColumnRenamed("sig", "csig")
    return user.join(known, ["make", "model", "csig"], "left_anti")


def no_makernote_expected(images: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Images whose make is listed with an empty model, or with a prefix of the model up to ``*``."""
    e = exceptions.select(F.col("make"), F.substring_index("model", "*", 1).alias("__prefix")).distinct()
    return images.alias("i").join(
        e.alias("e"),
        (F.col("i.make") == F.col("e.make")) & F.startswith(F.col("i.model"), F.col("__prefix")),
        "left_semi",
    )


def always_edited(images: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Images whose make is listed with an empty model, or with exactly this model."""
    e = exceptions.select(F.col("make"), F.col("model").alias("__model")).distinct()
    return images.alias("i").join(
        e.alias("e"),
        (F.col("i.make") == F.col("e.make")) & ((F.col("__model") == "") | (F.col("i.model") == F.col("__model"))),
        "left_semi",
    )


def contains_any(text: Column, markers) -> Column:
    """Case-sensitive containment of any marker; an empty or missing text never matches."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers]), F.lit(False))


def first_marker(text: Column, markers) -> Column:
    """First listed marker found inside the text, null when none is."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in markers])


def union_tables(builtin: DataFrame, user: DataFrame) -> DataFrame:
    return builtin.withColumn("is_user", F.lit(False)).unionByName(
        user.withColumn("is_user", F.lit(True)), allowMissingColumns=True
    )


def count_signatures(sigs: DataFrame) -> DataFrame:
    """Built-in, user and total counts, in one pass."""
    one = sigs.agg(
        F.count_if(~F.col("is_user")).alias("builtin"),
        F.count_if(F.col("is_user")).alias("user"),
        F.count(F.lit(1)).alias("total"),
    )
    return one.select(F.expr("stack(3, 'builtin', builtin, 'user', user, 'total', total) AS (kind, n)"))


def keep_listed(sigs: DataFrame, remaining_ids: DataFrame) -> DataFrame:
    """Logical delete: a user row stays valid only while its id is still listed; nothing is dropped."""
    ids = remaining_ids.select("sig_id").distinct().withColumn("__listed", F.lit(True))
    return (
        sigs.join(ids, "sig_id", "left")
        .withColumn("valid", F.when(F.col("is_user"), F.col("__listed").isNotNull()).otherwise(F.col("valid")))
        .drop("__listed")
    )


def source_of_choice(choice: Column) -> Column:
    """Source class of a prompt answer: 0 camera, 1 software, anything else unsure."""
    return F.when(choice == 0, "camera").when(choice == 1, "software").otherwise("unsure")


def append_user(sigs: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Append user rows (make, model, quality, csig, csig_rot, source, user_software), made consistent.

    A camera row carries no software text, a software row no make and model, an unsure row keeps both.
    """
    is_cam, is_sw = F.col("source") == "camera", F.col("source") == "software"
    rows = new_rows.select(
        "sig_id",
        F.lit(True).alias("is_user"),
        F.lit(True).alias("valid"),
        F.when(is_cam | is_sw, F.col("source")).otherwise("unsure").alias("editor_class"),
        F.when(is_sw, "").otherwise(F.col("make")).alias("make"),
        F.when(is_sw, "").otherwise(F.col("model")).alias("model"),
        "quality",
        "csig",
        "csig_rot",
        F.lit("").alias("sw_trim"),
        F.when(is_cam, "").otherwise(F.col("user_software")).alias("sw_disp"),
    )
    return sigs.unionByName(rows, allowMissingColumns=True)


def verdicts(images: DataFrame, sigs: DataFrame, is_edit: DataFrame, no_makernote: DataFrame, markers) -> DataFrame:
    """Edited verdict and suggested database action per image.

    images: image_id, make, model, sig, software, has_makernote. Signature matches are counted per
    hash before the join, so an image never meets more than one row however common its hash is.
    """
    live = sigs.where("valid")
    sw = (
        live.where("editor_class = 'software'")
        .select("sig_id", F.explode(F.array_distinct(F.array("csig", "csig_rot"))).alias("sig"))
        .groupBy("sig").agg(F.count(F.lit(1)).alias("n_software"))
    )
    cam = (
        live.where("editor_class = 'camera'")
        .select("make", "model", F.explode(F.array_distinct(F.array("csig", "csig_rot"))).alias("sig"))
        .groupBy(*MATCH).agg(F.count(F.lit(1)).alias("n_camera"))
    )
    edit = is_edit.where(
        (F.col("make") == F.col("i.make").outer())
        & ((F.col("model") == "") | (F.col("model") == F.col("i.model").outer()))
    ).exists()
    no_mkr = no_makernote.select("make", F.substring_index("model", "*", 1).alias("prefix")).where(
        (F.col("make") == F.col("i.make").outer())
        & F.startswith(F.col("i.model").outer(), F.col("prefix"))
    ).exists()
    flagged = images.alias("i").select("i.*", edit.alias("exc_edit"), no_mkr.alias("exc_mkr"))
    hits = flagged.join(cam, MATCH, "left").join(sw, "sig", "left").fillna(0, ["n_software", "n_camera"])
    s, c = F.col("n_software") > 0, F.col("n_camera") > 0
    return hits.select(
        "image_id",
        "n_software",
        "n_camera",
        F.when(F.col("exc_edit"), "YES")
        .when(contains_any(F.col("software"), markers), "YES")
        .when(s & ~c, "YES")
        .when(s & c, "UNSURE")
        .when(c & ~F.col("has_makernote") & ~F.col("exc_mkr"), "YESPROB")
        .when(c, "NO")
        .when(F.coalesce(F.col("make"), F.lit("")) == "", "YESPROB")
        .otherwise("UNSURE")
        .alias("edited"),
        F.when(s | c, "unset")
        .when(contains_any(F.col("software"), markers), "software")
        .when(F.coalesce(F.col("make"), F.lit("")) == "", "unset")
        .otherwise("camera")
        .alias("db_action"),
    )
