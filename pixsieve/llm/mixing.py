"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Targets: sources weigh 5, 2, 1, repeating in code-point order (null last) and share the words of the whole corpus; a
target stops at `max_epochs` times its source, the excess goes to the others by weight. The water level of that sharing
is found in one pass over the sources sorted by cap per weight, without iteration.

Copies: a source's documents stand in a fixed hash order; every document is taken floor(target / source) times, and once
more while the words before it stay below the fractional rest. The running sum over a source is two-level: sums per hash
bucket, then a window inside (source, bucket), so a hot source is spread over all its buckets.

Positions: the weight of a source at time t in [0, 1] runs linearly from `start` to `end` (relative density, integral 1),
so cumulative demand is D(t) = start * t + (end - start) * t^2 / 2. A copy whose first word is preceded by the share u of
its source's taken words stands at D^-1(u). Documents are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixsieve.llm.common import free_name, table, whole_text

WEIGHTS = (5, 2, 1)
#: Relative density at the start of training for the first, second and third kind of weight; it ends at 2 minus that.
STARTS = (0.5, 1.0, 1.5)
MAX_EPOCHS = 3
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """id, source, size (words of the whole text), h (hash order), bucket; with carry the whole row too."""
    text = whole_text(text_col)
    # no word holds a byte of the set, so words = places where one begins
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), 0)).cast("long")
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), h.alias("h"),
        F.conv(F.substring(h, 1, 3), 16, 10).cast("int").alias("bucket"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []),
    )


def targets(sized: DataFrame) -> DataFrame:
    """Per source: source, source_size, kind (0, 1, 2), weight, target. One row per source is all that a task holds."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.select(
        "*", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)).alias("kind"),
    ).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("kind") + 1).cast("long"))
    cap = F.col("source_size") * MAX_EPOCHS
    # sorted by cap per weight, the capped sources are the first ones: level k shares what the first k-1 caps leave over
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.select(
        "*", F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("capped"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("capped_weight"),
    )
    share = (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("capped_weight"))
    below = level.withColumn("share", F.when(share * F.col("weight") < cap, share))
    water = F.min("share").over(everything)  # the level of the first source that stays below its cap
    first = F.first("share", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return below.select(
        "source", "source_size", "kind", "weight",
        F.when(F.col("share").isNotNull() & water.isNotNull(), F.col("weight") * first).otherwise(cap).cast("double").alias("target"),
    )


def taken_copies(docs: DataFrame, carry: bool = False, **names: str) -> DataFrame:
    """id, source, size, source_size, kind, target, done (words of the source before it, per full pass), copies; with carry the row."""
    sized = sizes(docs, carry=carry, **names)
    goals = targets(sized.drop("row"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .drop("s", "b")
    )
    goals = goals.withColumnRenamed("source", "goal_source")
    done = F.col("base") + F.col("within")
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - whole * F.col("source_size")
    copies = F.when(F.col("source_size") == 0, 1).otherwise(whole + F.when(done + F.col("size") / 2 < rest, 1).otherwise(0))
    return placed.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).select(
        "id", "source", "size", "source_size", "kind", "target", done.alias("done"), copies.cast("long").alias("copies"),
        *(["row"] if carry else []),
    )


def position(u: Column, start: Column) -> Column:
    """Time at which a source of this starting density has been asked for the share u of its words."""
    slope = (F.lit(1.0) - start) * 2
    root = F.sqrt(start * start + slope * u * 2)
    return F.when(slope == 0, u).otherwise((root - start) / slope)


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per taken copy with its training position, range-sorted by position: id, source, copy, size, position, the row if carried."""
    copy = mixed.where("copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    passed = F.col("done") + (F.col("copy") - 1) * F.col("source_size")
    u = F.when(F.col("target") > 0, F.least(F.lit(1.0), passed / F.col("target"))).otherwise(0.0)
    start = F.element_at(F.array(*map(F.lit, STARTS)), F.col("kind") + 1)
    placed = copy.select("id", "source", "copy", "size", position(u, start).alias("position"), *(["row"] if "row" in mixed.columns else []))
    return placed.repartitionByRange("position", "id", "copy").sortWithinPartitions("position", "id", "copy")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents of the mix, one row per taken copy, with all their columns, in training order.

    Documents not taken are absent. The extra columns mix_copy and mix_position come last.
    """
    mixed = taken_copies(docs, carry=True, id_col=id_col, text_col=text_col, source_col=source_col)
    names = [free_name(docs, x) for x in ("mix_copy", "mix_position")]
    return training_order(mixed).select("row.*", F.col("copy").alias(names[0]), F.col("position").alias(names[1]))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, the words the mix takes of it, and its first position.

    A null text has size 0; a null source is a source of its own, the last; a document of size 0 takes nothing. An empty
    table gives no rows. Rows that repeat an id count each for itself.
    """
    mixed = taken_copies(table(spark, sf_dir, "documents"))
    start = F.element_at(F.array(*map(F.lit, STARTS)), F.col("kind") + 1)
    u = F.when(F.col("target") > 0, F.least(F.lit(1.0), F.col("done") / F.col("target"))).otherwise(0.0)
    first = F.when(F.col("copies") > 0, position(u, start))
    out = mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        "copies", F.round(first, 6).alias("first_position"),
    )
    return out.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM per),
weighed AS (SELECT *, CASE kind WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
level AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER w, 0) AS capped, coalesce(sum(weight) OVER w, 0) AS capped_weight
  FROM weighed WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shared AS (
  SELECT *, CAST(total - capped AS DOUBLE) / CAST(weights - capped_weight AS DOUBLE) AS share FROM level),
flagged AS (SELECT *, share * weight < 3 * source_size AS below FROM shared),
goals AS (
  SELECT source, source_size, kind,
         CAST(CASE WHEN below THEN weight * (SELECT share FROM flagged WHERE below
                ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST LIMIT 1)
              ELSE 3 * source_size END AS DOUBLE) AS target
  FROM flagged),
placed AS (
  SELECT s.*, g.source_size, g.kind, g.target,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS done
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
copied AS (
  SELECT *, CAST(CASE WHEN source_size = 0 THEN 1 ELSE floor(target / source_size)
         + CASE WHEN done + size / 2.0 < target - floor(target / source_size) * source_size THEN 1 ELSE 0 END END AS BIGINT) AS copies
  FROM placed),
timed AS (
  SELECT *, CASE kind WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS st,
         CASE WHEN target > 0 THEN least(1.0::DOUBLE, done / target) ELSE 0.0::DOUBLE END AS u FROM copied)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
       CASE WHEN copies > 0 THEN round(CASE WHEN (1.0 - st) * 2 = 0 THEN u ELSE (sqrt(st * st + (1.0 - st) * 2 * u * 2) - st) / ((1.0 - st) * 2) END, 6) END AS first_position
FROM timed
"""
QUERIES = {"op6_mixing": op6_mixing}
ORACLES = {"op6_mixing": SQL}
