"""Running aggregates that stay bounded when one key holds most of the rows.

A plain ``sum(x) OVER (PARTITION BY path ORDER BY seq)`` sorts a whole path in one task. Here the
order column is cut into fixed spans, so that a task never holds more than ``span`` rows of a key:

1. the aggregate runs inside each (key, span) group;
2. one value per (key, span), combined map-side, runs over the spans of a key;
3. that carry joins back on (key, span), which is the partitioning step 1 already has.

The order column must be an integer that is unique within a key, and keys must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = 1 << 18

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(fn: str, local: Column, carry: Column) -> Column:
    if fn == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return F.least(local, carry) if fn == "min" else F.greatest(local, carry)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    aggs: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    reverse: bool = False,
    span: int | None = SPAN,
) -> DataFrame:
    """Add one running aggregate per entry of ``aggs`` ({name: (sum|min|max, column)}).

    ``inclusive`` keeps the current row in the frame; ``reverse`` runs from the last row backwards.
    A sum over an empty frame is 0, a min or max over an empty frame is null. ``span=None`` is for keys
    whose rows are known to be few (say, they came out of one file): a plain window, one shuffle.
    """
    last = 0 if inclusive else -1
    by_row = F.col(order).desc() if reverse else F.col(order).asc()
    kept = [F.col(f"`{c}`") for c in df.columns if c not in aggs]
    if span is None:
        frame = W.partitionBy(*keys).orderBy(by_row).rowsBetween(W.unboundedPreceding, last)
        return df.select(*kept, *[_closed(fn, _AGG[fn](c).over(frame)).alias(n) for n, (fn, c) in aggs.items()])
    chunked = df.withColumn("__span", F.expr(f"CAST(`{order}` AS BIGINT) DIV {span}"))
    by_span = F.col("__span").desc() if reverse else F.col("__span").asc()
    inside = W.partitionBy(*keys, "__span").orderBy(by_row).rowsBetween(W.unboundedPreceding, last)
    across = W.partitionBy(*keys).orderBy(by_span).rowsBetween(W.unboundedPreceding, -1)

    local = chunked.select("*", *[_AGG[fn](c).over(inside).alias(f"__l_{n}") for n, (fn, c) in aggs.items()])
    totals = chunked.groupBy(*keys, "__span").agg(*[_AGG[fn](c).alias(f"__t_{n}") for n, (fn, c) in aggs.items()])
    carry = totals.select(
        *keys, "__span", *[_AGG[fn](F.col(f"__t_{n}")).over(across).alias(f"__c_{n}") for n, (fn, _) in aggs.items()]
    )
    out = local.join(carry, [*keys, "__span"])
    return out.select(*kept, *[_combine(fn, F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n, (fn, _) in aggs.items()])


def _closed(fn: str, c: Column) -> Column:
    return F.coalesce(c, F.lit(0)) if fn == "sum" else c


def segmented(
    df: DataFrame,
    keys: list[str],
    order: str,
    reset: Column,
    aggs: dict[str, tuple[str, Column]],
    *,
    seg: str,
    within: str | None = None,
    whole: dict[str, tuple[str, Column]] | None = None,
    inclusive: bool = True,
    span: int | None = SPAN,
) -> DataFrame:
    """Running aggregates that start again at every ``reset`` row, in one pass.

    Adds ``seg`` (number of resets up to and with the row), the ``aggs`` inside (keys, within, seg) and the
    ``whole`` ones inside (keys, within). ``within`` is a column of few values, such as a component.

    The span totals are what is left open at the end of a span: the part behind its last reset. A
    span's carry is what earlier spans left open in the segment that is running when it starts.
    """
    whole = whole or {}
    sub = [within] if within else []
    last = 0 if inclusive else -1
    every = {**aggs, **whole}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in every and c != seg]
    r = F.when(reset, F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    def frame(*part):
        return W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, last)

    if span is None:
        at = df.withColumn(seg, F.sum(r).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
        return at.select(
            *kept, seg,
            *[_closed(fn, _AGG[fn](c).over(frame(*keys, *sub, seg))).alias(n) for n, (fn, c) in aggs.items()],
            *[_closed(fn, _AGG[fn](c).over(frame(*keys, *sub))).alias(n) for n, (fn, c) in whole.items()],
        )

    marked = df.select(
        "*", r.alias("__r"), F.expr(f"CAST(`{order}` AS BIGINT) DIV {span}").alias("__span"), *[c.alias(f"__x_{n}") for n, (_, c) in every.items()]
    )
    local = marked.withColumn("__seg", F.sum("__r").over(W.partitionBy(*keys, "__span").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    local = local.select(
        "*",
        *[_AGG[fn](f"__x_{n}").over(frame(*keys, "__span", *sub, "__seg")).alias(f"__l_{n}") for n, (fn, _) in aggs.items()],
        *[_AGG[fn](f"__x_{n}").over(frame(*keys, "__span", *sub)).alias(f"__l_{n}") for n, (fn, _) in whole.items()],
    )

    group = W.partitionBy(*keys, "__span")
    ends = marked.select(
        *keys, *sub, "__span", *[f"__x_{n}" for n in every], F.sum("__r").over(group).alias("__n"),
        (F.col(order) >= F.coalesce(F.max(F.when(F.col("__r") == 1, F.col(order))).over(group), F.col(order))).alias("__open"),
    )
    sums = ends.groupBy(*keys, *sub, "__span").agg(
        F.max("__n").alias("__n"),
        *[_AGG[fn](F.when(F.col("__open"), F.col(f"__x_{n}"))).alias(f"__t_{n}") for n, (fn, _) in aggs.items()],
        *[_AGG[fn](f"__x_{n}").alias(f"__t_{n}") for n, (fn, _) in whole.items()],
    )
    if sub:  # the resets of a span count once, not once per sub-key
        first = F.row_number().over(group.orderBy(*sub)) == 1
        sums = sums.withColumn("__once", F.when(first, F.col("__n")).otherwise(0))
    else:
        sums = sums.withColumn("__once", F.col("__n"))
    before = W.partitionBy(*keys).orderBy("__span").rangeBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*keys, *sub).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        "*", F.coalesce(F.sum("__once").over(before), F.lit(0)).alias("__base"),
        *[_AGG[fn](f"__t_{n}").over(earlier).alias(f"__c_{n}") for n, (fn, _) in whole.items()],
    )
    # each span asks for the segment it starts in (0) and leaves something in the one it ends in (1)
    asks = sums.select("*", F.inline(F.array(
        F.struct(F.lit(0).alias("__k"), F.col("__base").alias("__g")),
        F.struct(F.lit(1).alias("__k"), (F.col("__base") + F.col("__n")).alias("__g")))))
    same = W.partitionBy(*keys, *sub, "__g").orderBy("__span", "__k").rowsBetween(W.unboundedPreceding, -1)
    carry = asks.select(
        *keys, *sub, "__span", "__base", "__k",
        *[_AGG[fn](F.when(F.col("__k") == 1, F.col(f"__t_{n}"))).over(same).alias(f"__c_{n}") for n, (fn, _) in aggs.items()],
        *[f"__c_{n}" for n in whole],
    ).where("__k = 0")
    carried = F.struct(*[f"__c_{n}" for n in every])
    if sub:  # one row per span, so that the join keeps the partitioning of the windows
        carry = carry.groupBy(*keys, "__span").agg(
            F.max("__base").alias("__base"), F.map_from_entries(F.collect_list(F.struct(within, carried))).alias("__m"))
        got = F.try_element_at("__m", F.col(within))
    else:
        carry = carry.select(*keys, "__span", "__base", carried.alias("__m"))
        got = F.col("__m")
    out = local.join(carry, [*keys, "__span"]).withColumn("__got", got)
    running_on = F.col("__seg") == 0
    return out.select(
        *kept, (F.col("__base") + F.col("__seg")).alias(seg),
        *[_combine(fn, F.col(f"__l_{n}"), F.when(running_on, F.col(f"__got.__c_{n}"))).alias(n) for n, (fn, _) in aggs.items()],
        *[_combine(fn, F.col(f"__l_{n}"), F.col(f"__got.__c_{n}")).alias(n) for n, (fn, _) in whole.items()],
    )


def row_index(df: DataFrame, keys: list[str], order: str, name: str = "idx", span: int | None = SPAN) -> DataFrame:
    """Zero-based position of each row within its key, as a BIGINT."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, inclusive=False, span=span)
