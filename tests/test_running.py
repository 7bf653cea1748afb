"""The span-wise running aggregates against plain Python, with spans small enough to be crossed."""

import random

import pytest
from pyspark.sql import functions as F

from pixsieve.operators import chains as ch
from pixsieve.plans import inputs as inp
from pixsieve.running import row_index, running

SF = "/root/testdata/sf0.001"


def reference(rows, fn, inclusive, reverse):
    out = {}
    for key in {r[0] for r in rows}:
        seq = sorted((r for r in rows if r[0] == key), key=lambda r: r[1], reverse=reverse)
        seen = []
        for k, s, v in seq:
            if inclusive:
                seen.append(v)
            vals = [x for x in seen if x is not None]
            out[k, s] = sum(vals) if fn == "sum" else (None if not vals else min(vals) if fn == "min" else max(vals))
            if not inclusive:
                seen.append(v)
    return out


@pytest.mark.parametrize("fn", ["sum", "min", "max"])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
def test_running_matches_plain_python(spark, fn, inclusive, reverse):
    rng = random.Random(7)
    seqs = rng.sample(range(-50, 900), 300)
    # key 0 holds two thirds of the rows
    rows = [(0 if i % 3 else 1 + i % 5, s, rng.choice([None, rng.randint(-9, 9)])) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "k INT, s BIGINT, v BIGINT")
    got = running(df, ["k"], "s", {"r": (fn, F.col("v"))}, inclusive=inclusive, reverse=reverse, span=16)
    assert {(r.k, r.s): r.r for r in got.collect()} == reference(rows, fn, inclusive, reverse)


def test_row_index_counts_from_zero(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), (F.col("id") * 3).alias("s"))
    got = row_index(df, ["k"], "s", span=10).orderBy("k", "s").collect()
    assert [r.idx for r in got] == list(range(50)) * 2


SPANS = {
    "dc": lambda c, s: ch.dc_values(c, span=s).select("path", "seq", "dc"),
    "restart": lambda c, s: ch.restart_check(c, span=s),
    "overrun": lambda c, s: ch.restart_overruns(c, 4, span=s),
    "cap": lambda c, s: ch.report_cap(c.withColumn("text", F.col("severity")), 9),
    "offsets": lambda c, s: ch.record_offsets(c, 12, {"a": 2, "b": 4}, span=s).select("path", "seq", "a", "b"),
    "bits": lambda c, s: ch.bit_positions(c, span=s).select("path", "seq", "byte", "bit"),
    "items": lambda c, s: ch.encapsulated_items(
        c.select("path", "seq", F.when(F.col("is_rst"), "end").when(F.col("is_error"), "start").otherwise("item").alias("kind")), span=s),
    "blocks": lambda c, s: ch.dc_values(c, span=s).select("path", "seq", "rst_seg", "comp_block"),
    "coef_reset": lambda c, s: ch.coefficient_index(c, ["path"], F.col("zrl") == 0, reset=F.col("is_rst"), span=s),
    "runs_reset": lambda c, s: ch.expand_runs(c.select("path", "seq", "is_rst", (F.col("bits2") - 5).alias("run"), F.col("comp").alias("val")), ["path"], reset=F.col("is_rst"), span=s),
    "mcus": lambda c, s: ch.mcu_map(c, 8, span=s),
    "cut": lambda c, s: ch.cut_after_bad(c.select("path", "seq", "zrl"), F.col("zrl") == 6, span=s),
    "audit": lambda c, s: ch.record_audit(c.select("path", "seq", F.col("rec_len").alias("declared"), (F.col("rec_len") + F.when(F.col("zrl") == 3, 1).otherwise(0)).alias("consumed")), span=s),
    "coef": lambda c, s: ch.coefficient_index(c, ["path"], F.col("zrl") == 0, span=s),
    "huff": lambda c, s: ch.huffman_codes(c.select("path", "seq", F.col("bits1").alias("bitlen"), F.col("rst").alias("value")), span=s),
    "runs": lambda c, s: ch.expand_runs(c.select("path", "seq", (F.col("bits2") - 5).alias("run"), F.col("comp").alias("val")), ["path"], span=s),
}


@pytest.mark.parametrize("name", sorted(SPANS))
def test_results_do_not_depend_on_the_span(spark, name):
    # one path holds most of the rows
    c = inp.codes(spark, SF).withColumn("path", F.when(F.col("seq") % 3 == 0, F.col("path")).otherwise(F.lit(0).cast("bigint"))).cache()
    small, plain = SPANS[name](c, 13), SPANS[name](c, None)
    want = sorted(map(str, plain.collect()))
    assert want and sorted(map(str, small.collect())) == want
    assert sorted(map(str, SPANS[name](c, 1 << 18).collect())) == want
    c.unpersist()


def test_marked_ranges_meet_their_rows_by_spans(spark):
    from pixsieve.operators import chains

    rows = spark.range(5000).selectExpr("CASE WHEN id < 4900 THEN 'hot' ELSE concat('p', id % 7) END AS path", "id AS idx")
    marks = spark.createDataFrame(
        [("hot", 4000, 37), ("hot", 64, 127), ("hot", 64, 64), ("hot", -5, 3), ("hot", -9, -1), ("hot", None, 5), ("p1", 4950, 10**12 // 10**7), ("other", 0, 9)], "path STRING, a LONG, b LONG")
    got = chains.mcu_range(rows, marks, "idx", span=64)
    ends = [(m.path, [x for x in (m.a, m.b) if x is not None]) for m in marks.collect()]  # a mark alone is a range of one
    want = sorted((r.path, r.idx) for r in rows.collect() for path, own in ends if path == r.path and min(own) <= r.idx <= max(own))
    assert sorted((r.path, r.idx) for r in got.collect()) == want and got.columns == ["path", "idx"]
    plan = got.hint("merge")._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "path" in join and "__span" in join
    # the rows of the one hot path lie in as many join keys as it has spans
    assert rows.where("path = 'hot'").selectExpr("idx DIV 64 AS s").distinct().count() > 70
