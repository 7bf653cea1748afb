"""Tables whose rows become files are dealt over tasks by their rows, not by the bytes of the scan."""

import pytest
from pyspark.sql import functions as F

from pixsieve.plans import inputs as inp
from pixsieve.plans import camera_plans, nested_plans, packed, payload_plans, picture_plans


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Parts in one file, one key null and one twice."""
    d = str(tmp_path_factory.mktemp("tables"))
    k = F.when(F.col("id") == 7, F.lit(None)).when(F.col("id") == 9, F.lit(8)).otherwise(F.col("id"))
    spark.range(1, 501, numPartitions=1).select(
        k.alias("p_partkey"), F.concat(F.lit("name "), "id").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL TIN").alias("p_type"),
        (F.col("id") % 50 + 1).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"),
    ).write.parquet(f"{d}/part.parquet")
    return d


def test_spread_deals_rows_evenly(spark, tables, monkeypatch):
    monkeypatch.setattr(inp, "TASK_ROWS", 50)
    dealt = inp.spread(spark, tables, "part")
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) <= 60
    assert sorted(dealt.collect(), key=str) == sorted(inp.table(spark, tables, "part").collect(), key=str)


@pytest.mark.parametrize("build", [nested_plans.movie_files, nested_plans.nested_files, nested_plans.endless_tags, packed.psd_files, payload_plans.resource_files, packed.exif_files, packed.dicom_files, picture_plans.psd_pixels, camera_plans.camera_files])
def test_files_are_packed_and_walked_by_many_tasks(spark, tables, monkeypatch, build):
    few = build(spark, tables)
    monkeypatch.setattr(inp, "TASK_ROWS", 50)
    many = build(spark, tables)
    assert "Repartition 10, true" in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
