"""A large bucket of the product dimension is written by several tasks."""

from pyspark.sql import functions as F

from clicklake.operators import dims
from clicklake.storage import shared_folder


def test_a_large_bucket_is_written_by_several_tasks(spark):
    rows = spark.range(60_000).select(F.lit(1).cast("long").alias("product_id"), "id", F.rand(1).alias("price"), F.timestamp_seconds("id").alias("event_timestamp"))
    rows = rows.selectExpr("product_id", "id as category_id", "'a' as category_level1", "'b' as brand", "price", "0 as discount_percent", "event_timestamp")
    path, before = shared_folder(spark, "dim"), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        dims.merge_products(spark, path, rows, 2)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    written = spark.read.parquet(f"{path}/rows")
    assert written.count() == 60_000 and written.select(F.input_file_name()).distinct().count() > 1
