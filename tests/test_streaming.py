"""The query log as a stream counts the same days as in batch."""

from pyspark.sql import functions as F

from quarry.sources.catalogue import queries_per_day
from quarry.streaming.query_log import daily_counts


def test_daily_counts(spark, tmp_path):
    hours = spark.range(200).select(
        F.concat(F.lit("q"), "id").alias("query"),
        F.timestamp_seconds(F.col("id") * 3600).alias("created_at"),
    )
    hours.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(hours.schema).parquet(str(tmp_path / "log"))
    run = (
        daily_counts(stream)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("per_day")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination(60)
    found = {(r.day, r.n_logs) for r in spark.table("per_day").collect()}
    assert found == {(r.day, r.n_logs) for r in queries_per_day(hours, None).collect()}
