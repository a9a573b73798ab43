"""Files that keep arriving: each micro-batch is routed by row type, validated and appended by import, rejects aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.csv_import import allocations, mass_casualties, routed, validated


def ingest(spark: SparkSession, source: str, columns: list[str], to: str, checkpoint: str) -> StreamingQuery:
    """Run over all files that are there, and end. A batch that is run again replaces what it wrote."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    stream = spark.readStream.schema(schema).options(sep=";", header=True, escape="\\").csv(source)

    def batch(df: DataFrame, number: int) -> None:
        parts = routed(df)
        typed = allocations(parts["allocations"]).persist()  # both writes use it
        valid, rejects = validated(typed)
        untyped = parts["untyped"].select(F.array(F.struct(F.lit("row").alias("field"), F.lit("has no known type").alias("reason"), F.lit(None).cast("string").alias("value"))).alias("messages"), F.to_json(F.struct(*df.columns)).alias("row"))
        for name, rows in (("valid", valid), ("rejects", rejects.select("messages", "row").unionByName(untyped)), ("mass_casualties", mass_casualties(parts["mass_casualties"]))):
            rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{to}/{name}")
        typed.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Requests by hour and route of an event stream; rows later than ``late`` are not waited for."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")
