"""A metric log read as a stream: tumbling windows by run with a watermark. Beyond the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.tables import table


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Count and sum of each run in each window; once the watermark has passed a window its state goes, and rows for it are left out."""
    seen = events.withWatermark("ts", late)
    return seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last state that a batch has written of each window."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("w", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select("w", "event_type", "s.n", "s.total")


def metrics_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table streamed once to its end; the windows' counts and means. Each batch writes the windows that it changed below the shared folder."""
    schema = table(spark, sf_dir, "events").schema
    place = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    seconds = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))")
    events = events.withColumn("ts", F.timestamp_millis(seconds))  # event times are taken as UTC whatever the session's zone

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/windows/batch={batch}")  # a batch that is run again replaces its own rows

    run = windowed(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    found = latest(spark, f"{place}/windows")
    return found.select(F.expr("timestampadd(DAY, cast(unix_seconds(w.start) div 86400 as int), timestamp_ntz'1970-01-01')").alias("window_start"), "event_type", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean_value"))
