"""Structured Streaming forms of the operators that are incremental by contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import with_normalized
from ..storage import shared_folder as shared_folder
from . import state


def read_snapshots(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """A stream over dated snapshot files, in order of their times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_seen(stream: DataFrame, url: str = "url", watermark: str | None = None, event_time: str = "ts") -> DataFrame:
    """Each normalised URL once. With a watermark, state is bounded and copies are dropped within it."""
    rows = with_normalized(stream, url).where("normalized_url is not null")
    if watermark:
        return rows.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["normalized_url"])
    return rows.dropDuplicates(["normalized_url"])


def accumulate_into(stream: DataFrame, target: str, checkpoint: str, url: str = "url", date: str = "snapshot_date", watermark: str | None = None, event_time: str = "ts"):
    """Earliest date of each URL whatever the order of arrival.

    The first date is state by URL, and a batch writes the URLs whose date is new or falls. Readers take the minimum
    (read_accumulated); a repeated batch writes the same folder again, and the target can be compacted at any time.
    With a watermark, which event_time carries, URLs are forgotten once it has passed them.
    """
    extra = [event_time] if watermark else []
    distinct = with_normalized(stream.select(F.col(url).alias("url"), F.col(date).alias("first_snapshot_date"), *extra)).where("normalized_url is not null")
    spark = stream.sparkSession
    processor = state.Earliest("normalized_url", "first_snapshot_date", event_time, state.retention(watermark, spark))
    changed = state.by_key(distinct.select("normalized_url", "first_snapshot_date", *extra), "normalized_url", processor, "normalized_url string, first_snapshot_date string", watermark, event_time)
    return _written(changed, target, checkpoint)


def _written(changed: DataFrame, target: str, checkpoint: str):
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    with state.keyed_store(changed.sparkSession):
        return changed.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_accumulated(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("normalized_url").agg(F.min("first_snapshot_date").alias("first_snapshot_date"))


def register_into(stream: DataFrame, target: str, checkpoint: str, key: str = "snapshot_id", digest: str | None = None, watermark: str | None = None, event_time: str = "ts"):
    """Append records of new ids; a repeated batch writes the same folder again.

    Ids are keyed state, so no batch reads what earlier ones wrote. With digest, an id that comes again, in one batch or
    in a later one, must have the digest that it had; another one ends the stream with an error. With a watermark, ids
    are forgotten once it has passed them.
    """
    processor = state.Registered(stream.columns, digest, event_time, state.retention(watermark, stream.sparkSession))
    return _written(state.by_key(stream, key, processor, stream.schema, watermark, event_time), target, checkpoint)


def daily_rates(stream: DataFrame, event_time: str = "ts", delay: str = "1 day", size: str = "1 day") -> DataFrame:
    """Tumbling counts with a watermark for late rows."""
    window = F.window(event_time, size)
    return stream.withWatermark(event_time, delay).groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Run a stream over what there is now into Parquet below folder."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
