"""Event-time windows and running counters over streams (and, with the same
functions, over batches)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.store import new_path


def with_event_time(df: DataFrame, time: str = "ts", late: str | None = None) -> DataFrame:
    """The time column as a timestamp (streams need one with a zone), with a
    watermark of ``late`` if given."""
    out = df.withColumn(time, F.col(time).cast("timestamp"))
    return out.withWatermark(time, late) if late else out


def _bounds(w: Column) -> list[Column]:
    return [w["start"].cast("timestamp_ntz").alias("window_start"), w["end"].cast("timestamp_ntz").alias("window_end")]


def windowed(df: DataFrame, size: str, slide: str | None = None, time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, window_end, key, n, total): tumbling windows, or sliding
    ones with ``slide``."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(*_bounds(F.col("w")), key, "n", "total")


def sessions(df: DataFrame, gap: str, time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, window_start, window_end, n): sessions closed by ``gap`` without an
    event."""
    return df.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, *_bounds(F.col("w")), "n")


def without_repeats(df: DataFrame, *keys: str) -> DataFrame:
    """Each key once; on a stream within its watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def read_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a glob, with the schema they have."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def run_to_table(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now, to its end. Every trigger replaces
    ('complete') or extends ('append') a table in the shared folder, whose
    state and progress are kept there too: a restart goes on where it stopped."""
    base = new_path(df.sparkSession, "stream")
    out, schema = f"{base}/out", df.schema

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(schema).parquet(out if mode == "complete" else f"{out}/*")
