"""Quality counts per event-time window over a stream of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from packwright.functions.value_types import VALUE_TYPES, is_missing, value_type


def stream_quality(stream: DataFrame, time: str, value: str, raw: str | Column, by: str,
                   minimum: float, maximum: float, window: str = "1 day",
                   delay: str = "1 hour") -> DataFrame:
    """``window_start, by, rows, nulls, out_of_range, raw_ints, raw_types`` per window and group.

    ``raw_types`` has the number of raw values of every type.

    The same expression runs over a batch table. State holds one row of counts
    per open window and group and is dropped once the watermark has passed.
    """
    types = {f.name: f.dataType for f in stream.schema.fields}
    zoneless = isinstance(types[time], TimestampNTZType)
    if zoneless:
        # A watermark needs an instant; the session's time zone is used both ways.
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    start = F.col("w.start").cast("timestamp_ntz") if zoneless else F.col("w.start")
    missing = is_missing(value, types[value])
    outside = ~missing & ((F.col(value) < F.lit(minimum)) | (F.col(value) > F.lit(maximum)))
    text = F.col(raw) if isinstance(raw, str) else raw
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("nulls"),
             F.count_if(outside).alias("out_of_range"),
             *[F.count_if(value_type(text) == t).alias(f"_{t}") for t in VALUE_TYPES])
        .select(start.alias("window_start"), by, "rows", "nulls", "out_of_range",
                F.col("_int").alias("raw_ints"),
                F.create_map(*[c for t in VALUE_TYPES for c in (F.lit(t), F.col(f"_{t}"))]).alias("raw_types"))
    )


def drop_repeats(stream: DataFrame, key: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all input that is there and stop; restarting continues from the checkpoint."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all input that is there and stop, writing the counts that each batch has changed.

    Windows still open at the end of the input are written as well, which appending
    leaves out; ``latest`` picks the last state of each. A batch that is run again
    replaces its own files, so every batch counts once.
    """
    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest(updates: DataFrame, key: list[str]) -> DataFrame:
    """The last written state of every key, from what ``run_updates`` wrote."""
    values = [c for c in updates.columns if c not in key and c != "batch"]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*key, "last.*")


def read_files(spark: SparkSession, path: str, schema, glob: str = "*.parquet",
               files_per_batch: int = 1000) -> DataFrame:
    """Stream of the Parquet files of a folder."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )
