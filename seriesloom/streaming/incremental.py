"""Structured Streaming: windowed series and stateful delay vectors from an unbounded source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.runtime import cut, shared_folder


def source(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder as a stream of its rows."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)


def drain(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there, exactly once, into the shared folder; the result as a batch table."""
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={k}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    # the result moves under a checkpoint, so that state and output can go
    result = cut(spark.read.parquet(out))
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return result.drop("batch") if "batch" in result.columns else result


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly count and mean by event type; rows later than the watermark no longer open a closed window."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "mean")


def delay_vectors(events: DataFrame, tau: int = 1, dim: int = 3) -> DataFrame:
    """Delay vectors of each user's values in order of time; the state holds the last (dim - 1) * tau values."""
    keep = (dim - 1) * tau

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        df = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        rows = []
        for event, value in zip(df.event_id, df.value):
            past.append(float(value))
            if len(past) > keep:
                rows.append((key[0], int(event), [past[-1 - k * tau] for k in range(dim)]))
                past = past[-keep:] if keep else []
        state.update((past,))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "v"])

    e = events.filter("user_id is not null and value is not null and ts is not null").select("user_id", "event_id", "ts", "value")
    return e.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, v array<double>", "past array<double>", "append", "NoTimeout")
