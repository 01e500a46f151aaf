"""Run events as streams: snapshots once, progress, windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir

#: Weights of the stages of a run, in order; progress stays below the end until it is reached. Fixed values.
STAGES = {"ingest": 10, "index": 25, "eval": 40, "optimize": 15, "serve": 10}
MOST = 95


def event_stream(spark: SparkSession, sf_dir: str, schema: str) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


def once(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Snapshots without repeats of a key within the watermark, so that state stays bounded."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def after(events: DataFrame, cursor: int, seq: str = "event_id") -> DataFrame:
    """Events from a cursor on; the next cursor is the largest number seen and one."""
    return events.filter(F.col(seq) >= cursor)


def percent(stage: "F.Column") -> "F.Column":
    """Progress at a stage's end, capped."""
    total = 0
    out = F.when(F.lit(False), 0)
    for name, weight in STAGES.items():
        total += weight
        out = out.when(stage == name, min(total, MOST))
    return out.otherwise(0)


def windowed(stream: DataFrame, at: str, length: str, by: str, value: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window of event time and kind, late rows up to the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, at: str, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: events no further apart than the gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))


def drain(result: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming aggregate over what is there, and return its last state as a table in the shared folder."""
    spark = result.sparkSession
    root = f"{checkpoint_dir(spark)}/stream-{spark.sparkContext.applicationId}-{name}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out")

    q = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state-{spark.sparkContext._jvm.System.nanoTime()}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")
