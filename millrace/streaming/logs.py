"""Training logs as a stream: new files are parsed into metrics and kept by (file, step)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.sqltext import log_metric

METRICS = ("loss", "epoch", "step", "learning_rate", "grad_norm")


def metrics_of(lines: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """One row for each line that states the loss or a step; batch or streaming."""
    parsed = lines.select("*", *[log_metric(F.col("value"), n).alias(n) for n in names])
    return parsed.where(F.coalesce(*map(F.col, names)).isNotNull())


def follow(spark: SparkSession, folder: str, *, files_per_trigger: int = 100) -> DataFrame:
    """The lines of files as they come into ``folder``; each file is read once, whole."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines.withColumns({"file": F.col("_metadata.file_path"), "seen": F.current_timestamp()})


def append_metrics(stream: DataFrame, target: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Writes metrics to Parquet, exactly once; ``every`` is a trigger interval, without it what is there is read and the query ends."""
    writer = metrics_of(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start(target)


def per_window(events: DataFrame, *, time_col: str, keys: tuple[str, ...], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, keys, n: counts in tumbling windows; events later than ``late`` are dropped by the watermark."""
    w = F.window(F.col(time_col), size)
    return events.withWatermark(time_col, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def latest(metrics: DataFrame, *, order_col: str = "step", names: tuple[str, ...] = METRICS) -> DataFrame:
    """The last stated value of each metric, by ``order_col``, and how many rows there are."""
    return metrics.agg(*[F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.col(order_col))).alias(n) for n in names], F.count(F.lit(1)).alias("total"))
