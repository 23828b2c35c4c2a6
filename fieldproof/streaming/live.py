"""Live accuracy over a growing folder of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.score import score_long
from ..session import made_folder

SCHEMA = "run_id string, id string, field string, rule string, expected string, predicted string, error string, at timestamp"


def read(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """New JSON Lines files as they come, so many of them in a step."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(path)


def scored(rows: DataFrame, delay: str = "1 hour", unicode: bool = True) -> DataFrame:
    """Scored fields, each (run, document, field) once within the delay; the state is bounded by the watermark."""
    once = rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["run_id", "id", "field"])
    typed = once.withColumns({"expected": F.col("expected").cast("variant"), "predicted": F.col("predicted").cast("variant")})
    return score_long(typed, unicode)


def accuracy(rows: DataFrame, delay: str = "1 hour", unicode: bool = True) -> DataFrame:
    """Running correct and total by run and field (complete output mode)."""
    return scored(rows, delay, unicode).groupBy("run_id", "field").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))


def windowed(rows: DataFrame, width: str = "5 minutes", delay: str = "1 hour", unicode: bool = True) -> DataFrame:
    """Correct and total by run and window of time (append output mode)."""
    out = scored(rows, delay, unicode).groupBy(F.window("at", width), "run_id").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    return out.select("window.start", "window.end", "run_id", "correct", "total")


#: Columns of ``windowed``.
WINDOW = "start timestamp, end timestamp, run_id string, correct bigint, total bigint"


def caught_up(spark: SparkSession, source: str, target: str, progress: str, width: str = "5 minutes", delay: str = "1 hour", unicode: bool = True) -> DataFrame:
    """Everything that lies in the folder ``source`` now and has not been read before goes through ``windowed``; windows that the
    watermark has passed are appended to the Parquet table ``target``, which is returned. A later call goes on with the state
    and the offsets in ``progress``: a field read before counts once, and rows older than the watermark don't count.
    All three folders must be ones that the executors share."""
    for folder in (source, target):
        made_folder(spark, folder)
    out = windowed(read(spark, source), width, delay, unicode).writeStream.outputMode("append").format("parquet")
    out.option("path", target).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(WINDOW).parquet(target)
