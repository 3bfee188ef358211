"""The same transforms over streams: stateless projections, and accumulators with watermarked totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.plans.compiler import transform


def transform_stream(text: str, stream: DataFrame, custom=None) -> DataFrame:
    """A transform over a streaming DataFrame: one output per input row, no state."""
    return transform(text, stream, custom)


def read_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of text lines (column `value`) from the files that arrive at a path."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def totals(stream: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Accumulators of a stream: count and sum per key and window; state ends with the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def notation_events(lines: DataFrame) -> DataFrame:
    """Lines of the typed notation as events: header, assignment, document, directive or blank, with path and value."""
    line = F.trim(F.col("value"))
    kind = F.when(line == "", "blank").when(F.startswith(line, F.lit(";")), "comment").when(line == "---", "document").when(F.startswith(line, F.lit("{")), "header").when(F.rlike(line, F.lit("^[@:]")), "directive").when(F.contains(line, F.lit("=")), "assignment").otherwise("row")
    return lines.select(kind.alias("event"), F.when(kind == "assignment", F.trim(F.substring_index(line, "=", 1))).when(kind == "header", F.regexp_extract(line, r"^\{(.*)\}$", 1)).alias("path"), F.when(kind == "assignment", F.trim(F.regexp_extract(line, "^[^=]*=(.*)$", 1))).alias("text"))
