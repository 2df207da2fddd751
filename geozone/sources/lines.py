"""Text lines that keep their place in the file, so that files need not be read whole by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a frame of lines: `block` grows through a file, `line` grows through a block.
COLUMNS = ("file", "block", "line", "value")


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Lines of text files as `(file, block, line, value)`.

    A block is one split of a file; inside a split Spark reads lines in order, so the row id grows with them.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def as_lines(df: DataFrame, value: str, line: str, file: str | None = None, block_lines: int = 1_000_000) -> DataFrame:
    """Lines from a table that has the text in `value` and a whole number per line in `line`."""
    number = F.col(line).cast("bigint")
    return df.select(
        (F.col(file).cast("string") if file else F.lit("")).alias("file"),
        F.floor(number / block_lines).alias("block"),
        number.alias("line"),
        F.col(value).alias("value"),
    )


def before_blank(lines: DataFrame) -> DataFrame:
    """Lines of each file before its first empty line."""
    at = F.struct("block", "line")
    stops = lines.filter(F.col("value") == "").groupBy("file").agg(F.min(at).alias("__stop"))
    kept = lines.join(stops, "file", "left").filter(F.col("__stop").isNull() | (at < F.col("__stop")))
    return kept.select(*COLUMNS)
