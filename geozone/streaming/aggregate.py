"""The local and global stage on streams, by event time.

State is bounded by the watermark in both stages. A local stage may run in update mode into a versioned
table, which also shows windows that are still open; the chained global stage runs in append mode and shows
closed windows. The complete global result, open windows included, comes from the newest versions of partial rows:
`stream_partial`, `start_versions`, `latest_versions`, `local_rows`, `global_agg`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

from geozone.functions.measures import Measures, finished, merges, partial_names
from geozone.operators.aggregate import WINDOW, zone_local_agg
from geozone.session import require_utc

BATCH = "batch_id"
# The batch that a compacted row comes from.
VERSION = "version__"
# Late rows of a window, and the newest time of a partial row.
LATE = "n_late"
_NEWEST = "newest__"


def stream_zone_local_agg(
    events: DataFrame, zone: str, keys: Sequence[str], measures: Measures, ts: str, width: str, delay: str
) -> DataFrame:
    """Local partial rows per window, zone and keys; rows later than `delay` behind the newest are dropped.

    `ts` is a timestamp, or a zoneless timestamp taken as UTC.
    """
    require_utc(events.sparkSession)
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return zone_local_agg(timed, zone, keys, measures, ts, width)


def stream_global_agg(local: DataFrame, keys: Sequence[str], measures: Measures, width: str) -> DataFrame:
    """Merge streaming local rows over all zones, chained in the same query (append mode)."""
    merged = local.groupBy(F.window(F.window_time(WINDOW), width).alias(WINDOW), *keys).agg(*merges(measures, local.columns))
    return stream_result(merged, keys, measures)


def stream_result(partial: DataFrame, keys: Sequence[str], measures: Measures) -> DataFrame:
    """Finished values of streaming partial rows, window limits as zoneless timestamps."""
    limits = [
        F.col(f"{WINDOW}.{side}").cast("timestamp_ntz").alias(f"window_{side}") for side in ("start", "end")
    ]
    return partial.select(*limits, *keys, *finished(measures, partial.columns))


def stream_partial(partial: DataFrame, keys: Sequence[str], measures: Measures) -> DataFrame:
    """Streaming partial rows as they are, to be merged later, window limits as zoneless timestamps."""
    limits = [
        F.col(f"{WINDOW}.{side}").cast("timestamp_ntz").alias(f"window_{side}") for side in ("start", "end")
    ]
    return partial.select(*limits, *keys, *partial_names(measures, partial.columns))


def start_versions(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the changed rows of each micro-batch (update mode) to `path/batch_id=n`.

    A repeated micro-batch overwrites its own folder, so the table has each version once.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def latest_versions(spark: SparkSession, path: str, by: Sequence[str], schema: StructType | None = None) -> DataFrame:
    """The newest version of each row of a table written by `start_versions`.

    `schema` is that of the rows; with it no file is opened to find it out. `compact_versions` keeps the table small.
    """
    if schema is None:
        reader = spark.read.option("basePath", path).option("mergeSchema", "true")
        versions = reader.parquet(f"{path}/{BATCH}=*")
    else:
        added = [StructField(VERSION, LongType()), StructField(BATCH, LongType())]
        versions = spark.read.schema(StructType([*schema.fields, *added])).parquet(path)
    return _newest(versions, by).drop(VERSION)


def _newest(versions: DataFrame, by: Sequence[str]) -> DataFrame:
    """The newest version of each row, its number in VERSION. Compacted rows carry it, others are in the folder of their batch."""
    values = [c for c in versions.columns if c not in (*by, BATCH, VERSION)]
    version = F.coalesce(VERSION, BATCH) if VERSION in versions.columns else F.col(BATCH)
    newest = versions.withColumn(VERSION, version.cast("bigint")).groupBy(*by).agg(
        # A batch that was repeated after a compaction comes before its compacted rows.
        F.max_by(F.struct(*values), F.struct(VERSION, BATCH)).alias("newest"), F.max(VERSION).alias(VERSION)
    )
    return newest.select(*by, "newest.*", VERSION)


def compact_versions(spark: SparkSession, path: str, by: Sequence[str]) -> None:
    """Rewrites a table of versions with the newest version of each row only.

    The rows go to a folder of their own, numbered below all batches, and keep the number of the batch they come from. The
    folders they were read from are removed only when it is complete; where that is cut short, both are there, and the
    newest version of each row is the same. So nothing is lost at any point, and a batch that the stream repeats afterwards
    finds its place as before. Batches written meanwhile stay. Not for two compactions at a time.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [entry.getPath().getName() for entry in files.listStatus(folder) if entry.isDirectory()]
    names = [name for name in names if name.startswith(f"{BATCH}=")]
    if not names:
        return
    reader = spark.read.option("basePath", path).option("mergeSchema", "true")
    versions = reader.parquet(*[f"{path}/{name}" for name in names])
    number = min(0, *[int(name.split("=")[1]) for name in names]) - 1
    _newest(versions, by).write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
    for name in names:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)


def local_rows(versions: DataFrame) -> DataFrame:
    """Rows of a versioned table of partial rows as `zone_local_agg` has them, for `global_agg`."""
    window = F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end")).alias(WINDOW)
    return versions.select(window, *[c for c in versions.columns if c not in ("window_start", "window_end")])


def start_append(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream to parquet files in append mode."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def start_corrected(
    events: DataFrame, zone: str, keys: Sequence[str], measures: Measures, ts: str, width: str, delay: str, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Write the local partial rows of each micro-batch to `path/batch_id=n`, late ones too, with the number of late rows in `n_late`.

    A row is late if its window ended more than `delay` before the newest row of the batches before; the rows of a window are late
    together. Where a watermark would drop them uncounted, they are corrections here: partial rows are merged, not
    replaced, so a row may come at any time and the query keeps no state. A repeated micro-batch overwrites its own
    folder and looks at earlier folders only. `corrected_rows` reads the table.
    """
    require_utc(events.sparkSession)
    added = {LATE: ("count", "*"), _NEWEST: ("max", ts)}
    seen = StructType([StructField(_NEWEST, TimestampNTZType()), StructField(BATCH, LongType())])

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        timed = rows.withColumn(ts, F.col(ts).cast("timestamp").cast("timestamp_ntz"))
        local = zone_local_agg(timed, zone, keys, {**measures, **added}, ts, width)
        mark = None
        if batch_id > 0:
            before = spark.read.schema(seen).parquet(path).filter(F.col(BATCH) < batch_id)
            mark = before.agg((F.max(_NEWEST) - F.expr(f"interval {delay}")).alias("mark")).first().mark
        late = F.col(f"{WINDOW}.end") <= F.lit(mark).cast("timestamp_ntz")
        local = local.withColumn(LATE, F.when(late, F.col(LATE)).otherwise(F.lit(0).cast("bigint")))
        local.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def corrected_rows(spark: SparkSession, path: str) -> DataFrame:
    """Local partial rows of `start_corrected`, corrections included, for `global_agg`; `n_late` is a measure `("sum", "n_late")`."""
    return spark.read.option("basePath", path).parquet(f"{path}/{BATCH}=*").drop(_NEWEST, BATCH)
