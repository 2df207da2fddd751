"""Routing of live rows, without state: a stream joined with static target tables, or with tables that change meanwhile.

Target lists that change are published as versions. Each micro-batch takes the newest version at its first start and writes down
which one, before it routes; a repeated micro-batch reads that and so routes its rows alike, whatever was published since.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geozone.operators.routing import route_by_key, route_random

# Folders of a table of versions, of the versions chosen, and of the routed rows (fixed names).
VERSION = "list_version"
BATCH = "batch_id"
CHOSEN = "chosen"
ROUTED = "routed"


def route_stream(
    events: DataFrame,
    zone_col: str,
    lists: DataFrame,
    key_cols: Sequence[str] | None = None,
    row_id: Sequence[str] | None = None,
    seed: int = 0,
    hash: str = "xxhash64",
) -> DataFrame:
    """Route each streaming row by `key_cols`, or at random by `row_id`; append mode.

    `lists` comes from `target_lists` and must be static.
    """
    if not events.isStreaming:
        raise ValueError("route_stream takes a streaming frame; use route_by_key or route_random on tables")
    if lists.isStreaming:
        raise ValueError("the target lists must be static")
    _one_way(key_cols, row_id)
    return _routed(events, zone_col, lists, key_cols, row_id, seed, hash)


def _one_way(key_cols: Sequence[str] | None, row_id: Sequence[str] | None) -> None:
    if row_id is not None and key_cols is not None:
        raise ValueError("give key_cols or row_id, not both")


def _routed(df: DataFrame, zone_col: str, lists: DataFrame, key_cols, row_id, seed: int, hash: str) -> DataFrame:
    if row_id is not None:
        return route_random(df, zone_col, row_id, lists, seed, hash)
    return route_by_key(df, zone_col, key_cols, lists, hash)


# --- lists that change ----------------------------------------------------------------------------------------


def publish_lists(lists: DataFrame, path: str) -> int:
    """Write target lists (from `target_lists`) as the next version below `path`; gives its number, from 1.

    A version counts once it is complete; one that was cut short is written over by the next. Publish from one place at a time.
    """
    number = (newest_lists(lists.sparkSession, path) or 0) + 1
    lists.write.mode("overwrite").parquet(f"{path}/{VERSION}={number}")
    return number


def newest_lists(spark: SparkSession, path: str) -> int | None:
    """Number of the newest complete version, if there is one."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return None
    names = [entry.getPath().getName() for entry in files.listStatus(folder) if entry.isDirectory()]
    numbers = [int(name.split("=")[1]) for name in names if name.startswith(f"{VERSION}=")]
    return max((n for n in numbers if _complete(spark, f"{path}/{VERSION}={n}")), default=None)


def read_lists(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{VERSION}={version}")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, path: str) -> bool:
    mark, files = _folder(spark, f"{path}/_SUCCESS")
    return files.exists(mark)


def start_route_live(
    events: DataFrame,
    zone_col: str,
    lists: str,
    path: str,
    checkpoint: str,
    key_cols: Sequence[str] | None = None,
    row_id: Sequence[str] | None = None,
    seed: int = 0,
    hash: str = "xxhash64",
    **trigger,
) -> StreamingQuery:
    """Route each streaming row by the version of the lists below `lists` that is newest when its micro-batch first starts.

    Rows go to `path`, with the columns of `route_by_key` or `route_random` and the number of the version; `routed_rows` reads
    them. The version of each micro-batch is kept below `path` too, written before its rows. A micro-batch that is repeated
    takes the version kept and overwrites its own rows, so each row is there once and has the target it had. Without a
    published version the query fails.
    """
    if not events.isStreaming:
        raise ValueError("start_route_live takes a streaming frame; use route_by_key or route_random on tables")
    _one_way(key_cols, row_id)

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        version = _chosen(spark, lists, f"{path}/{CHOSEN}/{BATCH}={batch_id}")
        routed = _routed(rows, zone_col, read_lists(spark, lists, version), key_cols, row_id, seed, hash)
        routed = routed.withColumn(VERSION, F.lit(version).cast("bigint"))
        routed.write.mode("overwrite").parquet(f"{path}/{ROUTED}/{BATCH}={batch_id}")

    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def _chosen(spark: SparkSession, lists: str, kept: str) -> int:
    """The version kept for a micro-batch, or the newest one, which is kept from now on."""
    if _complete(spark, kept):
        return spark.read.parquet(kept).first()[0]
    version = newest_lists(spark, lists)
    if version is None:
        raise ValueError(f"no complete version of the target lists below {lists}")
    spark.range(1).select(F.lit(version).cast("bigint").alias(VERSION)).write.mode("overwrite").parquet(kept)
    return version


def routed_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `start_route_live`, each once, with `list_version`."""
    return spark.read.option("basePath", f"{path}/{ROUTED}").parquet(f"{path}/{ROUTED}/{BATCH}=*").drop(BATCH)
