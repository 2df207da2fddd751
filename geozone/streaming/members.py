"""Members of zones kept up on a stream of placements and withdrawals.

The state is the last change of each member of a zone. Each micro-batch writes the changes it made to a table of versions, and then the
lines of the zones it touched, in the text form of the exchange; other zones keep the lines they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geozone.sources.zone_members import LINE_MEMBERS, zone_members
from geozone.streaming.aggregate import BATCH, latest_versions

# What a change does (fixed values).
PLACED = "placed"
WITHDRAWN = "withdrawn"

STATE = "zone string, member bigint, change string, at timestamp"
LINES = "zone string, line_no bigint, n_members bigint, line string"


def start_zone_members(changes: DataFrame, path: str, checkpoint: str, line_members: int = LINE_MEMBERS, **trigger) -> StreamingQuery:
    """Keep `(zone, member)` up to date below `path` from `changes (zone, member, change, at)`.

    `change` is `placed` or `withdrawn`; of several changes of a member in a zone the one with the latest `at` counts, whenever it
    comes; at equal times a withdrawal. Rows without zone, member, time or a known change are left out. `current_members` gives the
    members, `current_lines` the lines of `zone_members`.

    The state has a row per (zone, member) that was ever named; for much of it choose the RocksDB state store. A repeated
    micro-batch overwrites its own folders. Lines are made anew for zones that the micro-batch changed, from all their members.
    """
    known = changes.select("zone", F.col("member").cast("bigint").alias("member"), "change", F.col("at").cast("timestamp").alias("at"))
    known = known.filter(F.col("change").isin(PLACED, WITHDRAWN)).dropna()
    # `withdrawn` is the greater of the two texts.
    last = known.groupBy("zone", "member").agg(F.max(F.struct("at", "change")).alias("last"))
    state = last.select("zone", "member", "last.change", "last.at")

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{path}/members/{BATCH}={batch_id}")
        touched = spark.read.schema(STATE).parquet(f"{path}/members/{BATCH}={batch_id}").select("zone").distinct()
        members = current_members(spark, path).join(touched, "zone", "left_semi")
        lines = zone_members(members, line_members=line_members)
        # A zone that lost its last member has an empty line, so that its former lines are out of date.
        gone = touched.join(members.select("zone").distinct(), "zone", "left_anti")
        gone = gone.select("zone", F.lit(0).cast("bigint").alias("line_no"), F.lit(0).cast("bigint").alias("n_members"), F.lit(None).cast("string").alias("line"))
        lines.unionByName(gone).write.mode("overwrite").parquet(f"{path}/lines/{BATCH}={batch_id}")

    writer = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def current_members(spark: SparkSession, path: str) -> DataFrame:
    """`(zone, member)` as of the last micro-batch."""
    schema = spark.createDataFrame([], STATE).schema
    newest = latest_versions(spark, f"{path}/members", ["zone", "member"], schema)
    return newest.filter(F.col("change") == PLACED).select("zone", "member")


def current_lines(spark: SparkSession, path: str) -> DataFrame:
    """`(zone, line_no, n_members, line)`: each zone's lines from the last micro-batch that touched it; zones without members are absent."""
    lines = spark.read.schema(f"{LINES}, {BATCH} bigint").parquet(f"{path}/lines")
    newest = lines.groupBy("zone").agg(F.max(BATCH).alias(BATCH))
    return lines.join(newest, ["zone", BATCH], "left_semi").filter("n_members > 0").select("zone", "line_no", "n_members", "line")
