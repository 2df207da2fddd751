"""Latency matrices in text form: a header line of zone names, then one comma-separated row per zone.

Row i holds the latencies from zone i, cell j the latency to zone j (fixed format). Cells and rows that are
missing count as 0. A folder may hold one file per snapshot.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geozone.functions.text import check_on_error, split_fields
from geozone.operators.ordinal import ordinal
from geozone.sources.lines import before_blank, read_lines

SCHEMA = "snapshot string, from_zone string, to_zone string, latency double"


def parse_latency_matrix(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """`(snapshot, from_zone, to_zone, latency)` from lines, one row per ordered pair of zones of a file.

    Names are taken as they are, numbers may have blanks around them. Of a repeated name the first place
    counts. A row or cell beyond the header, or a cell that is no number, fails the query; with
    `on_error="skip"` surplus is left out and such a cell counts as 0.
    """
    check_on_error(on_error)
    numbered = ordinal(before_blank(lines), ["file"], ["line"], out="row", bucket=["block"])
    cells = split_fields(F.col("value"), ",")
    header = numbered.filter(F.col("row") == 0).select("file", F.posexplode(cells).alias("idx", "zone"))
    zones = header.groupBy("file", "zone").agg(F.min("idx").alias("idx"))
    width = header.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("n_zones"))

    rows = numbered.filter(F.col("row") > 0).select("file", (F.col("row") - 1).alias("idx"), "value", cells.alias("cells"))
    rows = rows.join(width, "file")
    surplus = (F.size("cells") > F.col("n_zones")) | (F.col("idx") >= F.col("n_zones"))
    if on_error == "fail":
        broken = F.raise_error(F.concat(F.lit("more rows or cells than zones: "), "value")).cast("boolean")
        rows = rows.filter(F.when(surplus, broken).otherwise(F.lit(True)))

    padded = F.transform(
        F.sequence(F.lit(0), F.col("n_zones") - 1),
        lambda j: F.coalesce(_number(F.get("cells", j), on_error), F.lit(0.0)),
    )
    # Zones whose row is missing keep a null row here, and so get zeros.
    grid = (
        zones.select("file", "idx", F.col("zone").alias("from_zone"))
        .join(rows.select("file", "idx", "cells"), ["file", "idx"], "left")
        .join(width, "file")
        .select("file", "from_zone", F.posexplode(padded).alias("idx", "latency"))
    )
    to = zones.select("file", "idx", F.col("zone").alias("to_zone"))
    return grid.join(to, ["file", "idx"]).select(F.col("file").alias("snapshot"), "from_zone", "to_zone", "latency")


def read_latency_matrices(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """All matrices below `path`. A missing path gives an empty table: then no zone is known."""
    try:
        lines = read_lines(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    return parse_latency_matrix(lines, on_error)


def write_latency_matrix(latency: DataFrame, path: str, mode: str = "error") -> None:
    """Write one matrix file per snapshot below `path`, in folders `snapshot=...`.

    `latency` has `(snapshot, from_zone, to_zone, latency)`. Zones stand in name order; a missing pair is 0.
    """
    names = latency.select("snapshot", F.explode(F.array("from_zone", "to_zone")).alias("zone")).distinct()
    header = names.groupBy("snapshot").agg(F.sort_array(F.collect_set("zone")).alias("zones"))
    cells = latency.groupBy("snapshot", "from_zone").agg(
        F.map_from_entries(F.collect_list(F.struct("to_zone", F.col("latency").cast("string")))).alias("cells")
    )
    rows = (
        names.withColumnRenamed("zone", "from_zone")
        .join(cells, ["snapshot", "from_zone"], "left")
        .join(header, "snapshot")
        .select(
            "snapshot",
            F.col("from_zone").alias("at"),
            F.concat_ws(
                ",", F.transform("zones", lambda z: F.coalesce(F.try_element_at("cells", z), F.lit("0")))
            ).alias("value"),
        )
    )
    # The header sorts before every name.
    text = header.select("snapshot", F.lit(None).cast("string").alias("at"), F.concat_ws(",", "zones").alias("value"))
    lines = text.unionByName(rows).repartition("snapshot").sortWithinPartitions("snapshot", F.col("at").asc_nulls_first())
    lines.select("snapshot", "value").write.mode(mode).partitionBy("snapshot").text(path)


def _number(cell: Column, on_error: str) -> Column:
    number = cell.try_cast("double")
    if on_error == "skip":
        return number
    broken = F.raise_error(F.concat(F.lit("not a number: "), cell)).cast("double")
    return F.when(cell.isNotNull() & number.isNull(), broken).otherwise(number)
