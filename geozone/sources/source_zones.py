"""Source -> zones, text format `source;zone1,zone2` (fixed format)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geozone.functions.text import check_on_error, split_fields
from geozone.operators.ordinal import ordinal
from geozone.sources.lines import before_blank, read_lines

# Zones per line.
LINE_ZONES = 10_000


def parse_source_zones(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """`(source, zone, zone_ord)` from lines.

    A repeated source goes on numbering its zones, repeated zones are kept, and a file ends at its first empty
    line. A line without zones fails the query, or is left out with `on_error="skip"`.
    """
    check_on_error(on_error)
    parts = before_blank(lines).withColumn("__parts", split_fields(F.col("value"), ";"))
    complete = F.size("__parts") >= 2
    if on_error == "skip":
        parts = parts.filter(complete)
    zones = split_fields(F.get("__parts", 1), ",")
    if on_error == "fail":
        broken = F.raise_error(F.concat(F.lit("no zones in line: "), "value")).cast("array<string>")
        zones = F.when(complete, zones).otherwise(broken)
    entries = parts.select(
        "file", "block", "line", F.get("__parts", 0).alias("source"), F.posexplode(zones).alias("pos", "zone")
    )
    numbered = ordinal(entries, ["source"], ["line", "pos"], out="zone_ord", bucket=["file", "block"])
    return numbered.select("source", "zone", F.col("zone_ord").cast("int").alias("zone_ord"))


def read_source_zones(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    return parse_source_zones(read_lines(spark, path), on_error)


def write_source_zones(
    source_zones: DataFrame, path: str, mode: str = "error", line_zones: int = LINE_ZONES
) -> None:
    """Write the text format: the zones of a source in order, at most `line_zones` per line.

    Lines are sorted over all files, so reading the folder numbers the zones as before.
    """
    cut = source_zones.withColumn("line", F.floor(F.col("zone_ord") / line_zones))
    zones = F.sort_array(F.collect_list(F.struct("zone_ord", "zone")))
    lines = cut.groupBy("source", "line").agg(zones.alias("zones")).orderBy("source", "line")
    text = F.concat("source", F.lit(";"), F.concat_ws(",", "zones.zone"))
    lines.select(text.alias("value")).write.mode(mode).text(path)
