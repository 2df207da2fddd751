"""Zone -> members exchange, text format `zone;1,2,3` (fixed format).

A zone may have many lines; readers add them up. So a zone with very many members is written as several lines
of bounded length and no task ever holds all of its members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geozone.functions.text import check_on_error, split_fields
from geozone.operators.ordinal import ordinal

# Members per line.
LINE_MEMBERS = 10_000


def zone_members(
    df: DataFrame,
    zone: str = "zone",
    member: str = "member",
    order: str | None = None,
    line_members: int = LINE_MEMBERS,
) -> DataFrame:
    """Members per zone in the order of placement (`order`, then the member), as `(zone, line_no, n_members, line)`.

    Line number i of a zone holds its members `[i * line_members, (i + 1) * line_members)`. Zones without
    members are absent.
    """
    placed = df.filter(F.col(member).isNotNull()).select(
        F.col(zone).alias("zone"), F.col(member).alias("member"), F.col(order or member).alias("at")
    )
    numbered = ordinal(placed, ["zone"], ["at", "member"] if order else ["at"])
    numbered = numbered.withColumn("line_no", F.floor(F.col("ord") / line_members))
    listed = F.sort_array(F.collect_list(F.struct("ord", F.col("member").cast("string").alias("member"))))
    lines = numbered.groupBy("zone", "line_no").agg(F.count(F.lit(1)).alias("n_members"), listed.alias("listed"))
    text = F.concat("zone", F.lit(";"), F.concat_ws(",", "listed.member"))
    return lines.select("zone", "line_no", "n_members", text.alias("line"))


def write_zone_members(df: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Write the members of each zone as text; by default lines are added to what is there."""
    zone_members(df, **options).select(F.col("line").alias("value")).write.mode(mode).text(path)


def parse_zone_members(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """`(zone, member)` from a frame with the text in `value`.

    Lines that do not have exactly two parts are left out. A member that is no whole number fails the query,
    or is left out with `on_error="skip"`.
    """
    check_on_error(on_error)
    parts = lines.select(split_fields(F.col("value"), ";").alias("parts")).filter(F.size("parts") == 2)
    entries = parts.select(F.get("parts", 0).alias("zone"), F.explode(split_fields(F.get("parts", 1), ",")).alias("text"))
    number = F.col("text").try_cast("bigint")
    if on_error == "skip":
        return entries.select("zone", number.alias("member")).filter(F.col("member").isNotNull())
    broken = F.raise_error(F.concat(F.lit("not a member number: "), "text")).cast("bigint")
    return entries.select("zone", F.coalesce(number, broken).alias("member"))


def read_zone_members(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    return parse_zone_members(spark.read.text(path), on_error)
