"""Report on a placement: the items of each slot, then the zones of each group, in lines of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geozone.operators.ordinal import ordinal

# Sections in the order of the report.
SECTIONS = ["slot", "group"]
# Entries per line.
LINE_ENTRIES = 10_000


def placement_report(
    assigned: DataFrame, groups: DataFrame, item: str = "item", line_entries: int = LINE_ENTRIES
) -> DataFrame:
    """`(section, name, line_no, n, entries)` from `assigned (slot, item)` and `groups (grp, zone)`.

    A slot's lines list its items in their order, a group's lines its distinct zones by name, `line_entries` at most in
    each, `n` of them; so no task holds all items of a slot. Slots and groups without entries are absent.
    """
    slots = assigned.select(F.col("slot").cast("string").alias("name"), F.col(item).alias("entry"))
    zones = groups.select(F.col("grp").cast("string").alias("name"), F.col("zone").alias("entry")).distinct()
    return _lines("slot", slots, line_entries).unionByName(_lines("group", zones, line_entries))


def _lines(section: str, entries: DataFrame, line_entries: int) -> DataFrame:
    numbered = ordinal(entries.filter(F.col("entry").isNotNull()), ["name"], ["entry"])
    line_no = F.floor(F.col("ord") / line_entries).alias("line_no")
    listed = F.sort_array(F.collect_list(F.struct("ord", F.col("entry").cast("string").alias("entry"))))
    lines = numbered.groupBy("name", line_no).agg(F.count(F.lit(1)).alias("n"), listed.alias("listed"))
    text = F.concat_ws(",", "listed.entry").alias("entries")
    return lines.select(F.lit(section).alias("section"), "name", "line_no", "n", text)


def report_lines(report: DataFrame) -> DataFrame:
    """The report as text lines in `value`, in order: a heading for each section, then `name<TAB>entries` lines."""
    place = lambda c: F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), c)
    headings = report.select("section").distinct().select(
        place(F.col("section")).alias("at"), F.lit("").alias("name"), F.lit(-1).cast("bigint").alias("line_no"), _heading().alias("value")
    )
    body = report.select(
        place(F.col("section")).alias("at"), "name", "line_no", F.concat_ws("\t", "name", "entries").alias("value")
    )
    return headings.unionByName(body).orderBy("at", "name", "line_no").select("value")


def _heading() -> Column:
    return F.concat(F.lit("# "), "section")


def write_placement_report(report: DataFrame, path: str) -> None:
    """Add the report to the text files in `path`."""
    report_lines(report).write.mode("append").text(path)
