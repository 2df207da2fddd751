"""Zones of sources, zones of members, and latencies between zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds of a piece of time in `latency_as_of`.
PIECE_SECONDS = 30 * 24 * 3600
# Returned for a pair with an unknown zone (fixed value).
UNKNOWN_LATENCY = -1


def tag_zones(
    df: DataFrame, source_col: str, source_zones: DataFrame, how: str = "inner", with_ord: bool = False
) -> DataFrame:
    """Give each row every zone of its source, one output row per zone.

    `source_zones` has `(source, zone, zone_ord)`. `inner` drops rows of unknown sources, `left` keeps them
    with a null zone. The join strategy is left to Spark: the zone table is broadcast only when Spark's own
    size estimate or runtime statistics allow it, else a hot source is split by adaptive skew handling.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is 'inner' or 'left', not {how!r}")
    wanted = ["zone", "zone_ord"] if with_ord else ["zone"]
    lookup = source_zones.select(F.col("source").alias("__source"), *wanted)
    return df.join(lookup, F.col(source_col) == F.col("__source"), how).drop("__source")


def zone_names(latency: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The known zones of a latency table, for each value of `by`."""
    return latency.select(*by, F.explode(F.array("from_zone", "to_zone")).alias("zone")).distinct()


def one_per_pair(latency: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per directed pair: of repeated pairs the largest latency counts."""
    return latency.groupBy(*by, "from_zone", "to_zone").agg(F.max("latency").alias("latency"))


def latency_of(
    df: DataFrame, latency: DataFrame, from_col: str, to_col: str, out: str = "latency", missing: int | None = None
) -> DataFrame:
    """Directed lookup of `latency` for each row.

    -1 where either zone is unknown, `missing` (null) where both are known but the pair was not measured. A repeated
    pair counts once, with its largest latency.
    """
    kind = latency.schema["latency"].dataType
    lookup = one_per_pair(latency).toDF("__from", "__to", "__latency")
    names = zone_names(latency)
    start = names.select(F.col("zone").alias("__start"))
    end = names.select(F.col("zone").alias("__end"))
    found = df.join(lookup, (F.col(from_col) == F.col("__from")) & (F.col(to_col) == F.col("__to")), "left")
    found = found.join(start, F.col(from_col) == F.col("__start"), "left").join(end, F.col(to_col) == F.col("__end"), "left")
    unknown = F.col("__start").isNull() | F.col("__end").isNull()
    value = F.when(unknown, F.lit(UNKNOWN_LATENCY).cast(kind)).otherwise(F.coalesce("__latency", F.lit(missing).cast(kind)))
    return found.select(*[df[c] for c in df.columns], value.alias(out))


def latency_as_of(
    df: DataFrame,
    snapshots: DataFrame,
    from_col: str,
    to_col: str,
    at_col: str,
    out: str = "latency",
    missing: int | None = None,
    piece_seconds: int = PIECE_SECONDS,
) -> DataFrame:
    """Directed lookup of the latency that was valid at each row's time: the last one measured at `at_col` or before.

    `snapshots` has `(from_zone, to_zone, at, latency)`; of repeated measurements of a pair at one time the largest counts. A
    measurement is valid until the next of its pair. -1 where either zone is in no snapshot, `missing` (null) where both
    are but the pair was not measured yet, or the row has no time. `at` and `at_col` are dates or timestamps.

    Time is cut into pieces of `piece_seconds`. A measurement is listed in each piece in which it is valid, up to the newest row's,
    so rows meet the list of their pair and piece by an equi join and take the last entry that is old enough: no range join, no
    sort of the rows, and a pair with a third of all rows is dealt by time (and split further by adaptive skew handling, since the
    lists are short). There are about as many lists as pairs times pieces; a list has the measurements of one piece
    and one more. The rows' times are read once more, for the newest.
    """
    kind = snapshots.schema["latency"].dataType
    width = piece_seconds * 1_000_000
    piece = lambda micros: F.floor(micros / F.lit(width)).cast("bigint")
    known = snapshots.filter(F.col("at").isNotNull()).groupBy("from_zone", "to_zone", _micros("at").alias("at"))
    measured = known.agg(F.max("latency").alias("latency"))
    pair = Window.partitionBy("from_zone", "to_zone").orderBy("at")
    newest = df.agg(F.max(_micros(at_col))).scalar()
    until = F.least(F.coalesce(F.lead("at").over(pair) - 1, newest), newest)
    valid = measured.withColumn("until", until).filter(F.col("until") >= F.col("at"))
    listed = valid.withColumn("__piece", F.explode(F.sequence(piece(F.col("at")), piece(F.col("until")))))
    entries = F.collect_list(F.struct("at", "latency")).alias("__entries")
    lists = listed.groupBy(F.col("from_zone").alias("__from"), F.col("to_zone").alias("__to"), "__piece").agg(entries)

    rows = df.withColumn("__at", _micros(at_col)).withColumn("__of", piece(F.col("__at")))
    same = (F.col(from_col) == F.col("__from")) & (F.col(to_col) == F.col("__to")) & (F.col("__of") == F.col("__piece"))
    old_enough = F.filter("__entries", lambda e: e["at"] <= F.col("__at"))
    found = rows.join(lists, same, "left").withColumn("__latency", F.array_max(old_enough)["latency"])
    names = zone_names(snapshots)
    start, end = names.toDF("__start"), names.toDF("__end")
    found = found.join(start, F.col(from_col) == F.col("__start"), "left").join(end, F.col(to_col) == F.col("__end"), "left")
    unknown = F.col("__start").isNull() | F.col("__end").isNull()
    value = F.when(unknown, F.lit(UNKNOWN_LATENCY).cast(kind)).otherwise(F.coalesce("__latency", F.lit(missing).cast(kind)))
    return found.select(*df.columns, value.alias(out))


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def observed_latency(
    df: DataFrame, from_col: str, to_col: str, value: str | Column, scale: int = 1000, by: Sequence[str] = ()
) -> DataFrame:
    """Latency table measured from rows: the mean of `value` per directed pair, times `scale`, rounded to BIGINT.

    With `by` there is one table per value of those columns.
    """
    mean = F.sum(value) / F.count(value)
    return df.groupBy(*by, F.col(from_col).alias("from_zone"), F.col(to_col).alias("to_zone")).agg(
        F.round(mean * scale).cast("bigint").alias("latency")
    )


def member_zone(members: DataFrame, order: str | None = None) -> DataFrame:
    """Invert zone -> members to one zone per member; of several zones the last one by `order` (zone name) wins."""
    members = members.filter(F.col("member").isNotNull())
    if order is None:
        return members.groupBy("member").agg(F.max("zone").alias("zone"))
    return members.groupBy("member").agg(F.max_by("zone", F.struct(order, "zone")).alias("zone"))
