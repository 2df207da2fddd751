"""Positions of rows inside their group, without one task per group.

`row_number()` over a window puts a whole group in one task, and one group may hold a third of all rows. So the rows are
dealt by range over group and order columns together, with Spark's own sampled bounds, and sorted inside each range. The
bounds follow the data, whatever its type: an outlier, a common beginning of all texts or a value that most rows share
does not fill a range, since the later columns cut inside it. The sorted rows are written once, each with its place; a
position is that place, less the group's first place in the range, plus the rows of the group in the ranges before. The
sample only decides how even the ranges are; written once, they are the same for every reader and for a repeated task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geozone.session import written

# Rows of a range, and how many ranges there are at most for each partition of a shuffle.
PIECE_ROWS = 1 << 12
MOST_PIECES = 16

_COUNT = "__n"
_OFFSET = "__offset"
_WITHIN = "__within"
_AT = "__at"
_PIECE = "__piece"
# Bits below the partition number in `monotonically_increasing_id` (fixed value).
_PLACE_BITS = 33


def ordinal(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    out: str = "ord",
    total: str | None = None,
    bucket: Sequence[str] | None = None,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Add `out`, the 0-based BIGINT position of each row in its group by `order`, and `total`, the group size.

    Rows with a null group column belong to no group and are left out. `order` should be unique in a group: rows that
    are equal in it share a range and come in any sequence. Its columns may be of any type that can be sorted; nulls come first.
    Groups may have any size; an empty table gives no rows.

    This runs jobs: `df` is counted, sampled and sorted into a table in the shared folder, so it is read three times; write
    it to a table first if it is costly. The result reads the sorted table; up to `piece_rows` rows in all are numbered as they are.

    `bucket` names columns that already cut the rows into bounded pieces in the sequence of the order, coarse
    to fine, such as file and block of a line; then nothing is written and no job runs.
    """
    group, order = list(group), list(order)
    for name in group:
        df = df.filter(F.col(name).isNotNull())
    if bucket is not None:
        return _by_piece(df, group, order, out, total, list(bucket))
    n_rows = df.count()
    if n_rows <= piece_rows:
        # One range at most, so the window over a group is no larger than a range.
        size = [F.count(F.lit(1)).over(_partition(group)).alias(total)] if total else []
        return short_ordinal(df, group, order, out).select(*df.columns, out, *size)
    placed = in_ranges(df, [*group, *order], n_rows, piece_rows).withColumn(_PIECE, F.shiftright(_AT, _PLACE_BITS))
    counts = placed.groupBy(*group, _PIECE).agg(F.count(F.lit(1)).alias(_COUNT), F.min(_AT).alias("__first"))
    scope = _partition(group)
    before = F.sum(_COUNT).over(scope.orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1))
    size = [F.sum(_COUNT).over(scope).alias(total)] if total else []
    shift = (F.coalesce(before, F.lit(0)) - F.col("__first")).alias(_OFFSET)
    position = (F.col(_AT) + F.col(_OFFSET)).alias(out)
    found = placed.join(counts.select(*group, _PIECE, shift, *size), [*group, _PIECE])
    return found.select(*df.columns, position, *([total] if total else []))


def in_ranges(df: DataFrame, order: Sequence[str], n_rows: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """`df`, of `n_rows` rows, as a table sorted by `order` in even ranges; `__at` holds the range above the place inside it."""
    pieces = min(n_rows // piece_rows + 1, MOST_PIECES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = df.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    return written(ranges.withColumn(_AT, F.monotonically_increasing_id()), "ranges")


def short_ordinal(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "ord") -> DataFrame:
    """As `ordinal`, lazily and in one task per group: for lists whose length does not grow with the data."""
    number = F.row_number().over(_partition(list(group)).orderBy(*order)).cast("bigint") - 1
    return df.dropna("any", subset=list(group)).withColumn(out, number) if group else df.withColumn(out, number)


def list_sizes(numbered: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Size per numbered list; `numbered` has one row per position."""
    return numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


# --- pieces that are given ------------------------------------------------------------------------------------


def _by_piece(
    df: DataFrame, group: list[str], order: list[str], out: str, total: str | None, pieces: list[str]
) -> DataFrame:
    keys = group + pieces
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_COUNT))
    offsets = _offsets(counts, group, pieces, total)
    columns = df.columns
    numbered = df.withColumn(_WITHIN, F.row_number().over(_partition(keys).orderBy(*order)).cast("bigint") - 1)
    position = (F.col(_WITHIN) + F.col(_OFFSET)).alias(out)
    return numbered.join(offsets, keys).select(*columns, position, *([total] if total else []))


def _offsets(counts: DataFrame, group: list[str], pieces: list[str], total: str | None) -> DataFrame:
    """Rows of the group before each piece. Each level sums inside the next coarser piece only."""
    outer, finest = group + pieces[:-1], pieces[-1]
    scope = _partition(outer)
    before = F.sum(_COUNT).over(scope.orderBy(finest).rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(before, F.lit(0))
    if len(pieces) == 1:
        size = [F.sum(_COUNT).over(scope).alias(total)] if total else []
        return counts.select(*outer, finest, before.alias(_OFFSET), *size)
    within = counts.select(*outer, finest, before.alias("__before"))
    coarser = counts.groupBy(*outer).agg(F.sum(_COUNT).alias(_COUNT))
    above = _offsets(coarser, group, pieces[:-1], total)
    return within.join(above, outer).select(
        *outer, finest, (F.col("__before") + F.col(_OFFSET)).alias(_OFFSET), *([total] if total else [])
    )


def _partition(columns: list[str]):
    return Window.partitionBy(*(columns or [F.lit(0)]))
