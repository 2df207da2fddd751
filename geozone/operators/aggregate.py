"""Two-level aggregation: local results per zone, then one global result.

Local results are mergeable partial rows, so the global step and the side-by-side step read the few local
rows and never the raw rows again. All functions here also accept streaming frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geozone.functions.measures import Measures, finished, merges, partials

WINDOW = "window"


def zone_local_agg(
    df: DataFrame,
    zone: str,
    keys: Sequence[str],
    measures: Measures,
    ts: str | None = None,
    width: str | None = None,
) -> DataFrame:
    """Partial rows per (window,) zone and keys. `local_result` turns them into finished values."""
    by = [F.window(ts, width).alias(WINDOW)] if ts else []
    return df.groupBy(*by, zone, *keys).agg(*partials(measures, df))


def local_result(local: DataFrame, zone: str, keys: Sequence[str], measures: Measures) -> DataFrame:
    """Finished values of local partial rows."""
    return local.select(*_window_columns(local), zone, *keys, *finished(measures, local.columns))


def global_agg(local: DataFrame, keys: Sequence[str], measures: Measures) -> DataFrame:
    """Merge local partial rows over all zones and finish the values."""
    by = [WINDOW] if WINDOW in local.columns else []
    merged = local.groupBy(*by, *keys).agg(*merges(measures, local.columns))
    return merged.select(*_window_columns(merged), *keys, *finished(measures, local.columns))


def local_and_global(
    df: DataFrame,
    zone: str,
    keys: Sequence[str],
    measures: Measures,
    ts: str | None = None,
    width: str | None = None,
) -> DataFrame:
    """Local and global results side by side; `scope` tells which, `zone` is null in global rows.

    The raw rows are aggregated once; the grouping sets expand the local rows only.
    """
    local = zone_local_agg(df, zone, keys, measures, ts, width)
    by = ([WINDOW] if ts else []) + list(keys)
    both = local.groupingSets(
        [[F.col(zone), *[F.col(c) for c in by]], [F.col(c) for c in by]],
        F.col(zone),
        *[F.col(c) for c in by],
    ).agg(F.when(F.grouping(zone) == 1, F.lit("global")).otherwise(F.lit("local")).alias("scope"), *merges(measures, local.columns))
    return both.select("scope", *_window_columns(both), zone, *keys, *finished(measures, local.columns))


def _window_columns(df: DataFrame) -> list:
    if WINDOW not in df.columns:
        return []
    return [F.col(f"{WINDOW}.start").alias("window_start"), F.col(f"{WINDOW}.end").alias("window_end")]
