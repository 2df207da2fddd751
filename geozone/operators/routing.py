"""Zone-constrained routing: each row goes to a target in its own zone, by key hash or at random.

The targets of a zone form a numbered list. A row needs only the length of its list, to turn its hash into a
position, and then the one entry at that position. Both are equi joins, so neither a zone with very many
targets nor a zone with very many rows is ever gathered into one value or one task. The same functions take
streaming rows; the target tables are static.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geozone.functions.hashing import stable_hash
from geozone.operators.ordinal import list_sizes, ordinal
from geozone.operators.tagging import member_zone
from geozone.session import written

# Names of the lists: one per zone, and the fallback list of all targets (fixed values).
ZONE_LIST_PREFIX = "zone:"
ALL_TARGETS = "all"


def zone_list(zone: Column) -> Column:
    return F.concat(F.lit(ZONE_LIST_PREFIX), zone)


def target_lists(targets: DataFrame, members: DataFrame) -> DataFrame:
    """Numbered target lists `(list, k, target)`: one per zone, and the list of all targets for the fallback.

    `targets` has `(target, target_ord)` and may repeat a target; repeats are kept. `members` has
    `(zone, member)`; a target in several zones is in the list of each. Routing reads the lists more than once
    (a stream in every micro-batch), so write them to a table first unless they are one already.
    """
    placed = members.filter(F.col("zone").isNotNull()).select(
        zone_list(F.col("zone")).alias("list"), F.col("member").alias("target")
    )
    local = targets.join(placed.distinct(), "target").select("list", "target", "target_ord")
    whole = targets.select(F.lit(ALL_TARGETS).alias("list"), "target", "target_ord")
    numbered = ordinal(local.unionByName(whole), ["list"], ["target_ord", "target"], out="k")
    return numbered.select("list", "k", "target")


def eligible_targets(sources: DataFrame, lists: DataFrame, members: DataFrame) -> DataFrame:
    """For each source member: its zone, the list it may send to, that list's length, and whether it is local.

    Sources of one zone share one list, so the entries stay in `target_lists` and are not repeated per source.
    A source without a zone, or whose zone has no target, gets the list of all targets.
    """
    zones = member_zone(members).withColumnRenamed("member", "source")
    return _with_list(sources.join(zones, "source", "left"), "zone", lists)


def route_by_key(
    df: DataFrame, zone_col: str, key_cols: Sequence[str] | None, lists: DataFrame, hash: str = "xxhash64"
) -> DataFrame:
    """Add `target`: hash of the keys modulo the number of eligible targets, and `is_local`.

    Without `key_cols` the first column is the key. No target at all gives a null target.
    """
    keys = [df.columns[0]] if key_cols is None else list(key_cols)
    return _pick(df, zone_col, stable_hash([F.col(k) for k in keys], hash), lists)


def route_random(
    df: DataFrame, zone_col: str, row_id: Sequence[str], lists: DataFrame, seed: int = 0, hash: str = "xxhash64"
) -> DataFrame:
    """Add a uniformly drawn eligible `target`, and `is_local`.

    The draw is a hash of `(seed, row_id)`, so a retried task sends a row to the same target again.
    """
    return _pick(df, zone_col, stable_hash([F.lit(seed), *[F.col(c) for c in row_id]], hash), lists)


def colocate(df: DataFrame, zone_col: str, key_cols: Sequence[str], strict: bool = True) -> DataFrame:
    """Bring the rows of one key of one zone into one task.

    `strict=False` asks for the same layout but lets adaptive execution split a partition that grew far beyond
    the advisory size, which is what a hot key needs unless the next step must see the key whole.
    """
    if strict:
        return df.repartition(zone_col, *key_cols)
    return df.hint("rebalance", *[F.col(c) for c in [zone_col, *key_cols]])


def colocate_zones(
    df: DataFrame, zone_col: str, key_cols: Sequence[str], n_partitions: int | None = None, spread: float | None = None
) -> DataFrame:
    """Deal rows so that each task has rows of one zone only, and the rows of one key of a zone are in one of its zone's tasks.

    A zone owns a block of partitions, at least one and otherwise as many of `n_partitions` (by default those of a shuffle) as it has of
    the rows; null is a zone too. Inside its block a row goes by the hash of its key. With `spread`, a key with more than that
    many times the rows of an even partition is dealt over its zone's whole block instead, by a hash of the whole row;
    rows that are equal stay together.

    This runs a job: the rows of each zone (with `spread` also of each key) are counted; the blocks stay a table of a row per zone.
    """
    spark = df.sparkSession
    wanted = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(F.col(zone_col).alias("__zone")).agg(F.count(F.lit(1)).alias("__rows"))
    rows = F.sum("__rows").over(Window.partitionBy(F.lit(0)))
    sizes = counts.withColumn("__size", F.greatest(F.lit(1), F.floor(F.col("__rows") * wanted / rows)).cast("int"))
    before = Window.partitionBy(F.lit(0)).orderBy("__zone").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0)).cast("int"))
    blocks = written(blocks, "zone-blocks")
    total, n_rows = blocks.agg(F.coalesce(F.sum("__size"), F.lit(1)), F.coalesce(F.sum("__rows"), F.lit(0))).first()

    keyed = df.join(blocks, F.col(zone_col).eqNullSafe(F.col("__zone")))
    hashed = stable_hash([F.col(c) for c in key_cols], "xxhash64")
    if spread is not None:
        least = spread * n_rows / wanted
        hot = df.groupBy(zone_col, *[c for c in key_cols if c != zone_col]).count().filter(F.col("count") > least)
        hot = hot.select(*[F.col(c).alias(f"__hot{i}") for i, c in enumerate([zone_col, *key_cols])], F.lit(True).alias("__hot"))
        same = [F.col(c).eqNullSafe(F.col(f"__hot{i}")) for i, c in enumerate([zone_col, *key_cols])]
        keyed = keyed.join(written(hot, "hot-keys"), same, "left")
        hashed = F.when(F.col("__hot"), stable_hash([F.col(c) for c in df.columns], "xxhash64")).otherwise(hashed)
    place = (F.col("__start") + F.pmod(hashed, F.col("__size"))).cast("int")
    return keyed.select(*df.columns, place.alias("__place")).repartitionById(int(total), "__place").drop("__place")


def _with_list(df: DataFrame, zone_col: str, lists: DataFrame) -> DataFrame:
    sizes = list_sizes(lists, ["list"], "n_targets")
    all_targets = sizes.filter(F.col("list") == ALL_TARGETS).select("n_targets")
    local = sizes.filter(F.col("list") != ALL_TARGETS).select(F.col("list").alias("__local"), "n_targets")
    joined = df.join(local, zone_list(F.col(zone_col)) == F.col("__local"), "left")
    return joined.select(
        *df.columns,
        F.coalesce("__local", F.lit(ALL_TARGETS)).alias("list"),
        F.coalesce("n_targets", all_targets.scalar(), F.lit(0)).alias("n_targets"),
        F.col("__local").isNotNull().alias("is_local"),
    )


def _pick(df: DataFrame, zone_col: str, hashed: Column, lists: DataFrame) -> DataFrame:
    position = F.when(F.col("n_targets") > 0, F.pmod(hashed, F.col("n_targets")))
    rows = _with_list(df, zone_col, lists).withColumn("__k", position)
    entries = lists.select(F.col("list").alias("__list"), F.col("k").alias("__at"), "target")
    chosen = (F.col("list") == F.col("__list")) & (F.col("__k") == F.col("__at"))
    return rows.join(entries, chosen, "left").select(*df.columns, "target", "is_local")
