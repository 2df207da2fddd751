"""Handing out work lists: items to zones by quota or evenly, items to slots in turn."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geozone.functions.hashing import stable_hash
from geozone.operators.ordinal import list_sizes, ordinal

# Array length per step of `expand_ranges`.
RANGE_CHUNK = 10_000


def assign_zone_quota(
    items: DataFrame,
    zones: DataFrame,
    per_zone: int | str,
    order: str | Sequence[str] = "item",
    slots: DataFrame | None = None,
    group: Sequence[str] = ("grp",),
) -> DataFrame:
    """Zone number i of a group takes items `[i * per_zone, (i + 1) * per_zone)` of each list of the group.

    `items` has `(grp, item)`, `zones` has `(grp, zone, zone_ord)` with positions from 0. A list is what has the same
    `group` columns, which must include `grp`: the group itself, or each member of it. `per_zone` is a number or a
    column of `items` that is constant in a list. A list with fewer than `zones * per_zone` items places none.
    Items beyond that stay unplaced and are not returned. With `slots`, a zone without slots takes no items but
    still uses up its range.
    """
    _includes(group, "grp")
    quota = F.col(per_zone) if isinstance(per_zone, str) else F.lit(per_zone)
    enough = F.col("n_items") >= F.col("n_zones") * F.col("__quota")
    numbered = ordinal(items, group, _columns(order), out="ord", total="n_items")
    return _slices(items, numbered, zones, quota, enough, slots)


def assign_zone_even(
    items: DataFrame,
    zones: DataFrame,
    order: str | Sequence[str] = "item",
    slots: DataFrame | None = None,
    hint: int | str | None = None,
    group: Sequence[str] = ("grp",),
) -> DataFrame:
    """Each zone of a group takes `n div zones` items of each list in turn; the remainder stays unplaced.

    `n` is `hint`, a number or a column of `items` that is constant in a list, or else the number of items; a
    hint beyond the number of items leaves the last zones with fewer or none. `group` as in `assign_zone_quota`.
    """
    _includes(group, "grp")
    numbered = ordinal(items, group, _columns(order), out="ord", total="n_items")
    n = F.col("n_items") if hint is None else F.col(hint) if isinstance(hint, str) else F.lit(hint)
    share = F.floor(n / F.col("n_zones"))
    return _slices(items, numbered, zones, share, F.lit(True), slots)


def _columns(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _includes(group: Sequence[str], name: str) -> None:
    if name not in group:
        raise ValueError(f"group must include {name}")


def assign_slots(
    items: DataFrame,
    slots: DataFrame,
    group: Sequence[str] = ("zone",),
    order: str | Sequence[str] = "item",
    seed: int = 0,
) -> DataFrame:
    """Give each item a slot of its zone: `items` plus `slot`.

    `items` has `(item, zone, ...)`, `slots` has `(zone, slot, slot_ord)`. Items are taken per `group`, which
    must include the zone. With at least as many items as slots, item number i gets slot `i mod slots`; with
    fewer, each item draws a slot by a hash of `(seed, item)`. Items of a zone without slots are not returned.
    """
    _includes(group, "zone")
    numbered = ordinal(items, group, _columns(order), out="__ord", total="__n")
    return _pick_slots(numbered, slots, seed).select(*items.columns, "slot")


def assign_group(
    items: DataFrame,
    group_zone: DataFrame,
    slots: DataFrame,
    group: Sequence[str] = ("grp",),
    order: str | Sequence[str] = "item",
    seed: int = 0,
) -> DataFrame:
    """All items of a group go to slots of its one zone: `items` plus `zone` and `slot`.

    `group_zone` has `(grp, zone)`. A group without a zone, or whose zone has no slots, places none.
    """
    _includes(group, "grp")
    # A group has one zone, so items are numbered before the zone is known.
    numbered = ordinal(items, group, _columns(order), out="__ord", total="__n")
    chosen = group_zone.filter(F.col("zone").isNotNull()).select("grp", "zone")
    return _pick_slots(numbered.join(chosen, "grp"), slots, seed).select(*items.columns, "zone", "slot")


def first_slot_per_host(slots: DataFrame, hosts: DataFrame) -> DataFrame:
    """The first free slot of each host: `(zone, host, slot)`.

    `slots` has `(host, slot, slot_ord)`, `hosts` has `(host, zone)`; hosts without a zone are dropped.
    """
    known = hosts.filter(F.col("zone").isNotNull()).select("host", "zone")
    free = slots.groupBy("host").agg(F.min_by("slot", F.struct("slot_ord", "slot")).alias("slot"))
    return free.join(known, "host").select("zone", "host", "slot")


def expand_ranges(
    df: DataFrame, start: str, end: str, out: str = "id", start_only: bool = False, chunk: int = RANGE_CHUNK
) -> DataFrame:
    """One row per id of each inclusive range; an empty range gives none. `start_only` keeps the first id only.

    A wide range is opened in steps: into stretches of `chunk` chunks, these into chunks, these into ids. Chunks are
    dealt over the tasks before they are opened, so one very wide range is opened by many, and an array is no longer
    than `chunk` or the number of stretches.
    """
    filled = df.filter(F.col(end) >= F.col(start))
    first, last = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    if start_only:
        return df.withColumn(out, first)
    far, near = F.lit(chunk * chunk).cast("bigint"), F.lit(chunk).cast("bigint")
    stretches = filled.withColumn("__stretch", F.explode(F.sequence(first, last, far)))
    end_of_stretch = F.least(F.col("__stretch") + (chunk * chunk - 1), last)
    chunks = stretches.withColumn("__from", F.explode(F.sequence(F.col("__stretch"), end_of_stretch, near)))
    dealt = chunks.repartition("__from", start, end)
    to = F.least(F.col("__from") + (chunk - 1), last)
    return dealt.select(*df.columns, F.explode(F.sequence(F.col("__from"), to)).alias(out))


def unassigned(items: DataFrame, assigned: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Items that were not placed. An item is known by `keys`: by default `grp` and `item` where both tables have
    them, else `item` alone. Null keys are equal to each other."""
    if keys is None:
        keys = [k for k in ("grp", "item") if k in items.columns and k in assigned.columns]
    placed = assigned.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return items.join(placed, same, "left_anti")


def spread_rest(
    items: DataFrame,
    assigned: DataFrame,
    slots: DataFrame,
    order: str | Sequence[str] = "item",
    seed: int = 0,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Spread what was not placed over all slots of all zones: `items` plus `slot`.

    The rest is numbered by `order`, which should be unique over all groups (`["item", "grp"]` where item ids repeat).
    It is part of the plan three times; write it to a table first if it is costly.
    """
    rest = ordinal(unassigned(items, assigned, keys), [], _columns(order), out="__ord", total="__n")
    return _pick_slots(rest, slots, seed, by=[]).select(*items.columns, "slot")


def _pick_slots(numbered: DataFrame, slots: DataFrame, seed: int, by: Sequence[str] = ("zone",)) -> DataFrame:
    """Slot of each row of `numbered (*by, item, __ord, __n)` from the slot list of the same name.

    Without `by` all slots form one list.
    """
    entries = ordinal(slots, by, ["slot_ord", "slot"], out="__k").select(*by, "__k", "slot")
    if by:
        numbered = numbered.join(list_sizes(slots, by, "n_slots"), list(by))
    else:
        numbered = numbered.withColumn("n_slots", slots.agg(F.count(F.lit(1)).alias("n")).scalar())
    drawn = stable_hash([F.lit(seed), F.col("item")])
    position = F.when(F.col("__n") >= F.col("n_slots"), F.col("__ord") % F.col("n_slots")).otherwise(
        drawn % F.col("n_slots")
    )
    at = numbered.withColumn("__k", F.when(F.col("n_slots") > 0, position))
    return at.join(entries, [*by, "__k"])


def _slices(
    items: DataFrame,
    numbered: DataFrame,
    zones: DataFrame,
    quota: Column,
    condition: Column,
    slots: DataFrame | None,
) -> DataFrame:
    """Rows of `numbered (grp, ord, n_items)` that fall into the slice of a zone."""
    n_zones = list_sizes(zones, ["grp"], "n_zones")
    sliced = (
        numbered.join(n_zones, "grp")
        .withColumn("__quota", quota.cast("bigint"))
        .filter((F.col("__quota") > 0) & condition & (F.col("ord") < F.col("n_zones") * F.col("__quota")))
        .withColumn("zone_ord", F.expr("ord div nullif(__quota, 0)").cast(zones.schema["zone_ord"].dataType))
    )
    placed = sliced.join(zones.select("grp", "zone", "zone_ord"), ["grp", "zone_ord"])
    if slots is not None:
        placed = placed.join(slots.select("zone"), "zone", "left_semi")
    return placed.select(*items.columns, "zone", "zone_ord", "ord")
