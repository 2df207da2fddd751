"""Choosing a zone for each group from the latencies to the zones it depends on."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geozone.operators.tagging import one_per_pair, zone_names
from geozone.session import scratch_path, written

MODES = ("minmax", "average")
# Candidates of a block, and how many of each dependency's nearest ones give the first bound.
BLOCK_ZONES = 16
NEAREST = 3

# Kinds of members: sources bring data into a zone, steps work on it (fixed values).
SOURCE = "source"
STEP = "step"


def best_zone(
    deps: DataFrame,
    latency: DataFrame,
    candidates: DataFrame | None = None,
    mode: str = "minmax",
    by: Sequence[str] = (),
    bounded: bool = False,
) -> DataFrame:
    """The candidate zone with the lowest score per group: `(*by, grp, zone, score)`.

    `deps` has `(grp, zone)`; a group whose only zone is null has no dependencies. `latency` has directed pairs; a
    repeated pair counts once, with its largest latency. The score of a candidate is the largest (`minmax`, at
    least 0) or mean (`average`) `latency[dependency][candidate]`. The lowest score wins, then the smallest zone
    name. A candidate is eligible if its latency from every dependency is known; with none eligible the group is
    returned with a null zone. Without dependencies `minmax` gives the smallest known candidate with score 0 and
    `average` gives null.

    `by` names columns of both tables, such as a snapshot, inside which groups and latencies belong together.

    `bounded` is for thousands of zones: the same result without opening every candidate for every dependency (see
    `bounded_search`). It runs jobs, as it writes the sets and the latencies in order.

    Many groups share a dependency set: each distinct set is scored once and joined back, known by a digest, so a plan has
    the same size however many zones there are. No job runs ahead. `latency` is read up to three times; write it
    to a table first if it is measured from much data.
    """
    _check_mode(mode)
    by = list(by)
    pairs = one_per_pair(latency, by)
    if candidates is not None:
        offered = candidates.select(F.col("zone").alias("to_zone")).distinct()
        pairs = pairs.join(offered, "to_zone", "left_semi")
    zones = F.sort_array(F.collect_set("zone"))
    groups = deps.groupBy(*by, "grp").agg(zones.alias("zones"))
    # The lengths are part of the text, so that different sets have different texts.
    named = F.transform("zones", lambda z: F.concat(F.length(z).cast("string"), F.lit(":"), z))
    groups = groups.withColumn("set", F.md5(F.concat_ws(",", named))).withColumn("size", F.size("zones"))

    kind = latency.schema["latency"].dataType
    score = F.greatest(F.max("latency"), F.lit(0).cast(kind)) if mode == "minmax" else _mean("latency")
    sets = groups.filter("size > 0").groupBy(*by, "set", "size").agg(F.first("zones").alias("zones"))
    if bounded:
        scored = bounded_search(sets, pairs, mode, by).scored
    else:
        scored = _scores(sets.select(*by, "set", "size", F.explode("zones").alias("from_zone")), pairs, by, score)
    best = scored.groupBy(*by, "set").agg(F.min(F.struct("score", F.col("to_zone").alias("zone"))).alias("best"))
    found = groups.join(best, [*by, "set"], "left").select(*by, "grp", "size", "best.zone", "best.score")
    if mode == "average":
        return found.select(*by, "grp", "zone", "score")
    free = F.col("size") == 0
    names = zone_names(latency, by)
    if candidates is not None:
        names = names.join(candidates.select("zone"), "zone", "left_semi")
    if by:
        found = found.join(names.groupBy(*by).agg(F.min("zone").alias("__first")), by, "left")
        first = F.col("__first")
    else:
        first = names.agg(F.min("zone")).scalar()
    return found.select(
        *by,
        "grp",
        F.when(free, first).otherwise(F.col("zone")).alias("zone"),
        F.when(free & first.isNotNull(), F.lit(0).cast(kind)).otherwise(F.col("score")).alias("score"),
    )


def _scores(opened: DataFrame, pairs: DataFrame, by: list[str], score: Column, on: Sequence[str] = ("from_zone",)) -> DataFrame:
    """Scores of the candidates of each set that are known from all its zones."""
    met = opened.join(pairs, [*by, *on]).groupBy(*by, "set", "size", "to_zone")
    return met.agg(score.alias("score"), F.count(F.lit(1)).alias("n_known")).filter("n_known = size")


class Search(NamedTuple):
    """Scores that hold each set's best, and the frames of rows of the latency table that were opened for them."""

    scored: DataFrame
    opened: list[DataFrame]


def bounded_search(sets: DataFrame, pairs: DataFrame, mode: str, by: Sequence[str] = ()) -> Search:
    """Scores of the candidates that can win, `(*by, set, size, to_zone, score, n_known)`; ties for the best are among them.

    `sets` has `(*by, set, size, zones)`, `pairs` one row per directed pair. Each zone's candidates stand in order of their latency, in
    blocks. The few nearest of each dependency are scored in full; the best of them bounds the score that can win, and so what
    a candidate's latency from any one dependency may be: that score (`minmax`), or what the score leaves when all other
    dependencies had their least latency (`average`). Of a set's dependencies the one with the fewest blocks within its bound gives
    the candidates, whole blocks at a time, so candidates beyond are not opened; the dependency with the next fewest strikes
    out more, and what is left is scored in full. Without any candidate that is known from all, nothing is bounded. For sets of
    five neighbours among 2,000 zones on a plane, less than a tenth of all rows are opened with `minmax`; the bound for
    `average` is looser, and takes up to four tenths.
    """
    by = list(by)
    low = F.row_number().over(Window.partitionBy(*by, "from_zone").orderBy("latency", "to_zone"))
    ordered = written(pairs.withColumn("rank", low).withColumn("block", F.floor((F.col("rank") - 1) / BLOCK_ZONES)), "ordered-latency")
    pairs = ordered.select(*by, "from_zone", "to_zone", "latency")
    sets = written(sets.select(*by, "set", "size", "zones"), "zone-sets")
    deps = sets.select(*by, "set", "size", F.explode("zones").alias("from_zone"))
    kind = pairs.schema["latency"].dataType
    score = F.greatest(F.max("latency"), F.lit(0).cast(kind)) if mode == "minmax" else _mean("latency")

    nearest = ordered.filter(F.col("rank") <= NEAREST).select(*by, "from_zone", "to_zone")
    pool = deps.join(nearest, [*by, "from_zone"]).select(*by, "set", "to_zone").distinct()
    first = deps.join(pool, [*by, "set"])
    upper = _scores(first, pairs, by, score, ["from_zone", "to_zone"]).groupBy(*by, "set").agg(F.min("score").cast("double").alias("upper"))

    heads = ordered.groupBy(*by, "from_zone", "block").agg(F.min("latency").cast("double").alias("least"))
    heads = heads.groupBy(*by, "from_zone").agg(F.sort_array(F.collect_list(F.struct("block", "least"))).alias("heads"))
    bounded = deps.join(heads, [*by, "from_zone"]).withColumn("least", F.col("heads")[0]["least"])
    spare = bounded.groupBy(*by, "set").agg(F.sum("least").alias("leasts"))
    limit = F.col("upper") if mode == "minmax" else F.col("upper") * F.col("size") - F.col("leasts") + F.col("least")
    # A little more than the bound, for what doubles round off.
    limit = F.coalesce(limit + 1e-9 * (F.abs(limit) + 1), F.lit(float("inf")))
    bounded = bounded.join(spare, [*by, "set"]).join(upper, [*by, "set"], "left").withColumn("limit", limit)
    within = F.size(F.filter("heads", lambda h: h["least"] <= F.col("limit"))).alias("within")
    steps = F.sort_array(F.collect_list(F.struct("within", "from_zone", "limit"))).alias("steps")
    chosen = bounded.select(*by, "set", "size", "from_zone", "limit", within).groupBy(*by, "set", "size").agg(steps)
    # A zone without any pair leaves its set without candidates.
    chosen = chosen.filter(F.size("steps") == F.col("size"))

    one, two = F.col("steps")[0], F.coalesce(F.get("steps", 1), F.col("steps")[0])
    blocks = chosen.filter(one["within"] > 0).select(
        *by, "set", "size", one["from_zone"].alias("from_zone"), one["limit"].alias("limit"), two["from_zone"].alias("next"), two["limit"].alias("next_limit"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), one["within"].cast("bigint") - 1)).alias("block"),
    )
    fetched = blocks.join(ordered.select(*by, "from_zone", "block", "to_zone", "latency"), [*by, "from_zone", "block"])
    able = fetched.filter(F.col("latency") <= F.col("limit")).select(*by, "set", F.col("next").alias("from_zone"), "next_limit", "to_zone")
    tried = able.join(pairs, [*by, "from_zone", "to_zone"])
    left = tried.filter(F.col("latency") <= F.col("next_limit")).select(*by, "set", "to_zone")
    last = deps.join(left, [*by, "set"])
    return Search(_scores(last, pairs, by, score, ["from_zone", "to_zone"]), [first, fetched, tried, last])


def _mean(column: str) -> Column:
    return F.sum(column) / F.count(column)


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")


def best_zone_overall(latency: DataFrame, mode: str = "average") -> DataFrame:
    """The zone best placed for all known zones together (its own latency to itself included): one row.

    There is no row if no zone has a known latency from every zone. Repeated pairs as in `best_zone`.
    """
    _check_mode(mode)
    kind = latency.schema["latency"].dataType
    score = F.greatest(F.max("latency"), F.lit(0).cast(kind)) if mode == "minmax" else _mean("latency")
    n_zones = zone_names(latency).agg(F.count("zone")).scalar()
    scored = one_per_pair(latency).groupBy("to_zone").agg(score.alias("score"), F.count(F.lit(1)).alias("n_known"))
    whole = scored.filter(F.col("n_known") == n_zones)
    best = whole.agg(F.min(F.struct("score", F.col("to_zone").alias("zone"))).alias("best"))
    return best.filter("best is not null").select("best.zone", "best.score")


def classify_members(members: DataFrame) -> DataFrame:
    """Add `scope`: `local` if any source names the member's group, else `global`.

    `members` has `(member, kind, grp, ...)`; members without a group are left out.
    """
    grouped = members.filter(F.col("grp").isNotNull())
    local = grouped.filter(F.col("kind") == SOURCE).select("grp", F.lit("local").alias("__scope")).distinct()
    return grouped.join(local, "grp", "left").select(
        *members.columns, F.coalesce("__scope", F.lit("global")).alias("scope")
    )


def group_dependencies(members: DataFrame, inputs: DataFrame, member_zones: DataFrame) -> DataFrame:
    """Distinct zones of all inputs of all members of each group: `(grp, zone)`.

    Inputs without a zone add nothing. A group without any zone keeps one row with a null zone.
    """
    reads = _reads(members, inputs, ["grp"])
    # As many zones per group as there are zones; the outer explode keeps groups without any.
    found = _zones_read(reads, member_zones).distinct().groupBy("grp").agg(F.collect_list("zone").alias("zones"))
    return found.select("grp", F.explode_outer("zones").alias("zone"))


def find_levels(members: DataFrame, inputs: DataFrame) -> DataFrame:
    """The level of each group, `(grp, level)`, from what its members read: 1 without inputs from other groups, else one more than the
    highest level among the groups it reads.

    `members` has `(member, grp)`, `inputs` has `(member, input)`; inputs that are no members, and those of the own group, do not
    count. Groups that read each other in a circle are refused. Rows with a null group are left out.

    This operator runs jobs: a round per level takes the groups that wait for none and strikes them from what others wait for.
    Every round writes what is left to the shared folder and starts from there, so its plan does not grow with the
    rounds, and what is left gets smaller. Only the number of rows left comes to the driver.
    """
    members = members.filter(F.col("grp").isNotNull()).select("member", "grp").distinct()
    owners = members.select(F.col("member").alias("input"), F.col("grp").alias("needs"))
    needs = members.join(inputs, "member").join(owners, "input").filter("grp <> needs").select("grp", "needs").distinct()
    # One row without a need stands for each group, so that a group is there until it is placed.
    alone = members.select("grp", F.lit(None).cast(members.schema["grp"].dataType).alias("needs")).distinct()
    waiting = written(needs.unionByName(alone), "waiting")
    found, level = None, 0
    while (left := waiting.count()) or found is None:
        level += 1
        ready = waiting.groupBy("grp").agg(F.count("needs").alias("n")).filter("n = 0").select("grp", F.lit(level).alias("level"))
        ready = written(ready, "level")
        if left and not ready.count():
            some = [r.grp for r in waiting.select("grp").distinct().orderBy("grp").limit(5).collect()]
            raise ValueError(f"groups read each other in a circle, or read such groups: {some}")
        found = ready if found is None else found.unionByName(ready)
        done = ready.select(F.col("grp").alias("__done"))
        rest = waiting.join(done, F.col("grp") == F.col("__done"), "left_anti")
        waiting = written(rest.join(done, F.col("needs") == F.col("__done"), "left_anti"), "waiting")
    return found


def place_in_order(
    members: DataFrame,
    inputs: DataFrame,
    member_zones: DataFrame,
    latency: DataFrame,
    candidates: DataFrame | None = None,
    mode: str = "minmax",
    levels: Sequence[int] | None = None,
    slots: DataFrame | None = None,
) -> DataFrame:
    """Place groups level after level; a later level sees the zones of members placed before.

    `members` has `(member, grp, level)` with one level per group; a group with two is refused. Without the column `level`
    levels are found from the inputs (`find_levels`). Inputs of the same
    or a later level do not count. All groups of a level are placed together, so there are as many rounds as levels,
    not groups. Returns `(grp, level, zone, score)`. With `slots` (a table with the column `zone`), a group
    whose zone has no slots is not placed: it comes back with a null zone, and later levels do not see it.

    This operator runs jobs: it has a round per level. The reads are written once, by level, to the folder named in
    `spark.checkpoint.dir`, and each round's result and placed members once, so no round repeats an earlier one and a
    lost executor repeats at most one.
    """
    _check_mode(mode)
    spark = members.sparkSession
    if "level" not in members.columns:
        members = members.join(find_levels(members, inputs), "grp").select("member", "grp", "level")
    one = members.groupBy("grp").agg(F.min("level").alias("lo"), F.max("level").alias("hi"))
    found = one.agg(F.collect_set("lo").alias("levels"), F.bool_or(F.col("lo") != F.col("hi")).alias("mixed")).first()
    if found.mixed:
        raise ValueError("a group has members of two levels")
    levels = sorted(found.levels if levels is None else levels)
    if not levels:
        raise ValueError("there are no levels to place")

    reads_path = scratch_path(spark, "reads")
    reads = _reads(members, inputs, ["level", "grp"])
    reads.repartition("level", F.pmod(F.xxhash64("grp", "input"), F.lit(_level_files(spark)))).write.partitionBy("level").parquet(reads_path)
    reads = spark.read.schema(reads.select("grp", "input", "level").schema).parquet(reads_path)
    latency = written(latency.select("from_zone", "to_zone", "latency"), "latency")

    kind = members.schema["level"].dataType
    known, placed = member_zones.select("member", "zone"), None
    for level in levels:
        deps = _zones_read(reads.filter(F.col("level") == level).select("grp", "input"), known)
        chosen = best_zone(deps, latency, candidates, mode).withColumn("level", F.lit(level).cast(kind))
        if slots is not None:
            able = slots.select("zone", F.lit(True).alias("__able")).distinct()
            chosen = chosen.join(able, "zone", "left").withColumn("zone", F.when(F.col("__able"), F.col("zone")))
            chosen = chosen.withColumn("score", F.when(F.col("__able"), F.col("score")))
        chosen = written(chosen.select("grp", "level", "zone", "score"), "placed")
        placed = chosen if placed is None else placed.unionByName(chosen)
        if level != levels[-1]:
            seen = chosen.filter(F.col("zone").isNotNull()).select("grp", "zone")
            here = members.filter(F.col("level") == level).join(seen, "grp").select("member", "zone")
            known = known.unionByName(written(here, "placed-members"))
    return placed


def _level_files(spark) -> int:
    """Files per level: as many as a shuffle has tasks at most, and no more."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _reads(members: DataFrame, inputs: DataFrame, by: list[str]) -> DataFrame:
    """Distinct `(*by, input)` of the members, and one row with a null input for each group.

    The extra rows stand for groups without inputs, so inner joins do, and Spark may choose either side.
    """
    found = members.join(inputs, "member").select(*by, "input").distinct()
    groups = members.select(*by).distinct()
    return found.unionByName(groups.withColumn("input", F.lit(None).cast(found.schema["input"].dataType)))


def _zones_read(reads: DataFrame, member_zones: DataFrame) -> DataFrame:
    """`(grp, zone)` from `_reads`; each group has a row with a null zone besides."""
    zones = member_zones.select(F.col("member").alias("input"), "zone")
    found = reads.join(zones, "input").select("grp", "zone")
    groups = reads.filter(F.col("input").isNull())
    return found.unionByName(groups.select("grp", F.lit(None).cast("string").alias("zone")))
