"""The registered queries: one callable `(spark, path) -> DataFrame` per operator, on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import geozone as gz
from geozone.functions.measures import DISTINCT_ERROR, QUANTILE_ERROR
from geozone.plans import views as v
from geozone.session import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]

MEASURES = {
    "n_events": ("count", "*"),
    "sum_value": ("sum", "value"),
    "min_value": ("min", "value"),
    "max_value": ("max", "value"),
    "avg_value": ("avg", "value"),
}
KEYS = ["event_type"]
WIDTH = "1 hour"
# Rows this much older than the newest row are late.
DELAY = "1 hour"
# A zone's quota is one such part of a list's items; there are five regions.
QUOTA_SHARE = 10
SEED = 7
# Partitions for each zone on average in the query on tasks of zones.
ZONE_PARTITIONS = 5
# Entries per line in the queries on lines, so that zones and slots take several lines at small scale too.
LINE_MEMBERS = 32

REGISTRY: dict[str, Query] = {}


def register(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


def plain_numbers(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles, for output."""
    casts = {f"{f}_value": F.col(f"{f}_value").cast("double") for f in ("sum", "min", "max")}
    return df.withColumns(casts)


# --- local and global aggregation -------------------------------------------------------------------------


@register
def local_and_global(spark, path):
    return plain_numbers(gz.local_and_global(v.zoned_events(spark, path), "zone", KEYS, MEASURES, "ts", WIDTH))


@register
def zone_local_agg(spark, path):
    local = gz.zone_local_agg(v.zoned_events(spark, path), "zone", KEYS, MEASURES, "ts", WIDTH)
    return plain_numbers(gz.local_result(local, "zone", KEYS, MEASURES))


@register
def global_agg(spark, path):
    local = gz.zone_local_agg(v.zoned_events(spark, path), "zone", KEYS, MEASURES, "ts", WIDTH)
    return plain_numbers(gz.global_agg(local, KEYS, MEASURES))


@register
def stream_zone_local_agg(spark, path):
    """All windows, open ones too: update mode into a versioned table, newest version of each row."""
    events = v.with_zones(v.stream(spark, path, "events"), spark, path)
    local = gz.stream_zone_local_agg(events, "zone", KEYS, MEASURES, "ts", WIDTH, DELAY)
    out = scratch_path(spark, "stream-local")
    result = gz.stream_result(local, ["zone", *KEYS], MEASURES)
    gz.start_versions(result, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return plain_numbers(gz.latest_versions(spark, f"{out}/table", ["window_start", "window_end", "zone", *KEYS]))


@register
def stream_global_agg(spark, path):
    """Windows closed by the watermark: local and global stage chained in one stream, append mode."""
    events = v.with_zones(v.stream(spark, path, "events"), spark, path)
    local = gz.stream_zone_local_agg(events, "zone", KEYS, MEASURES, "ts", WIDTH, DELAY)
    result = gz.stream_global_agg(local, KEYS, MEASURES, WIDTH)
    out = scratch_path(spark, "stream-global")
    gz.start_append(result, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return plain_numbers(spark.read.schema(result.schema).parquet(f"{out}/table"))


@register
def stream_global_complete(spark, path):
    """All windows over all zones: partial rows in a versioned table, compacted, then merged."""
    events = v.with_zones(v.stream(spark, path, "events"), spark, path)
    local = gz.stream_zone_local_agg(events, "zone", KEYS, MEASURES, "ts", WIDTH, DELAY)
    rows = gz.stream_partial(local, ["zone", *KEYS], MEASURES)
    out = scratch_path(spark, "stream-complete")
    gz.start_versions(rows, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    by = ["window_start", "window_end", "zone", *KEYS]
    gz.compact_versions(spark, f"{out}/table", by)
    versions = gz.latest_versions(spark, f"{out}/table", by, rows.schema)
    return plain_numbers(gz.global_agg(gz.local_rows(versions), KEYS, MEASURES))


@register
def stream_late_complete(spark, path):
    """Events that arrive in three runs, some of them days late: all windows, and how many rows of each came late."""
    source, out = scratch_path(spark, "arrivals"), scratch_path(spark, "stream-late")
    raw = v.table(spark, path, "events")
    for run in range(v.ARRIVALS):
        raw.filter(v.arrival() == run).write.mode("append").parquet(source)
        events = v.with_zones(spark.readStream.schema(raw.schema).parquet(source), spark, path)
        query = gz.start_corrected(events, "zone", KEYS, MEASURES, "ts", WIDTH, DELAY, f"{out}/table", f"{out}/checkpoint")
        query.awaitTermination()
    rows = gz.corrected_rows(spark, f"{out}/table")
    return plain_numbers(gz.global_agg(rows, KEYS, {**MEASURES, "n_late": ("sum", "n_late")}))


@register
def global_variance(spark, path):
    measures = {"n_events": ("count", "*"), "variance": ("variance", "value"), "stddev": ("stddev", "value")}
    local = gz.zone_local_agg(v.zoned_events(spark, path), "zone", KEYS, measures, "ts", "1 day")
    return gz.global_agg(local, KEYS, measures)


@register
def zone_distinct(spark, path):
    """Users per event type, in each zone and in all: the exact number, and whether the sketch's estimate is within four standard errors."""
    events = v.zoned_events(spark, path)
    estimates = gz.local_and_global(events, "zone", KEYS, {"estimate": ("distinct", "user_id")})
    # Distinct users first, so that the exact count is one more plain count.
    users = events.select("zone", "event_type", "user_id").distinct()
    exact = gz.local_and_global(users, "zone", KEYS, {"n_users": ("count", "*")}).filter("scope = 'local'")
    whole = users.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count(F.lit(1)).alias("n_users"))
    exact = exact.unionByName(whole.select(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("zone"), "event_type", "n_users"))
    same = [estimates[c].eqNullSafe(exact[c]) for c in ("scope", "zone", "event_type")]
    near = F.abs(F.col("estimate") - F.col("n_users")) <= 4 * DISTINCT_ERROR * F.col("n_users")
    return estimates.join(exact, same).select(exact.scope, exact.zone, exact.event_type, "n_users", near.alias("within"))


@register
def global_quantiles(spark, path):
    """The middle and the ninth tenth of the values of each event type: whether their ranks are within twice the stated error."""
    ranks = {"p50": 0.5, "p90": 0.9}
    events = v.zoned_events(spark, path)
    measures = {name: ("quantile", "value", rank) for name, rank in ranks.items()}
    found = gz.global_agg(gz.zone_local_agg(events, "zone", KEYS, measures), KEYS, measures)
    value = F.col("value").cast("double")
    counts = [f(F.when(c, 1)).alias(f"{name}_{side}") for name in ranks for side, c, f in (("below", value < F.col(name), F.count), ("upto", value <= F.col(name), F.count))]
    met = events.join(found, "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), *counts)
    slack = 2 * QUANTILE_ERROR * F.col("n_events")
    near = [((F.col(f"{name}_below") - slack <= rank * F.col("n_events")) & (rank * F.col("n_events") <= F.col(f"{name}_upto") + slack)).alias(name) for name, rank in ranks.items()]
    return met.select("event_type", "n_events", *near)


# --- tagging and routing ----------------------------------------------------------------------------------


@register
def tag_zones(spark, path):
    events = v.table(spark, path, "events").select("event_id", F.col("event_type").alias("source"))
    # The small side is a table first, so its size is known when the join is planned.
    return gz.tag_zones(events, "source", written(v.source_zones(spark, path), "source-zones"))


@register
def target_lists(spark, path):
    return gz.target_lists(v.targets(spark, path), v.supplier_nations(spark, path))


def target_table(spark: SparkSession, path: str) -> DataFrame:
    """The target lists as a written table; routing reads them more than once."""
    return written(target_lists(spark, path), "target-lists")


@register
def eligible_targets(spark, path):
    buyers = v.customers(spark, path)
    homes = buyers.select(F.col("nation").alias("zone"), F.col("c_custkey").alias("member"))
    sources = v.table(spark, path, "customer").select(F.col("c_custkey").alias("source"))
    return gz.eligible_targets(sources, target_table(spark, path), homes)


@register
def route_by_key(spark, path):
    events = v.zoned_events(spark, path).select("event_id", "user_id", "event_type", "nation")
    return gz.route_by_key(events, "nation", ["user_id", "event_type"], target_table(spark, path), hash="md5")


@register
def route_random(spark, path):
    events = v.zoned_events(spark, path).select("event_id", "nation")
    return gz.route_random(events, "nation", ["event_id"], target_table(spark, path), SEED, hash="md5")


@register
def stream_route(spark, path):
    events = v.with_zones(v.stream(spark, path, "events"), spark, path)
    events = events.select("event_id", "user_id", "event_type", "nation")
    routed = gz.route_stream(events, "nation", target_table(spark, path), ["user_id", "event_type"], hash="md5")
    out = scratch_path(spark, "stream-route")
    gz.start_append(routed, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(routed.schema).parquet(f"{out}/table")


@register
def stream_route_live(spark, path):
    """Events that arrive in three runs; before each run other suppliers are away, and the lists are published anew."""
    source, out = scratch_path(spark, "arrivals"), scratch_path(spark, "route-live")
    raw = v.table(spark, path, "events")
    for run in range(v.ARRIVALS):
        lists = gz.target_lists(v.remaining_targets(spark, path, run), v.supplier_nations(spark, path))
        gz.publish_lists(lists, f"{out}/lists")
        raw.filter(v.arrival() == run).write.mode("append").parquet(source)
        events = v.with_zones(spark.readStream.schema(raw.schema).parquet(source), spark, path)
        events = events.select("event_id", "user_id", "event_type", "nation")
        how = {"key_cols": ["user_id", "event_type"], "hash": "md5"}
        gz.start_route_live(events, "nation", f"{out}/lists", f"{out}/table", f"{out}/checkpoint", **how).awaitTermination()
    return gz.routed_rows(spark, f"{out}/table")


@register
def zone_tasks(spark, path):
    """Per zone its rows, the zones that share a task with it, and whether each of its keys is in one task."""
    events = v.zoned_events(spark, path).select("zone", "user_id")
    dealt = gz.colocate_zones(events, "zone", ["user_id"], 4 * ZONE_PARTITIONS).withColumn("task", F.spark_partition_id())
    landed = written(dealt.groupBy("task", "zone", "user_id").agg(F.count(F.lit(1)).alias("n")), "landed")
    shared = landed.groupBy("task").agg(F.countDistinct("zone").alias("n_zones"))
    keys = landed.groupBy("zone", "user_id").agg(F.count(F.lit(1)).alias("n_tasks"))
    whole = keys.groupBy("zone").agg(F.bool_and(F.col("n_tasks") == 1).alias("keys_whole"))
    zones = landed.join(shared, "task").groupBy("zone").agg(F.sum("n").alias("n_rows"), F.max("n_zones").alias("n_zones"))
    return zones.join(whole, "zone")


@register
def colocate(spark, path):
    """Per zone and key: its rows, and in how many tasks they landed."""
    together = gz.colocate(v.zoned_events(spark, path).select("zone", "user_id"), "zone", ["user_id"])
    landed = together.withColumn("task", F.spark_partition_id())
    return landed.groupBy("zone", "user_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("task").alias("n_tasks")
    )


# --- latencies and placement ------------------------------------------------------------------------------


def latency_table(spark: SparkSession, path: str) -> DataFrame:
    """The measured latencies as a written table: small, and read several times."""
    return written(v.latency(spark, path), "latency")


@register
def observed_latency(spark, path):
    return v.latency(spark, path)


@register
def zone_names(spark, path):
    return gz.zone_names(v.latency(spark, path))


@register
def latency_of(spark, path):
    """Each lineitem's route; pending orders have no known destination yet."""
    trips = written(v.trips(spark, path), "trips")
    measured = gz.observed_latency(trips, "s_nationkey", "c_nationkey", "days")
    latency = written(v.name_zones(measured, spark, path), "latency")
    nation = v.table(spark, path, "nation")
    start = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("from_zone"))
    end = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("to_nation"))
    to_zone = F.when(F.col("o_orderstatus") == "P", F.lit("UNKNOWN")).otherwise(F.col("to_nation"))
    routes = trips.join(start, "s_nationkey").join(end, "c_nationkey")
    routes = routes.select("l_orderkey", "l_linenumber", "from_zone", to_zone.alias("to_zone"))
    return gz.latency_of(routes, latency, "from_zone", "to_zone")


@register
def latency_as_of(spark, path):
    """Each lineitem's route with the latency that was known on the day of the order; pending orders have no known destination."""
    trips = written(v.dated_trips(spark, path), "dated-trips")
    snapshots = written(v.name_zones(v.quarterly_latency(trips), spark, path), "snapshots")
    nation = v.table(spark, path, "nation")
    start = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("from_zone"))
    end = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("to_nation"))
    to_zone = F.when(F.col("o_orderstatus") == "P", F.lit("UNKNOWN")).otherwise(F.col("to_nation"))
    routes = trips.join(start, "s_nationkey").join(end, "c_nationkey")
    routes = routes.select("l_orderkey", "l_linenumber", "day", "from_zone", to_zone.alias("to_zone"))
    return gz.latency_as_of(routes, snapshots, "from_zone", "to_zone", "day")


@register
def best_zone_minmax(spark, path):
    return gz.best_zone(v.order_deps(spark, path), latency_table(spark, path), mode="minmax")


@register
def best_zone_average(spark, path):
    return gz.best_zone(v.order_deps(spark, path), latency_table(spark, path), mode="average")


@register
def best_zone_bounded(spark, path):
    """As `best_zone_minmax`, by the search that opens only candidates that can win."""
    return gz.best_zone(v.order_deps(spark, path), latency_table(spark, path), mode="minmax", bounded=True)


@register
def best_zone_by_snapshot(spark, path):
    """Orders by status, each status with the latencies measured on its own orders."""
    latency = written(v.latency_snapshots(spark, path), "latency")
    return gz.best_zone(v.snapshot_deps(spark, path), latency, by=["snapshot"])


@register
def best_zone_overall(spark, path):
    return gz.best_zone_overall(latency_table(spark, path))


@register
def classify_members(spark, path):
    return gz.classify_members(v.team_members(spark, path))


@register
def group_dependencies(spark, path):
    members = v.pipeline_members(spark, path).select("member", "grp")
    return gz.group_dependencies(members, v.pipeline_inputs(spark, path), v.pipeline_zones(spark, path))


@register
def pipeline_levels(spark, path):
    """Brands, types and the report in the order in which they can be placed, found from what their members read."""
    members = v.pipeline_members(spark, path).select("member", "grp")
    return gz.find_levels(members, v.pipeline_inputs(spark, path))


@register
def place_in_order(spark, path):
    return gz.place_in_order(
        v.pipeline_members(spark, path),
        v.pipeline_inputs(spark, path),
        v.pipeline_zones(spark, path),
        v.latency(spark, path),
    )


@register
def place_in_order_slots(spark, path):
    """As above, where only nations with free slots can take a group."""
    return gz.place_in_order(
        v.pipeline_members(spark, path),
        v.pipeline_inputs(spark, path),
        v.pipeline_zones(spark, path),
        v.latency(spark, path),
        slots=v.free_slots(spark, path),
    )


# --- work lists -------------------------------------------------------------------------------------------


def item_zones(spark: SparkSession, path: str) -> DataFrame:
    return written(v.item_zones(spark, path), "item-zones")


@register
def assign_zone_quota(spark, path):
    items = v.with_quota(v.items(spark, path).select("grp", "item"), ["grp"], QUOTA_SHARE)
    return gz.assign_zone_quota(items, item_zones(spark, path), "quota")


@register
def assign_member_quota(spark, path):
    """A list and a quota for each status of a segment; regions without suppliers take nothing."""
    items = v.with_quota(v.items(spark, path), ["grp", "member"], QUOTA_SHARE)
    slots = v.slots(spark, path)
    return gz.assign_zone_quota(items, item_zones(spark, path), "quota", slots=slots, group=["grp", "member"])


@register
def assign_zone_even(spark, path):
    items = v.items(spark, path).select("grp", "item")
    return gz.assign_zone_even(items, item_zones(spark, path))


@register
def assign_even_by_date(spark, path):
    """The orders of a region, by date, to its nations in turn."""
    zones = written(v.region_nations(spark, path), "region-nations")
    return gz.assign_zone_even(v.dated_items(spark, path), zones, order=["at", "item"])


@register
def assign_slots(spark, path):
    """Orders of a region and month to the region's suppliers: mostly more orders than suppliers."""
    items = v.zoned_items(spark, path).select("item", "zone", "month")
    return gz.assign_slots(items, v.slots(spark, path), ["zone", "month"], seed=SEED)


@register
def assign_slots_few(spark, path):
    """Orders of a region and day: fewer orders than suppliers, so slots are drawn."""
    items = v.zoned_items(spark, path).select("item", "zone", "day")
    return gz.assign_slots(items, v.slots(spark, path), ["zone", "day"], seed=SEED)


@register
def assign_group(spark, path):
    """Parts of a brand to the suppliers of the brand's best nation; groups that are no brand have no items."""
    members = v.pipeline_members(spark, path).select("member", "grp")
    deps = gz.group_dependencies(members, v.pipeline_inputs(spark, path), v.pipeline_zones(spark, path))
    chosen = gz.best_zone(deps, latency_table(spark, path))
    items = v.table(spark, path, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("grp"))
    return gz.assign_group(items, chosen, v.slots(spark, path, "nation"), seed=SEED)


@register
def unassigned(spark, path):
    """Suppliers as items of several regions: what is placed in one region may be left over in another."""
    items = v.with_quota(v.member_items(spark, path), ["grp"], QUOTA_SHARE)
    zones = written(v.region_nations(spark, path), "region-nations")
    return gz.unassigned(items.select("grp", "item"), gz.assign_zone_quota(items, zones, "quota"))


@register
def spread_rest(spark, path):
    # What is numbered is read three times, so it starts from tables.
    items = written(v.items(spark, path).select("grp", "item"), "items")
    placed = written(assign_zone_quota(spark, path).select("grp", "item"), "quota")
    return gz.spread_rest(items, placed, v.slots(spark, path), seed=SEED)


@register
def first_slot_per_host(spark, path):
    """The lowest supplier of each nation, nations as hosts in their region."""
    free = v.slots(spark, path, "nation").withColumnRenamed("zone", "host")
    hosts = v.nations(spark, path).select(F.col("nation").alias("host"), F.col("region").alias("zone"))
    return gz.first_slot_per_host(free, hosts)


@register
def expand_ranges(spark, path):
    return gz.expand_ranges(v.line_ranges(spark, path), "first_line", "last_line").select("l_orderkey", "id")


# --- metadata formats -------------------------------------------------------------------------------------


@register
def source_zones(spark, path):
    """Written as text and read back."""
    out = scratch_path(spark, "source-zones")
    gz.write_source_zones(v.source_zones(spark, path), out)
    return gz.read_source_zones(spark, out)


@register
def latency_matrix(spark, path):
    """One matrix file per order status, written as text and read back; pairs without orders are 0."""
    out = scratch_path(spark, "latency-matrix")
    gz.write_latency_matrix(v.latency_snapshots(spark, path), out)
    matrices = gz.read_latency_matrices(spark, out)
    return matrices.withColumn("snapshot", F.regexp_extract("snapshot", "snapshot=([^/]*)/", 1))


@register
def zone_members(spark, path):
    return gz.zone_members(v.members(spark, path), line_members=LINE_MEMBERS)


@register
def zone_members_by_time(spark, path):
    """Members in the order of their first delivery."""
    return gz.zone_members(v.timed_members(spark, path), order="at", line_members=LINE_MEMBERS)


@register
def zone_members_roundtrip(spark, path):
    out = scratch_path(spark, "zone-members")
    gz.write_zone_members(v.members(spark, path), out, line_members=LINE_MEMBERS)
    return gz.read_zone_members(spark, out)


@register
def stream_zone_members(spark, path):
    """Nations placed in and withdrawn from kinds of events, in three runs, some changes days late: the lines after the last."""
    source, out = scratch_path(spark, "changes"), scratch_path(spark, "stream-members")
    changes = v.member_changes(spark, path)
    for run in range(v.ARRIVALS):
        changes.filter(F.col("run") == run).drop("run").write.mode("append").parquet(source)
        stream = spark.readStream.schema(changes.drop("run").schema).parquet(source)
        gz.start_zone_members(stream, f"{out}/table", f"{out}/checkpoint", line_members=LINE_MEMBERS // 4).awaitTermination()
    return gz.current_lines(spark, f"{out}/table")


@register
def member_zone(spark, path):
    return gz.member_zone(v.members(spark, path))


@register
def json_settings(spark, path):
    """The setting `k` of each event as a number, and a setting that is absent and so has its default."""
    events = v.table(spark, path, "events").select("event_id", "props")
    settings = {"k": ("bigint", None), "TaskPerCloud": ("int", 1)}
    parsed = gz.settings_from_json(events, "props", settings, required=["k"])
    return parsed.select("event_id", "k", F.col("TaskPerCloud").alias("per_zone"))


@register
def placement_report(spark, path):
    quota = written(assign_zone_quota(spark, path), "quota")
    placed = gz.assign_slots(quota.select("item", "grp", "zone"), v.slots(spark, path), ["grp", "zone"], seed=SEED)
    placed = written(placed, "placed")
    return gz.placement_report(placed, placed.select("grp", "zone"), line_entries=LINE_MEMBERS)
