"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geozone.operators.ordinal import short_ordinal
from geozone.operators.placement import SOURCE, STEP
from geozone.operators.tagging import observed_latency

# Suppliers with more than this balance have free slots in the ordered placement with slots.
FREE_BALANCE = 7000
# Events arrive in so many runs, by the day of the month; one in LATE_SHARE comes LATE_DAYS later.
ARRIVALS = 3
RUN_DAYS = 14
LATE_SHARE = 50
LATE_DAYS = 10
# Events beyond this value withdraw a member, others place it.
WITHDRAWN_VALUE = 60


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def arrival() -> Column:
    """The run in which an event arrives."""
    late = F.when(F.col("event_id") % LATE_SHARE == 0, F.lit(LATE_DAYS)).otherwise(F.lit(0))
    return F.least(F.floor((F.day("ts") + late) / RUN_DAYS), F.lit(ARRIVALS - 1))


def stream(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table as a stream of its files; the pattern matches a single file as well as a folder of files."""
    schema = table(spark, path, name).schema
    return spark.readStream.schema(schema).parquet(f"{path}/{name}.{{parquet}}")


def nations(spark: SparkSession, path: str) -> DataFrame:
    nation, region = table(spark, path, "nation"), table(spark, path, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )


def customers(spark: SparkSession, path: str) -> DataFrame:
    customer, nation = table(spark, path, "customer"), nations(spark, path)
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        "c_custkey", "c_mktsegment", "nation", "region"
    )


def suppliers(spark: SparkSession, path: str) -> DataFrame:
    supplier, nation = table(spark, path, "supplier"), nations(spark, path)
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        "s_suppkey", "s_acctbal", "nation", "region"
    )


def with_zones(events: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Events, from a table or a stream, with the region of their user as zone and exact values."""
    home = customers(spark, path).select("c_custkey", "nation", F.col("region").alias("zone"))
    return events.join(home, F.col("user_id") == F.col("c_custkey")).select(
        "event_id", "ts", "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"), "nation", "zone"
    )


def zoned_events(spark: SparkSession, path: str) -> DataFrame:
    return with_zones(table(spark, path, "events"), spark, path)


def source_zones(spark: SparkSession, path: str) -> DataFrame:
    pairs = zoned_events(spark, path).select(F.col("event_type").alias("source"), "zone").distinct()
    numbered = short_ordinal(pairs, ["source"], ["zone"], out="zone_ord")
    return numbered.select("source", "zone", F.col("zone_ord").cast("int").alias("zone_ord"))


def targets(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_suppkey").alias("target_ord"))


def supplier_nations(spark: SparkSession, path: str) -> DataFrame:
    return suppliers(spark, path).select(F.col("nation").alias("zone"), F.col("s_suppkey").alias("member"))


def remaining_targets(spark: SparkSession, path: str, run: int) -> DataFrame:
    """The targets that are there in a run of arrivals: in each, other suppliers are away."""
    return targets(spark, path).filter(F.col("target") % ARRIVALS != run)


def trips(spark: SparkSession, path: str) -> DataFrame:
    """One row per lineitem: supplier and customer nation keys and the days between order and shipping."""
    customer = table(spark, path, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, path, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, path, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    lineitem = table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    # Customers join the smaller orders first, so the widest table is shuffled once.
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    shipped = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return shipped.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey",
        "l_linenumber",
        "s_nationkey",
        "c_nationkey",
        "o_orderstatus",
        F.abs(F.datediff("l_shipdate", "o_orderdate")).cast("bigint").alias("days"),
    )


def dated_trips(spark: SparkSession, path: str) -> DataFrame:
    """As `trips`, with the day of the order."""
    orders = table(spark, path, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return trips(spark, path).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def quarterly_latency(trips: DataFrame) -> DataFrame:
    """Latencies measured in each quarter, known from the first day of the next, on nation keys."""
    known = F.add_months(F.trunc("day", "quarter"), 3)
    return observed_latency(trips.withColumn("at", known), "s_nationkey", "c_nationkey", "days", by=["at"])


def name_zones(latency: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Nation names for a latency table on nation keys."""
    nation = table(spark, path, "nation")
    start = nation.select(F.col("n_nationkey").alias("from_zone"), F.col("n_name").alias("from_name"))
    end = nation.select(F.col("n_nationkey").alias("to_zone"), F.col("n_name").alias("to_name"))
    named = latency.join(start, "from_zone").join(end, "to_zone")
    rest = [c for c in latency.columns if c not in ("from_zone", "to_zone")]
    return named.select(F.col("from_name").alias("from_zone"), F.col("to_name").alias("to_zone"), *rest)


def latency(spark: SparkSession, path: str) -> DataFrame:
    """Measured on nation keys first, so that names are looked up for the few pairs only."""
    return name_zones(observed_latency(trips(spark, path), "s_nationkey", "c_nationkey", "days"), spark, path)


def latency_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One latency table per order status."""
    measured = observed_latency(trips(spark, path), "s_nationkey", "c_nationkey", "days", by=["o_orderstatus"])
    return name_zones(measured, spark, path).withColumnRenamed("o_orderstatus", "snapshot")


def order_deps(spark: SparkSession, path: str) -> DataFrame:
    """The nations of an order's suppliers."""
    lineitem = table(spark, path, "lineitem").select("l_orderkey", "l_suppkey")
    return lineitem.join(suppliers(spark, path), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("grp"), F.col("nation").alias("zone")
    )


def snapshot_deps(spark: SparkSession, path: str) -> DataFrame:
    """As `order_deps`, with the order's status as snapshot."""
    orders = table(spark, path, "orders").select("o_orderkey", F.col("o_orderstatus").alias("snapshot"))
    deps = order_deps(spark, path)
    return deps.join(orders, F.col("grp") == F.col("o_orderkey")).select("snapshot", "grp", "zone")


def free_slots(spark: SparkSession, path: str) -> DataFrame:
    """Suppliers with free slots, by nation."""
    free = suppliers(spark, path).filter(F.col("s_acctbal") > FREE_BALANCE)
    return free.select(F.col("nation").alias("zone"), F.col("s_suppkey").alias("slot"))


def items(spark: SparkSession, path: str) -> DataFrame:
    """Orders to hand out, per market segment, with their status as member."""
    orders = table(spark, path, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customer = table(spark, path, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("grp"), F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("member")
    )


def with_quota(items: DataFrame, by: list[str], share: int) -> DataFrame:
    """`items` with the column `quota`: one `share`-th of the number of items of the same list."""
    sizes = items.groupBy(*by).agg(F.floor(F.count(F.lit(1)) / share).alias("quota"))
    return items.join(sizes, by)


def dated_items(spark: SparkSession, path: str) -> DataFrame:
    """Orders per region of their customer, with their date."""
    orders = table(spark, path, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.join(customers(spark, path), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("region").alias("grp"), F.col("o_orderkey").alias("item"), F.col("o_orderdate").alias("at")
    )


def region_nations(spark: SparkSession, path: str) -> DataFrame:
    """The nations of each region, by name."""
    pairs = nations(spark, path).select(F.col("region").alias("grp"), F.col("nation").alias("zone"))
    return short_ordinal(pairs, ["grp"], ["zone"], out="zone_ord")


def member_items(spark: SparkSession, path: str) -> DataFrame:
    """Suppliers as items of the regions they deliver to; a supplier is an item of several groups."""
    return members(spark, path).select(F.col("zone").alias("grp"), F.col("member").alias("item"))


def timed_members(spark: SparkSession, path: str) -> DataFrame:
    """Suppliers in the regions they deliver to, with the time of the first order."""
    orders = table(spark, path, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    bought = orders.join(customers(spark, path), F.col("o_custkey") == F.col("c_custkey"))
    lineitem = table(spark, path, "lineitem").select("l_orderkey", "l_suppkey")
    found = lineitem.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    return found.groupBy(F.col("region").alias("zone"), F.col("l_suppkey").alias("member")).agg(F.min("o_orderdate").alias("at"))


def zoned_items(spark: SparkSession, path: str) -> DataFrame:
    """Orders in the region of their customer, with month and day."""
    orders = table(spark, path, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.join(customers(spark, path), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("item"),
        F.col("region").alias("zone"),
        F.trunc("o_orderdate", "month").alias("month"),
        F.col("o_orderdate").cast("date").alias("day"),
    )


def item_zones(spark: SparkSession, path: str) -> DataFrame:
    """The regions in which a market segment has customers, by name."""
    pairs = customers(spark, path).select(F.col("c_mktsegment").alias("grp"), F.col("region").alias("zone"))
    return short_ordinal(pairs.distinct(), ["grp"], ["zone"], out="zone_ord")


def slots(spark: SparkSession, path: str, zone: str = "region") -> DataFrame:
    return suppliers(spark, path).select(
        F.col(zone).alias("zone"), F.col("s_suppkey").alias("slot"), F.col("s_suppkey").alias("slot_ord")
    )


def members(spark: SparkSession, path: str) -> DataFrame:
    """Suppliers in the regions they deliver to."""
    orders = table(spark, path, "orders").select("o_orderkey", "o_custkey")
    bought = orders.join(customers(spark, path), F.col("o_custkey") == F.col("c_custkey"))
    lineitem = table(spark, path, "lineitem").select("l_orderkey", "l_suppkey")
    return (
        lineitem.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("region").alias("zone"), F.col("l_suppkey").alias("member"))
        .distinct()
    )


def member_changes(spark: SparkSession, path: str) -> DataFrame:
    """A customer's nation is placed in a zone, the kind of their event, with each event; a value beyond WITHDRAWN_VALUE withdraws it."""
    home = customers(spark, path).select("c_custkey", F.col("nation"))
    nation = nations(spark, path).select("nation", F.col("n_nationkey").alias("member"))
    change = F.when(F.col("value") > WITHDRAWN_VALUE, F.lit("withdrawn")).otherwise(F.lit("placed"))
    events = table(spark, path, "events").withColumn("run", arrival())
    found = events.join(home, F.col("user_id") == F.col("c_custkey")).join(nation, "nation")
    return found.select("run", F.col("event_type").alias("zone"), "member", change.alias("change"), F.col("ts").cast("timestamp").alias("at"))


def labelled(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def team_members(spark: SparkSession, path: str) -> DataFrame:
    """Suppliers as sources in the group of their nation; customers and parts as steps."""
    source = suppliers(spark, path).select(
        labelled("supplier:", "s_suppkey").alias("member"), F.lit(SOURCE).alias("kind"), F.col("nation").alias("grp")
    )
    buyers = customers(spark, path).select(
        labelled("customer:", "c_custkey").alias("member"), F.lit(STEP).alias("kind"), F.col("nation").alias("grp")
    )
    goods = table(spark, path, "part").select(
        labelled("part:", "p_partkey").alias("member"), F.lit(STEP).alias("kind"), F.col("p_brand").alias("grp")
    )
    return source.unionByName(buyers).unionByName(goods)


def pipeline_members(spark: SparkSession, path: str) -> DataFrame:
    """Level 1: parts by brand. Level 2: one report per part type. Level 3: one report over all types."""
    part = table(spark, path, "part")
    goods = part.select(labelled("part:", "p_partkey").alias("member"), F.col("p_brand").alias("grp"), F.lit(1).alias("level"))
    types = part.select(labelled("type:", "p_type").alias("member"), F.col("p_type").alias("grp"), F.lit(2).alias("level"))
    whole = part.select(F.lit("report").alias("member"), F.lit("report").alias("grp"), F.lit(3).alias("level"))
    return goods.unionByName(types.distinct()).unionByName(whole.distinct())


def pipeline_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Parts read the suppliers of their lineitems, types read their parts, the last report reads all types."""
    part = table(spark, path, "part")
    lineitem = table(spark, path, "lineitem")
    pairs = lineitem.select("l_partkey", "l_suppkey").distinct()
    deliveries = pairs.select(
        labelled("part:", "l_partkey").alias("member"), labelled("supplier:", "l_suppkey").alias("input")
    )
    parts = part.select(labelled("type:", "p_type").alias("member"), labelled("part:", "p_partkey").alias("input"))
    types = part.select(F.lit("report").alias("member"), labelled("type:", "p_type").alias("input"))
    return deliveries.unionByName(parts).unionByName(types.distinct())


def pipeline_zones(spark: SparkSession, path: str) -> DataFrame:
    return suppliers(spark, path).select(labelled("supplier:", "s_suppkey").alias("member"), F.col("nation").alias("zone"))


def line_ranges(spark: SparkSession, path: str) -> DataFrame:
    lineitem = table(spark, path, "lineitem")
    return lineitem.groupBy("l_orderkey").agg(
        F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line")
    )
