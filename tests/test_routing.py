"""Routing stays in the zone, falls back when it must, and is repeatable."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import geozone as gz

TARGETS = [(10, 0), (11, 1), (12, 2), (10, 3)]  # target 10 is wanted twice
MEMBERS = [("a", 10), ("a", 12), ("b", 11), ("c", 12), ("a", 1), ("b", 2), ("d", 3), ("a", 10)]


@pytest.fixture(scope="module")
def lists(spark):
    targets = spark.createDataFrame(TARGETS, "target bigint, target_ord int")
    return gz.target_lists(targets, members(spark))


def members(spark):
    return spark.createDataFrame(MEMBERS, "zone string, member bigint")


def test_lists_keep_order_and_repeats(lists):
    got = {}
    for r in lists.orderBy("list", "k").collect():
        got.setdefault(r["list"], []).append(r.target)
    # Target 12 is in two zones, so both lists have it; the zones of no target have no list.
    assert got == {"zone:a": [10, 12, 10], "zone:b": [11], "zone:c": [12], "all": [10, 11, 12, 10]}


def test_eligible_targets(spark, lists):
    sources = spark.createDataFrame([(1,), (2,), (3,), (4,)], "source bigint")
    got = sorted(tuple(r) for r in gz.eligible_targets(sources, lists, members(spark)).collect())
    assert got == [(1, "a", "zone:a", 3, True), (2, "b", "zone:b", 1, True), (3, "d", "all", 4, False), (4, None, "all", 4, False)]


def number(*keys):
    return int(hashlib.md5("\x01".join(keys).encode()).hexdigest()[:8], 16)


def test_by_key_matches_hash_by_hand(spark, lists):
    rng = random.Random(3)
    rows = [(i, rng.choice("abcde"), rng.randrange(20), rng.choice(["x", "y"])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, zone string, user int, kind string")
    by_zone = {"a": [10, 12, 10], "b": [11], "c": [12]}
    for r in gz.route_by_key(df, "zone", ["user", "kind"], lists, hash="md5").collect():
        eligible = by_zone.get(r.zone, [10, 11, 12, 10])
        assert r.target == eligible[number(str(r.user), r.kind) % len(eligible)]
        assert r.is_local == (r.zone in by_zone)


def test_same_key_same_target_and_every_row_once(spark, lists):
    df = spark.range(3_000).select("id", F.lit("a").alias("zone"), (F.col("id") % 7).alias("key"))
    routed = gz.route_by_key(df, "zone", ["key"], lists, hash="xxhash64")
    assert routed.count() == 3_000
    assert routed.groupBy("zone", "key").agg(F.countDistinct("target").alias("n")).filter("n > 1").count() == 0


def test_null_keys_and_default_key(spark, lists):
    df = spark.createDataFrame([(None, "a"), ("k", "a")], "key string, zone string")
    explicit = {r.key: r.target for r in gz.route_by_key(df, "zone", ["key"], lists).collect()}
    first_column = {r.key: r.target for r in gz.route_by_key(df, "zone", None, lists).collect()}
    assert explicit == first_column
    assert explicit[None] in (10, 12)
    # No key at all is one constant key.
    assert len({r.target for r in gz.route_by_key(df, "zone", [], lists).collect()}) == 1


def test_no_target_at_all(spark):
    none = gz.target_lists(spark.createDataFrame([], "target bigint, target_ord int"), members(spark))
    df = spark.createDataFrame([(1, "a")], "id int, zone string")
    row = gz.route_by_key(df, "zone", ["id"], none).first()
    assert row.target is None and row.is_local is False


def test_random_is_repeatable_and_even(spark, lists):
    df = spark.range(6_000).select("id", F.lit("a").alias("zone"))
    one = gz.route_random(df, "zone", ["id"], lists, seed=1)
    again = gz.route_random(df.repartition(5), "zone", ["id"], lists, seed=1)
    assert one.exceptAll(again).count() == 0
    assert one.exceptAll(gz.route_random(df, "zone", ["id"], lists, seed=2)).count() > 0
    counts = {r.target: r["count"] for r in one.groupBy("target").count().collect()}
    assert abs(counts[10] - 4_000) < 300 and abs(counts[12] - 2_000) < 300


def test_unknown_hash(spark, lists):
    with pytest.raises(ValueError):
        gz.route_by_key(spark.range(1).withColumn("zone", F.lit("a")), "zone", ["id"], lists, hash="crc")


def test_colocate(spark):
    df = spark.range(5_000).select((F.col("id") % 3).alias("zone"), (F.col("id") % 50).alias("key"))
    together = gz.colocate(df, "zone", ["key"]).withColumn("task", F.spark_partition_id())
    tasks = together.groupBy("zone", "key").agg(F.countDistinct("task").alias("n"), F.count("*").alias("rows"))
    assert tasks.filter("n != 1").count() == 0
    assert tasks.agg(F.sum("rows")).first()[0] == 5_000
    assert gz.colocate(df, "zone", ["key"], strict=False).count() == 5_000


def test_hot_zone_with_many_targets(spark):
    """A third of all rows and targets in one zone: numbers, not lists, so nothing is gathered."""
    targets = spark.range(20_000).select(F.col("id").alias("target"), F.col("id").alias("target_ord"))
    zone = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("z"), (F.col("id") % 100).cast("string")))
    homes = spark.range(20_000).select(zone.alias("zone"), F.col("id").alias("member"))
    many = gz.target_lists(targets, homes)
    df = spark.range(20_000).select("id", zone.alias("zone"))
    routed = gz.route_by_key(df, "zone", ["id"], many)
    home = homes.select(F.col("zone").alias("home"), F.col("member").alias("target"))
    wrong = routed.join(home, "target").filter("zone != home")
    assert wrong.count() == 0
    assert routed.filter("target is null or not is_local").count() == 0


def landed(df, **how):
    """(task, zone, key) -> rows."""
    dealt = gz.colocate_zones(df, "zone", ["key"], **how).withColumn("task", F.spark_partition_id())
    return {(r.task, r.zone, r.key): r["count"] for r in dealt.groupBy("task", "zone", "key").count().collect()}


@pytest.mark.parametrize("spread", [None, 1.5])
def test_tasks_belong_to_zones(spark, spread):
    """A zone with most rows owns most tasks; a hot key is spread inside its zone's block only, and only where asked."""
    zone = F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 < 9, F.lit("warm")).when(F.col("id") % 3 == 0, F.lit(None))
    key = F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 40)
    df = spark.range(4_000).select("id", zone.otherwise(F.lit("cold")).alias("zone"), key.alias("key"))
    found = landed(df, n_partitions=20, spread=spread)
    zones_of, tasks_of_key, tasks_of_zone = {}, {}, {}
    for task, zone, key in found:
        zones_of.setdefault(task, set()).add(zone)
        tasks_of_key.setdefault((zone, key), set()).add(task)
        tasks_of_zone.setdefault(zone, set()).add(task)
    assert all(len(z) == 1 for z in zones_of.values())
    assert sum(found.values()) == 4_000 and set(tasks_of_zone) == {"hot", "warm", "cold", None}
    assert len(tasks_of_zone["hot"]) > len(tasks_of_zone["warm"]) >= len(tasks_of_zone["cold"])
    split = {k for k, tasks in tasks_of_key.items() if len(tasks) > 1}
    # Key 0 has 1,600 rows of the hot zone and 400 of the warm one, an even task 200.
    assert split == ({("hot", 0), ("warm", 0)} if spread else set())


def test_tasks_of_an_empty_table(spark):
    assert landed(spark.createDataFrame([], "zone string, key int")) == {}
