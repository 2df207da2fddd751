"""Work lists: quotas, even slices, slots in turn, ranges, leftovers."""

import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import geozone as gz


def items_of(spark, sizes):
    rows = [(g, 100 * k + i) for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "grp string, item bigint")


def zones_of(spark, zones):
    rows = [(g, z, i) for g, zs in zones.items() for i, z in enumerate(zs)]
    return spark.createDataFrame(rows, "grp string, zone string, zone_ord int")


def slots_of(spark, slots):
    rows = [(z, s, i) for z, ss in slots.items() for i, s in enumerate(ss)]
    return spark.createDataFrame(rows, "zone string, slot bigint, slot_ord int")


def by_zone(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.grp, r.zone_ord, r.zone), []).append(r.item)
    return {k: sorted(v) for k, v in out.items()}


class TestQuota:
    def test_slices(self, spark):
        got = gz.assign_zone_quota(items_of(spark, {"g": 10}), zones_of(spark, {"g": ["a", "b", "c"]}), 3)
        assert by_zone(got) == {("g", 0, "a"): [0, 1, 2], ("g", 1, "b"): [3, 4, 5], ("g", 2, "c"): [6, 7, 8]}

    def test_all_or_nothing(self, spark):
        items = items_of(spark, {"few": 5, "enough": 6, "none": 0})
        zones = zones_of(spark, {"few": ["a", "b"], "enough": ["a", "b"], "none": ["a"]})
        got = by_zone(gz.assign_zone_quota(items, zones, 3))
        assert set(got) == {("enough", 0, "a"), ("enough", 1, "b")}

    def test_repeated_zone_takes_two_slices(self, spark):
        got = by_zone(gz.assign_zone_quota(items_of(spark, {"g": 4}), zones_of(spark, {"g": ["a", "a"]}), 2))
        assert got == {("g", 0, "a"): [0, 1], ("g", 1, "a"): [2, 3]}

    def test_zone_without_slots_uses_up_its_range(self, spark):
        slots = slots_of(spark, {"a": [1], "c": [2]})
        zones = zones_of(spark, {"g": ["a", "b", "c"]})
        got = by_zone(gz.assign_zone_quota(items_of(spark, {"g": 6}), zones, 2, slots=slots))
        assert got == {("g", 0, "a"): [0, 1], ("g", 2, "c"): [4, 5]}

    def test_large_quota_and_quota_column(self, spark):
        """More items per group than fit the first-rows plan, and a quota per group."""
        items = items_of(spark, {"g": 50, "h": 50}).withColumn("quota", F.when(F.col("grp") == "g", 2).otherwise(25))
        zones = zones_of(spark, {"g": ["a", "b"], "h": ["a", "b"]})
        got = by_zone(gz.assign_zone_quota(items, zones, "quota"))
        assert {k: len(v) for k, v in got.items()} == {("g", 0, "a"): 2, ("g", 1, "b"): 2, ("h", 0, "a"): 25, ("h", 1, "b"): 25}
        many = spark.range(3_000).select(F.lit("g").alias("grp"), F.col("id").alias("item"))
        got = by_zone(gz.assign_zone_quota(many, zones_of(spark, {"g": ["a", "b"]}), 1_200))
        assert got == {("g", 0, "a"): list(range(1_200)), ("g", 1, "b"): list(range(1_200, 2_400))}

    def test_zero_quota_and_no_zones(self, spark):
        items = items_of(spark, {"g": 4})
        assert gz.assign_zone_quota(items, zones_of(spark, {"g": ["a"]}), 0).count() == 0
        assert gz.assign_zone_quota(items, zones_of(spark, {"h": ["a"]}), 1).count() == 0

    def test_quota_per_member(self, spark):
        rows = [("g", m, 10 * k + i, q) for k, (m, n, q) in enumerate((("x", 5, 2), ("y", 4, 1), ("z", 3, 2))) for i in range(n)]
        items = spark.createDataFrame(rows, "grp string, member string, item bigint, quota int")
        got = gz.assign_zone_quota(items, zones_of(spark, {"g": ["a", "b"]}), "quota", group=["grp", "member"]).collect()
        # z has fewer items than both zones need together.
        assert sorted((r.member, r.zone, r.item) for r in got) == [
            ("x", "a", 0), ("x", "a", 1), ("x", "b", 2), ("x", "b", 3), ("y", "a", 10), ("y", "b", 11)
        ]
        with pytest.raises(ValueError, match="grp"):
            gz.assign_zone_quota(items, zones_of(spark, {"g": ["a"]}), 1, group=["member"])


def test_even_slices_leave_the_remainder(spark):
    items = items_of(spark, {"g": 11, "tiny": 2})
    got = by_zone(gz.assign_zone_even(items, zones_of(spark, {"g": ["a", "b", "c"], "tiny": ["a", "b", "c"]})))
    assert got == {("g", 0, "a"): [0, 1, 2], ("g", 1, "b"): [3, 4, 5], ("g", 2, "c"): [6, 7, 8]}


def test_even_slices_by_hint_and_by_time(spark):
    zones = zones_of(spark, {"g": ["a", "b", "c"]})
    got = by_zone(gz.assign_zone_even(items_of(spark, {"g": 8}), zones, hint=6))
    assert got == {("g", 0, "a"): [0, 1], ("g", 1, "b"): [2, 3], ("g", 2, "c"): [4, 5]}
    got = by_zone(gz.assign_zone_even(items_of(spark, {"g": 8}), zones, hint=11))
    assert got == {("g", 0, "a"): [0, 1, 2], ("g", 1, "b"): [3, 4, 5], ("g", 2, "c"): [6, 7]}
    timed = items_of(spark, {"g": 6}).withColumn("at", F.date_sub(F.lit("2024-01-10").cast("date"), F.floor(F.col("item") / 2).cast("int")))
    got = by_zone(gz.assign_zone_even(timed, zones, order=["at", "item"]))
    assert got == {("g", 0, "a"): [4, 5], ("g", 1, "b"): [2, 3], ("g", 2, "c"): [0, 1]}


class TestSlots:
    def assign(self, spark, sizes, slots, **options):
        rows = [(z, 1000 * k + i) for k, (z, n) in enumerate(sizes.items()) for i in range(n)]
        items = spark.createDataFrame(rows, "zone string, item bigint")
        return {r.item: r.slot for r in gz.assign_slots(items, slots_of(spark, slots), **options).collect()}

    def test_in_turn(self, spark):
        got = self.assign(spark, {"a": 7, "b": 2}, {"a": [30, 10, 20], "b": [5, 6]})
        assert [got[i] for i in range(7)] == [30, 10, 20, 30, 10, 20, 30]
        assert [got[1000], got[1001]] == [5, 6]

    def test_few_items_draw(self, spark):
        got = self.assign(spark, {"a": 2}, {"a": [1, 2, 3, 4, 5]}, seed=9)
        for item, slot in got.items():
            drawn = int(hashlib.md5(f"9\x01{item}".encode()).hexdigest()[:8], 16) % 5
            assert slot == drawn + 1

    def test_zone_without_slots(self, spark):
        assert self.assign(spark, {"a": 2, "b": 2}, {"b": [7]}) == {1000: 7, 1001: 7}

    def test_turn_restarts_per_group(self, spark):
        items = spark.createDataFrame([("a", "g", 1), ("a", "g", 2), ("a", "h", 3), ("a", "h", 4)], "zone string, grp string, item bigint")
        got = gz.assign_slots(items, slots_of(spark, {"a": [1, 2]}), ["grp", "zone"]).collect()
        assert sorted((r.item, r.slot) for r in got) == [(1, 1), (2, 2), (3, 1), (4, 2)]
        with pytest.raises(ValueError):
            gz.assign_slots(items, slots_of(spark, {"a": [1]}), ["grp"])

    @settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(n_items=st.integers(1, 60), n_slots=st.integers(1, 12))
    def test_loads_differ_by_one_at_most(self, spark, n_items, n_slots):
        got = self.assign(spark, {"a": n_items}, {"a": list(range(n_slots))})
        assert len(got) == n_items
        if n_items >= n_slots:
            loads = [list(got.values()).count(s) for s in range(n_slots)]
            assert max(loads) - min(loads) <= 1

    def test_group_goes_to_its_zone(self, spark):
        items = items_of(spark, {"g": 3, "h": 2, "lost": 2, "empty": 1})
        chosen = spark.createDataFrame([("g", "a"), ("h", "b"), ("lost", None), ("empty", "c")], "grp string, zone string")
        got = gz.assign_group(items, chosen, slots_of(spark, {"a": [1, 2], "b": [3]})).collect()
        assert sorted((r.grp, r.zone, r.slot) for r in got) == [("g", "a", 1), ("g", "a", 1), ("g", "a", 2), ("h", "b", 3), ("h", "b", 3)]


def test_first_slot_per_host(spark):
    slots = spark.createDataFrame([("h1", 5, 1), ("h1", 9, 0), ("h2", 3, 0), ("h3", 1, 0)], "host string, slot bigint, slot_ord int")
    hosts = spark.createDataFrame([("h1", "a"), ("h2", "a"), ("h3", None), ("h4", "b")], "host string, zone string")
    assert sorted(tuple(r) for r in gz.first_slot_per_host(slots, hosts).collect()) == [("a", "h1", 9), ("a", "h2", 3)]


class TestRanges:
    def test_inclusive_and_empty(self, spark):
        df = spark.createDataFrame([("x", 3, 5), ("y", 4, 3), ("z", 7, 7), ("n", None, 2)], "name string, a int, b int")
        got = sorted((r.name, r.id) for r in gz.expand_ranges(df, "a", "b").collect())
        assert got == [("x", 3), ("x", 4), ("x", 5), ("z", 7)]

    def test_start_only(self, spark):
        df = spark.createDataFrame([("x", 3, 5)], "name string, a int, b int")
        assert [r.id for r in gz.expand_ranges(df, "a", "b", start_only=True).collect()] == [3]

    @pytest.mark.parametrize("chunk", [1, 7, 100])
    def test_chunks_do_not_show(self, spark, chunk):
        df = spark.createDataFrame([(-20, 30)], "a int, b int")
        assert sorted(r.id for r in gz.expand_ranges(df, "a", "b", chunk=chunk).collect()) == list(range(-20, 31))


def test_leftovers(spark):
    items = items_of(spark, {"g": 10})
    placed = gz.assign_zone_quota(items, zones_of(spark, {"g": ["a", "b"]}), 3)
    rest = gz.unassigned(items, placed)
    assert sorted(r.item for r in rest.collect()) == [6, 7, 8, 9]
    spread = gz.spread_rest(items, placed, slots_of(spark, {"a": [1], "b": [2, 3]}))
    assert spread.columns == ["grp", "item", "slot"]
    # One slot list over all zones, ordered by slot_ord and slot: 1, 2, 3.
    assert {r.item: r.slot for r in spread.collect()} == {6: 1, 7: 2, 8: 3, 9: 1}


def test_leftovers_of_groups_that_share_item_ids(spark):
    items = spark.createDataFrame([("a", 1), ("b", 1), (None, 1), ("b", None)], "grp string, item bigint")
    placed = spark.createDataFrame([("a", 1), (None, 1)], "grp string, item bigint")
    rest = gz.unassigned(items, placed)
    assert sorted(map(str, rest.collect())) == ["Row(grp='b', item=1)", "Row(grp='b', item=None)"]
    assert gz.unassigned(items, placed, keys=["item"]).count() == 1
    spread = gz.spread_rest(items.filter("item = 1"), placed, slots_of(spark, {"z": [5, 6]}))
    assert [(r.grp, r.item) for r in spread.collect()] == [("b", 1)]


def test_names_as_items(spark):
    items = spark.range(50).select(F.lit("g").alias("grp"), F.format_string("item-%03d", F.col("id")).alias("item"))
    nothing = spark.createDataFrame([], "grp string, item string")
    spread = gz.spread_rest(items, nothing, slots_of(spark, {"z": [7, 8, 9]})).collect()
    assert {r.item: r.slot for r in spread} == {f"item-{k:03d}": 7 + k % 3 for k in range(50)}


def test_wide_ranges_are_dealt_before_they_are_opened(spark):
    df = spark.createDataFrame([("x", 0, 10**6)], "name string, a bigint, b bigint")
    wide = gz.expand_ranges(df, "a", "b", chunk=100)
    assert "REPARTITION" in wide._jdf.queryExecution().executedPlan().toString()
    assert wide.agg(F.count("id"), F.countDistinct("id"), F.max("id")).first()[:] == (10**6 + 1, 10**6 + 1, 10**6)


def test_eight_items_on_four_hosts(spark):
    """Four hosts of four slots, eight items: every item is placed."""
    items = spark.range(8).select(F.col("id").alias("item"))
    slots = spark.range(16).select((F.col("id") / 4).cast("int").cast("string").alias("zone"), F.col("id").alias("slot"), F.col("id").alias("slot_ord"))
    nothing = spark.createDataFrame([], "item bigint")
    assert gz.spread_rest(items, nothing, slots).count() == 8
