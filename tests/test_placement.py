"""Placement on a small matrix with answers worked out by hand, and against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import geozone as gz
from geozone.operators.placement import bounded_search
from geozone.session import written

# Row = from (dependency), column = to (candidate).
ZONES = ["north", "south", "east", "hub"]
MATRIX = [[0, 30, 20, 10], [35, 0, 25, 12], [20, 25, 0, 8], [10, 11, 9, 0]]


@pytest.fixture(scope="module")
def latency(spark):
    rows = [(a, b, MATRIX[i][j]) for i, a in enumerate(ZONES) for j, b in enumerate(ZONES)]
    return spark.createDataFrame(rows, "from_zone string, to_zone string, latency bigint")


def best(spark, latency, deps, candidates=None, mode="minmax"):
    rows = [(g, z) for g, zones in deps.items() for z in (zones or [None])]
    offered = candidates and spark.createDataFrame([(c,) for c in candidates], "zone string")
    frame = spark.createDataFrame(rows, "grp string, zone string")
    return {r.grp: (r.zone, r.score) for r in gz.best_zone(frame, latency, offered, mode).collect()}


class TestBestZone:
    def test_all_candidates(self, spark, latency):
        assert best(spark, latency, {"g": ["north", "south"]}) == {"g": ("hub", 12)}
        assert best(spark, latency, {"g": ["north", "south"]}, mode="average") == {"g": ("hub", 11.0)}

    def test_modes_differ_and_direction_counts(self, spark, latency):
        some = ["north", "south", "east"]
        assert best(spark, latency, {"g": ["north", "south"]}, some) == {"g": ("east", 25)}
        # The transposed lookup would choose north here.
        assert best(spark, latency, {"g": ["north", "south"]}, some, "average") == {"g": ("south", 15.0)}

    def test_no_dependencies(self, spark, latency):
        some = ["north", "south", "east"]
        assert best(spark, latency, {"g": [], "h": ["north"]}, some) == {"g": ("east", 0), "h": ("north", 0)}
        assert best(spark, latency, {"g": []}, some, "average") == {"g": (None, None)}
        assert best(spark, latency, {"g": []}, ["mars", "hub"]) == {"g": ("hub", 0)}
        assert best(spark, latency, {"g": []}, ["mars"]) == {"g": (None, None)}

    def test_unknown_dependency(self, spark, latency):
        for mode in ("minmax", "average"):
            assert best(spark, latency, {"g": ["north", "mars"]}, mode=mode) == {"g": (None, None)}

    def test_unknown_candidate_is_skipped(self, spark, latency):
        assert best(spark, latency, {"g": ["north"]}, ["south", "mars"]) == {"g": ("south", 30)}
        assert best(spark, latency, {"g": ["north"]}, ["south", "mars"], "average") == {"g": ("south", 30.0)}

    def test_repeated_dependency_counts_once(self, spark, latency):
        some = ["north", "south", "east"]
        assert best(spark, latency, {"g": ["north", "north", "south"]}, some, "average") == {"g": ("south", 15.0)}

    def test_ties_take_the_smallest_name(self, spark):
        rows = [(a, b, 1) for a in "ab" for b in "ab"]
        even = spark.createDataFrame(rows, "from_zone string, to_zone string, latency bigint")
        for mode in ("minmax", "average"):
            assert best(spark, even, {"g": ["a", "b"]}, mode=mode)["g"][0] == "a"

    def test_negative_latency(self, spark):
        rows = [("a", "a", -5), ("a", "b", -9)]
        odd = spark.createDataFrame(rows, "from_zone string, to_zone string, latency bigint")
        assert best(spark, odd, {"g": ["a"]}) == {"g": ("a", 0)}
        assert best(spark, odd, {"g": ["a"]}, mode="average") == {"g": ("b", -9.0)}

    def test_missing_pair_rules_a_candidate_out(self, spark):
        rows = [("a", "x", 1), ("a", "y", 9), ("b", "y", 9)]
        sparse = spark.createDataFrame(rows, "from_zone string, to_zone string, latency bigint")
        assert best(spark, sparse, {"g": ["a", "b"], "h": ["a"]}) == {"g": ("y", 9), "h": ("x", 1)}

    def test_mode_is_checked(self, spark, latency):
        with pytest.raises(ValueError, match="median"):
            best(spark, latency, {"g": ["north"]}, mode="median")

    def test_overall(self, latency):
        # Column means: north 16.25, south 16.5, east 13.5, hub 7.5.
        assert tuple(gz.best_zone_overall(latency).first()) == ("hub", 7.5)

    def test_overall_needs_every_pair(self, spark):
        sparse = spark.createDataFrame([("a", "b", 1)], "from_zone string, to_zone string, latency bigint")
        assert gz.best_zone_overall(sparse).count() == 0

    def test_brute_force(self, spark):
        rng = random.Random(5)
        zones = [f"z{i}" for i in range(7)]
        lat = {(a, b): rng.randrange(1, 50) for a, b in itertools.product(zones, zones)}
        frame = spark.createDataFrame([(a, b, v) for (a, b), v in lat.items()], "from_zone string, to_zone string, latency bigint")
        deps = {f"g{i}": rng.sample(zones, rng.randint(1, 7)) for i in range(300)}
        got = best(spark, frame, deps)
        for g, ds in deps.items():
            assert got[g] == min((max(lat[d, c] for d in ds), c) for c in zones)[::-1]
        got = best(spark, frame, deps, mode="average")
        for g, ds in deps.items():
            assert got[g] == min((sum(lat[d, c] for d in ds) / len(ds), c) for c in zones)[::-1]


def test_classify(spark):
    rows = [("s1", "source", "g1"), ("b1", "step", "g1"), ("b2", "step", "g2"), ("b3", "step", None), ("s2", "source", None)]
    df = spark.createDataFrame(rows, "member string, kind string, grp string")
    got = {r.member: r.scope for r in gz.classify_members(df).collect()}
    assert got == {"s1": "local", "b1": "local", "b2": "global"}


def test_group_dependencies(spark):
    members = spark.createDataFrame([("b1", "g"), ("b2", "g"), ("b3", "h")], "member string, grp string")
    inputs = spark.createDataFrame([("b1", "s1"), ("b2", "s1"), ("b2", "s2"), ("b2", "lost"), ("b3", "lost")], "member string, input string")
    zones = spark.createDataFrame([("s1", "north"), ("s1", "east"), ("s2", "north")], "member string, zone string")
    got = sorted((r.grp, r.zone or "") for r in gz.group_dependencies(members, inputs, zones).collect())
    assert got == [("g", "east"), ("g", "north"), ("h", "")]


def test_repeated_pairs_count_once(spark):
    rows = [("a", "x", 1), ("a", "x", 2), ("a", "y", 9)]
    repeated = spark.createDataFrame(rows, "from_zone string, to_zone string, latency bigint")
    assert best(spark, repeated, {"g": ["a"]}) == {"g": ("x", 2)}
    assert best(spark, repeated, {"g": ["a"]}, mode="average") == {"g": ("x", 2.0)}


def test_snapshots_are_kept_apart(spark):
    rows = [("s", "a", "x", 1), ("s", "a", "y", 9), ("t", "a", "x", 9), ("t", "a", "y", 1)]
    latency = spark.createDataFrame(rows, "snapshot string, from_zone string, to_zone string, latency bigint")
    deps = spark.createDataFrame([("s", "g", "a"), ("t", "g", "a"), ("t", "h", None)], "snapshot string, grp string, zone string")
    got = sorted(tuple(r) for r in gz.best_zone(deps, latency, by=["snapshot"]).collect())
    assert got == [("s", "g", "x", 1), ("t", "g", "y", 1), ("t", "h", "a", 0)]


def test_no_job_runs_ahead(spark):
    broken = F.raise_error(F.lit("read")).cast("bigint")
    latency = spark.range(3).select(F.lit("a").alias("from_zone"), F.lit("b").alias("to_zone"), broken.alias("latency"))
    deps = spark.createDataFrame([("g", "a")], "grp string, zone string")
    gz.best_zone(deps, latency)
    gz.best_zone_overall(latency)
    zones = spark.createDataFrame([("g", "a", 0)], "grp string, zone string, zone_ord int")
    items = spark.createDataFrame([("g", 1)], "grp string, item bigint")
    # What numbers rows counts them when called; what only reads the numbered rows does not.
    placed = gz.assign_zone_quota(items, zones.withColumn("zone_ord", broken.cast("int")), 1)
    gz.unassigned(items, placed)


def test_plans_do_not_grow_with_the_zones(spark):
    few, many = (
        spark.range(n).select(F.concat(F.lit("z"), "id").alias("from_zone"), F.lit("z1").alias("to_zone"), F.lit(1).alias("latency"))
        for n in (3, 2_000)
    )
    deps = spark.range(10).select("id", F.lit("z1").alias("zone")).withColumnRenamed("id", "grp")
    plans = [gz.best_zone(deps, f)._jdf.queryExecution().optimizedPlan().toString().count("\n") for f in (few, many)]
    assert plans[0] == plans[1]
    assert gz.best_zone(deps, many).filter("zone = 'z1'").count() == 10


class TestPlaceInOrder:
    def place(self, spark, latency, members, inputs, **options):
        zones = spark.createDataFrame([("s1", "north"), ("s2", "south"), ("s3", "east")], "member string, zone string")
        members = spark.createDataFrame(members, "member string, grp string, level int")
        inputs = spark.createDataFrame(inputs, "member string, input string")
        return {r.grp: (r.level, r.zone) for r in gz.place_in_order(members, inputs, zones, latency, **options).collect()}

    def test_later_levels_see_earlier_ones(self, spark, latency):
        members = [("a", "first", 1), ("b", "second", 2), ("c", "third", 3)]
        inputs = [("a", "s1"), ("b", "a"), ("b", "s3"), ("c", "b")]
        got = self.place(spark, latency, members, inputs)
        # first reads north only; second reads north and east: hub (10) beats east (20); third sits with second.
        assert got == {"first": (1, "north"), "second": (2, "hub"), "third": (3, "hub")}

    def test_same_and_later_levels_do_not_count(self, spark, latency):
        members = [("a", "g", 1), ("a2", "g", 1), ("b", "h", 1), ("c", "late", 2)]
        inputs = [("a", "a2"), ("a", "b"), ("a", "c"), ("a", "s2"), ("b", "a"), ("c", "a")]
        got = self.place(spark, latency, members, inputs)
        # h reads only a member of its own level, so it has no dependencies and takes the smallest zone.
        assert got == {"g": (1, "south"), "h": (1, "east"), "late": (2, "south")}

    def test_member_without_inputs(self, spark, latency):
        assert self.place(spark, latency, [("a", "g", 5)], [("x", "s1")]) == {"g": (5, "east")}

    def test_mode_and_candidates(self, spark, latency):
        offered = spark.createDataFrame([("north",), ("south",), ("east",)], "zone string")
        members, inputs = [("a", "g", 1)], [("a", "s1"), ("a", "s2")]
        assert self.place(spark, latency, members, inputs, candidates=offered) == {"g": (1, "east")}
        assert self.place(spark, latency, members, inputs, candidates=offered, mode="average") == {"g": (1, "south")}

    def test_unplaced_group_passes_nothing_on(self, spark, latency):
        zones = spark.createDataFrame([("s1", "mars")], "member string, zone string")
        members = spark.createDataFrame([("a", "g", 1), ("b", "h", 2)], "member string, grp string, level int")
        inputs = spark.createDataFrame([("a", "s1"), ("b", "a")], "member string, input string")
        got = {r.grp: r.zone for r in gz.place_in_order(members, inputs, zones, latency).collect()}
        assert got == {"g": None, "h": "east"}

    def test_a_zone_without_slots_is_not_passed_on(self, spark, latency):
        members = [("a", "first", 1), ("b", "second", 2)]
        inputs = [("a", "s1"), ("b", "a"), ("b", "s3")]
        slots = spark.createDataFrame([("hub", 1), ("hub", 2), ("east", 1)], "zone string, slot bigint")
        got = self.place(spark, latency, members, inputs, slots=slots)
        # first wants north, which has no slots; second then reads east only.
        assert got == {"first": (1, None), "second": (2, "east")}

    def test_a_group_with_two_levels_is_refused(self, spark, latency):
        with pytest.raises(ValueError, match="two levels"):
            self.place(spark, latency, [("a", "g", 1), ("b", "g", 2)], [("a", "s1")])

    def test_nothing_to_place(self, spark, latency):
        with pytest.raises(ValueError):
            self.place(spark, latency, [], [("a", "s1")])


def test_more_zones_than_bits_in_one_number(spark):
    rng = random.Random(8)
    zones = [f"z{i:03d}" for i in range(140)]
    lat = {(a, b): rng.randrange(1, 10_000) for a, b in itertools.product(zones, zones)}
    frame = spark.createDataFrame([(a, b, v) for (a, b), v in lat.items()], "from_zone string, to_zone string, latency bigint")
    deps = {f"g{i}": rng.sample(zones, rng.choice([1, 2, 30, 140])) for i in range(40)} | {"free": [], "lost": ["mars", "z001"]}
    got = best(spark, frame, deps)
    assert got.pop("free") == ("z000", 0) and got.pop("lost") == (None, None)
    for g, choice in got.items():
        assert choice == min((max(lat[d, c] for d in deps[g]), c) for c in zones)[::-1]


def graph(spark, edges, alone=()):
    """One member per group; `edges` are (group, group it reads)."""
    groups = sorted({g for e in edges for g in e} | set(alone))
    members = spark.createDataFrame([(f"m-{g}", g) for g in groups], "member string, grp string")
    inputs = spark.createDataFrame([(f"m-{a}", f"m-{b}") for a, b in edges] or [("x", "y")], "member string, input string")
    return members, inputs


def test_levels_are_found(spark):
    edges = [("b", "a"), ("c", "b"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "c"), ("f", "d")]
    members, inputs = graph(spark, edges, alone=["z"])
    extra = spark.createDataFrame([("m-a", "no member"), ("no member", "m-a"), ("m-b", None)], "member string, input string")
    lost = spark.createDataFrame([("m-lost", None)], "member string, grp string")
    got = {r.grp: r.level for r in gz.find_levels(members.unionByName(lost), inputs.unionByName(extra)).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 2, "e": 1, "f": 4, "z": 1}
    assert gz.find_levels(members.filter("grp = '?'"), inputs).collect() == []


def test_circles_are_refused(spark):
    members, inputs = graph(spark, [("b", "a"), ("c", "b"), ("b", "d"), ("d", "c"), ("e", "d")])
    with pytest.raises(ValueError, match=r"circle.*'b', 'c', 'd', 'e'"):
        gz.find_levels(members, inputs)


def test_a_long_chain_needs_no_deep_plan(spark):
    n = 25
    members, inputs = graph(spark, [(f"g{i:03}", f"g{i - 1:03}") for i in range(1, n)])
    found = gz.find_levels(members, inputs)
    assert {r.grp: r.level for r in found.collect()} == {f"g{i:03}": i + 1 for i in range(n)}
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and text.count("Relation [") == n


def test_placing_finds_the_levels(spark, latency):
    members = spark.createDataFrame([("m1", "first"), ("m2", "second")], "member string, grp string")
    inputs = spark.createDataFrame([("m1", "s1"), ("m1", "s2"), ("m2", "m1"), ("m2", "s1")], "member string, input string")
    zones = spark.createDataFrame([("s1", "north"), ("s2", "south")], "member string, zone string")
    given = members.withColumn("level", F.when(F.col("grp") == "first", 1).otherwise(2))
    found = {tuple(r) for r in gz.place_in_order(members, inputs, zones, latency).collect()}
    assert found == {tuple(r) for r in gz.place_in_order(given, inputs, zones, latency).collect()}
    assert {(r[0], r[1]) for r in found} == {("first", 1), ("second", 2)}


def plane(spark, n, seed):
    """Zones on a plane, latencies are rounded distances; and the zones' names by place."""
    rng = random.Random(seed)
    places = [(rng.random(), rng.random()) for _ in range(n)]
    zones = spark.createDataFrame([(f"z{i:04}", x, y) for i, (x, y) in enumerate(places)], "zone string, x double, y double")
    a, b = zones.toDF("from_zone", "ax", "ay"), zones.toDF("to_zone", "bx", "by")
    apart = F.round(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) * 10_000).cast("bigint")
    return places, a.join(b, F.lit(True)).select("from_zone", "to_zone", apart.alias("latency"))


@pytest.mark.parametrize("mode", ["minmax", "average"])
def test_bounded_search_finds_the_same(spark, mode):
    """Sets of one to six zones, some pairs unknown, one zone without any pair, ties, negative latencies."""
    rng = random.Random(11)
    names = [f"z{i:02}" for i in range(40)]
    pairs = [(a, b, rng.randrange(-3, 25)) for a in names for b in names if rng.random() < 0.97]
    latency = spark.createDataFrame(pairs, "from_zone string, to_zone string, latency bigint")
    rows = [(f"g{g}", z) for g in range(150) for z in rng.sample(names, rng.randrange(1, 7))]
    rows += [("none", None), ("lost", "nowhere"), ("lost", "z00"), ("all", "z01"), *[("all", z) for z in names]]
    deps = spark.createDataFrame(rows, "grp string, zone string")
    for offered in (None, spark.createDataFrame([(z,) for z in names[::3]], "zone string")):
        plain = {tuple(r) for r in gz.best_zone(deps, latency, offered, mode).collect()}
        assert {tuple(r) for r in gz.best_zone(deps, latency, offered, mode, bounded=True).collect()} == plain


@pytest.mark.parametrize(("mode", "share"), [("minmax", 0.1), ("average", 0.4)])
def test_bounded_search_opens_few_rows(spark, mode, share):
    """2,000 zones, sets of five zones of a neighbourhood: same result, and a small share of the rows opened."""
    places, latency = plane(spark, 2_000, 3)
    latency = written(latency, "plane")
    rng, rows = random.Random(4), []
    for g in range(60):
        x, y = rng.random(), rng.random()
        near = sorted(range(2_000), key=lambda i: (places[i][0] - x) ** 2 + (places[i][1] - y) ** 2)[:120]
        rows += [(f"g{g}", f"z{i:04}") for i in rng.sample(near, 5)]
    deps = spark.createDataFrame(rows, "grp string, zone string")
    plain = {tuple(r) for r in gz.best_zone(deps, latency, mode=mode).collect()}
    assert {tuple(r) for r in gz.best_zone(deps, latency, mode=mode, bounded=True).collect()} == plain
    sets = deps.groupBy(F.col("grp").alias("set")).agg(F.sort_array(F.collect_set("zone")).alias("zones")).withColumn("size", F.size("zones"))
    opened = sum(frame.count() for frame in bounded_search(sets, latency, mode).opened)
    assert opened < share * len(rows) * 2_000
