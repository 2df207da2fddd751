"""Tagging, latency lookups, member inversion, and the text formats."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import geozone as gz
from geozone.sources.lines import as_lines


def lines_of(spark, *texts, file="f"):
    rows = [(file, i, t) for i, t in enumerate(texts)]
    return as_lines(spark.createDataFrame(rows, "file string, n bigint, text string"), "text", "n", "file", block_lines=2)


def zones(df):
    return sorted((r.source, r.zone_ord, r.zone) for r in df.collect())


class TestSourceZones:
    def test_repeated_source_goes_on_and_repeats_are_kept(self, spark):
        df = gz.parse_source_zones(lines_of(spark, "s1;a,b", "s2;c", "s1;a", "s1;d,e"))
        assert zones(df) == [("s1", 0, "a"), ("s1", 1, "b"), ("s1", 2, "a"), ("s1", 3, "d"), ("s1", 4, "e"), ("s2", 0, "c")]

    def test_stops_at_first_empty_line(self, spark):
        df = gz.parse_source_zones(lines_of(spark, "s1;a", "s2;b", "", "s3;c", "broken"))
        assert zones(df) == [("s1", 0, "a"), ("s2", 0, "b")]

    def test_line_without_zones(self, spark):
        for text in ("s1", "s1;"):
            with pytest.raises(Exception, match="no zones in line"):
                gz.parse_source_zones(lines_of(spark, "s0;a", text)).collect()
        df = gz.parse_source_zones(lines_of(spark, "s0;a", "s1", "s2;b"), on_error="skip")
        assert zones(df) == [("s0", 0, "a"), ("s2", 0, "b")]

    def test_empty_fields(self, spark):
        # Trailing empty zones vanish, inner ones stay, further parts do not count.
        df = gz.parse_source_zones(lines_of(spark, "s1;a,,b,,", "s2;,", "s3;a;b"))
        assert zones(df) == [("s1", 0, "a"), ("s1", 1, ""), ("s1", 2, "b"), ("s3", 0, "a")]

    def test_files_and_splits(self, spark, tmp_path):
        """Small splits: the order of a source's zones follows the file across many tasks."""
        text = "".join(f"s{i % 3};z{i:05d}\n" for i in range(2_000)) + "\nlate;x\n"
        (tmp_path / "zones.txt").write_text(text)
        key = "spark.sql.files.maxPartitionBytes"
        before = spark.conf.get(key)
        spark.conf.set(key, "1000")
        try:
            df = gz.read_source_zones(spark, str(tmp_path))
            assert gz.read_lines(spark, str(tmp_path)).select("block").distinct().count() > 4
            got = zones(df)
        finally:
            spark.conf.set(key, before)
        want = sorted((f"s{i % 3}", i // 3, f"z{i:05d}") for i in range(2_000))
        assert got == want

    def test_write_and_read(self, spark, tmp_path):
        df = spark.createDataFrame([("s", "b", 0), ("s", "a", 1), ("t", "c", 0)], "source string, zone string, zone_ord int")
        gz.write_source_zones(df, str(tmp_path / "out"))
        assert zones(gz.read_source_zones(spark, str(tmp_path / "out"))) == zones(df)

    def test_many_lines_per_source_keep_their_order(self, spark, tmp_path):
        df = spark.range(900).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("source"),
            F.concat(F.lit("z"), (F.col("id") * 7 % 11).cast("string")).alias("zone"),
            F.col("id").alias("at"),
        )
        df = gz.ordinal(df, ["source"], ["at"], out="zone_ord").select("source", "zone", F.col("zone_ord").cast("int").alias("zone_ord"))
        gz.write_source_zones(df.repartition(4), str(tmp_path / "out"), line_zones=7)
        assert zones(gz.read_source_zones(spark, str(tmp_path / "out"))) == zones(df)


class TestLatencyMatrix:
    def cells(self, df):
        return {(r.from_zone, r.to_zone): r.latency for r in df.collect()}

    def test_square(self, spark):
        df = gz.parse_latency_matrix(lines_of(spark, "a,b", "0,10", " 20 , 0.5"))
        assert self.cells(df) == {("a", "a"): 0, ("a", "b"): 10, ("b", "a"): 20, ("b", "b"): 0.5}

    def test_missing_cells_and_rows_are_zero(self, spark):
        df = gz.parse_latency_matrix(lines_of(spark, "a,b,c", "1,2,,", "3"))
        assert self.cells(df) == {
            ("a", "a"): 1, ("a", "b"): 2, ("a", "c"): 0, ("b", "a"): 3, ("b", "b"): 0, ("b", "c"): 0,
            ("c", "a"): 0, ("c", "b"): 0, ("c", "c"): 0,
        }

    def test_stops_at_empty_line_and_keeps_names(self, spark):
        df = gz.parse_latency_matrix(lines_of(spark, "a, b", "0,1", "", "5,5"))
        assert self.cells(df) == {("a", "a"): 0, ("a", " b"): 1, (" b", "a"): 0, (" b", " b"): 0}

    def test_files_do_not_mix(self, spark):
        one = lines_of(spark, "a,b", "0,1", "2,0", file="one")
        two = lines_of(spark, "b,a", "0,7", file="two")
        df = gz.parse_latency_matrix(one.unionByName(two))
        got = {(r.snapshot, r.from_zone, r.to_zone): r.latency for r in df.collect()}
        assert got[("one", "a", "b")] == 1 and got[("one", "b", "a")] == 2
        assert got[("two", "b", "a")] == 7 and got[("two", "a", "b")] == 0
        assert len(got) == 8

    def test_repeated_name_counts_once(self, spark):
        df = gz.parse_latency_matrix(lines_of(spark, "a,b,a", "1,2,3", "4,5,6", "7,8,9"))
        assert self.cells(df) == {("a", "a"): 1, ("a", "b"): 2, ("b", "a"): 4, ("b", "b"): 5}

    def test_errors(self, spark):
        for bad, message in [("0,x", "not a number"), ("0,1,2", "more rows or cells")]:
            with pytest.raises(Exception, match=message):
                gz.parse_latency_matrix(lines_of(spark, "a,b", bad)).collect()
        with pytest.raises(Exception, match="more rows or cells"):
            gz.parse_latency_matrix(lines_of(spark, "a", "0", "1")).collect()
        df = gz.parse_latency_matrix(lines_of(spark, "a,b", "0,x", "3,4,5", "6"), on_error="skip")
        assert self.cells(df) == {("a", "a"): 0, ("a", "b"): 0, ("b", "a"): 3, ("b", "b"): 4}

    def test_missing_path_knows_no_zone(self, spark, tmp_path):
        df = gz.read_latency_matrices(spark, str(tmp_path / "nowhere"))
        assert df.columns == ["snapshot", "from_zone", "to_zone", "latency"]
        assert gz.zone_names(df).count() == 0

    def test_write_and_read(self, spark, tmp_path):
        rows = [("s1", "a", "b", 3.0), ("s1", "b", "a", 4.0), ("s2", "a", "c", 5.5)]
        df = spark.createDataFrame(rows, "snapshot string, from_zone string, to_zone string, latency double")
        gz.write_latency_matrix(df, str(tmp_path / "out"))
        got = gz.read_latency_matrices(spark, str(tmp_path / "out"))
        got = {(r.snapshot.split("snapshot=")[1][:2], r.from_zone, r.to_zone): r.latency for r in got.collect()}
        assert len(got) == 8
        assert {k: v for k, v in got.items() if v} == {r[:3]: r[3] for r in rows}


class TestZoneMembers:
    def test_lines_are_bounded_and_ordered(self, spark):
        rows = [("a", m) for m in (5, 3, 1, 2, 4)] + [("b", 9), (None, 1), ("c", None)]
        df = spark.createDataFrame(rows, "zone string, member bigint")
        got = sorted(tuple(r) for r in gz.zone_members(df, line_members=2).collect())
        assert got == [("a", 0, 2, "a;1,2"), ("a", 1, 2, "a;3,4"), ("a", 2, 1, "a;5"), ("b", 0, 1, "b;9")]

    def test_order_of_placement(self, spark):
        df = spark.createDataFrame([("a", 1, 30), ("a", 2, 10), ("a", 3, 20)], "zone string, member bigint, at int")
        assert gz.zone_members(df, order="at").first().line == "a;2,3,1"
        tied = spark.createDataFrame([("a", m, "day") for m in (3, 1, 2)], "zone string, member bigint, at string")
        assert gz.zone_members(tied, order="at").first().line == "a;1,2,3"

    def test_roundtrip_and_append(self, spark, tmp_path):
        df = spark.range(500).select(F.concat(F.lit("z"), (F.col("id") % 3).cast("string")).alias("zone"), F.col("id").alias("member"))
        path = str(tmp_path / "members")
        gz.write_zone_members(df.filter("member < 200"), path, line_members=7)
        gz.write_zone_members(df.filter("member >= 200"), path)
        got = gz.read_zone_members(spark, path)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))

    def test_lines_without_two_parts_are_skipped(self, spark):
        lines = spark.createDataFrame([("a;1,2",), ("b",), ("c;",), ("d;1;2",), ("",), ("e;3",)], "value string")
        assert sorted(map(tuple, gz.parse_zone_members(lines).collect())) == [("a", 1), ("a", 2), ("e", 3)]

    def test_bad_member(self, spark):
        lines = spark.createDataFrame([("a;1,x",)], "value string")
        with pytest.raises(Exception, match="not a member number"):
            gz.parse_zone_members(lines).collect()
        assert [tuple(r) for r in gz.parse_zone_members(lines, on_error="skip").collect()] == [("a", 1)]
        with pytest.raises(ValueError):
            gz.parse_zone_members(lines, on_error="ignore")


class TestSettings:
    def test_standard_settings(self, spark):
        rows = [
            (1, '{"group-name": "g", "TaskPerCloud": 3}'),
            (2, '{"group-name": "g", "TaskPerCloud": "4"}'),
            (3, '{"group-name": "h"}'),
            (4, '{"TaskPerCloud": 2}'),
            (5, '{"group-name": "g", '),
            (6, "not json"),
            (7, None),
            (8, '{"group-name": null}'),
            (9, '{"group-name": "g", "TaskPerCloud": "many", "other": [1, 2]}'),
        ]
        df = spark.createDataFrame(rows, "id int, conf string")
        got = sorted((r.id, r.grp, r.per_zone) for r in gz.member_settings(df, "conf").collect())
        assert got == [(1, "g", 3), (2, "g", 4), (3, "h", 1), (9, "g", 1)]

    def test_own_settings(self, spark):
        df = spark.createDataFrame([('{"k": 1.5}',), ("{}",)], "conf string")
        got = gz.settings_from_json(df, "conf", {"k": ("double", 0.5), "flag": ("boolean", True)}).collect()
        assert sorted((r.k, r.flag) for r in got) == [(0.5, True), (1.5, True)]


class TestTagging:
    SOURCES = [("s", "a", 0), ("s", "b", 1), ("s", "a", 2), ("t", "c", 0)]

    def test_tag_zones(self, spark):
        table = spark.createDataFrame(self.SOURCES, "source string, zone string, zone_ord int")
        df = spark.createDataFrame([(1, "s"), (2, "t"), (3, "u")], "id int, src string")
        inner = sorted((r.id, r.zone) for r in gz.tag_zones(df, "src", table).collect())
        assert inner == [(1, "a"), (1, "a"), (1, "b"), (2, "c")]
        left = gz.tag_zones(df, "src", table, how="left", with_ord=True)
        assert left.columns == ["id", "src", "zone", "zone_ord"]
        assert sorted((r.id, r.zone or "") for r in left.collect()) == [*inner, (3, "")]
        with pytest.raises(ValueError):
            gz.tag_zones(df, "src", table, how="outer")

    def test_latency_of_is_directed(self, spark):
        latency = spark.createDataFrame([("a", "b", 5.0), ("b", "a", 7.0)], "from_zone string, to_zone string, latency double")
        df = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "mars"), (None, "a")], "f string, t string")
        got = {(r.f, r.t): r.latency for r in gz.latency_of(df, latency, "f", "t").collect()}
        assert got == {("a", "b"): 5, ("b", "a"): 7, ("a", "mars"): -1, (None, "a"): -1}

    def test_unmeasured_and_repeated_pairs(self, spark):
        latency = spark.createDataFrame([("a", "b", 5), ("a", "b", 3), ("c", "a", 1)], "from_zone string, to_zone string, latency int")
        df = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "b"), ("a", "x")], "f string, t string")
        got = sorted((r.f, r.t, r.latency) for r in gz.latency_of(df, latency, "f", "t", missing=0).collect())
        assert got == [("a", "b", 5), ("a", "c", 0), ("a", "x", -1), ("b", "b", 0)]
        assert gz.latency_of(df, latency, "f", "t").filter("latency is null").count() == 2

    def test_observed_latency(self, spark):
        df = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("b", "a", 9)], "f string, t string, v int")
        got = {(r.from_zone, r.to_zone): r.latency for r in gz.observed_latency(df, "f", "t", "v").collect()}
        assert got == {("a", "b"): 1500, ("b", "a"): 9000}

    def test_member_zone(self, spark):
        df = spark.createDataFrame([("a", 1, 2), ("b", 1, 1), ("b", 2, 1)], "zone string, member bigint, at int")
        assert {r.member: r.zone for r in gz.member_zone(df).collect()} == {1: "b", 2: "b"}
        assert {r.member: r.zone for r in gz.member_zone(df, "at").collect()} == {1: "a", 2: "b"}

    def test_report(self, spark, tmp_path):
        placed = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "item int, slot int")
        groups = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "a")], "grp string, zone string")
        report = gz.placement_report(placed, groups)
        got = sorted(tuple(r) for r in report.collect())
        assert got == [("group", "g", 0, 2, "a,b"), ("slot", "10", 0, 2, "1,2"), ("slot", "11", 0, 1, "3")]
        lines = ["# slot", "10\t1,2", "11\t3", "# group", "g\ta,b"]
        assert [r.value for r in gz.report_lines(report).collect()] == lines
        for _ in range(2):
            gz.write_placement_report(report, str(tmp_path / "report"))
        assert sorted(r.value for r in spark.read.text(str(tmp_path / "report")).collect()) == sorted(lines * 2)
        cut = gz.placement_report(placed, groups, line_entries=1).filter("name = '10'")
        assert sorted(tuple(r) for r in cut.collect()) == [("slot", "10", 0, 1, "1"), ("slot", "10", 1, 1, "2")]


def test_latency_as_of(spark):
    """Against a plain search, with a hot pair, repeated measurements, times before the first and after the last."""
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    snapshots = [(rng.choice("abc"), rng.choice("abc"), start + dt.timedelta(hours=rng.randrange(24 * 90)), rng.randrange(99)) for _ in range(200)]
    snapshots += [(*snapshots[0][:3], 500), ("d", "a", None, 1)]
    rows = [(i, "a" if rng.random() < 0.5 else rng.choice("abcdx"), rng.choice("abc"), start + dt.timedelta(hours=rng.randrange(-200, 24 * 100))) for i in range(2_000)]
    rows += [(-1, "a", "b", None), (-2, None, "b", start), (-3, "a", "b", snapshots[0][2])]
    pairs = spark.createDataFrame(snapshots, "from_zone string, to_zone string, at timestamp, latency bigint")
    df = spark.createDataFrame(rows, "id bigint, f string, t string, ts timestamp")
    known = {z for s in snapshots for z in s[:2]}

    def want(f, t, ts):
        if f not in known or t not in known:
            return -1
        old = [(s[2], s[3]) for s in snapshots if s[:2] == (f, t) and s[2] is not None and ts is not None and s[2] <= ts]
        return max(old)[1] if old else None

    for seconds in (3_600, 7 * 86_400, 10**9):
        got = gz.latency_as_of(df, pairs, "f", "t", "ts", piece_seconds=seconds)
        assert got.columns == ["id", "f", "t", "ts", "latency"]
        assert {r.id: r.latency for r in got.collect()} == {i: want(f, t, ts) for i, f, t, ts in rows}
    assert gz.latency_as_of(df, pairs.filter("latency < 0"), "f", "t", "ts").filter("latency <> -1").count() == 0
    assert gz.latency_as_of(df.filter("id > 9999"), pairs, "f", "t", "ts").count() == 0


def test_rows_meet_the_lists_by_an_equi_join(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("f"), (F.col("id") % 3).alias("t"), F.timestamp_seconds("id").alias("ts"))
    pairs = df.select(F.col("f").alias("from_zone"), F.col("t").alias("to_zone"), F.col("ts").alias("at"), F.col("f").alias("latency"))
    text = gz.latency_as_of(df, pairs, "f", "t", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
