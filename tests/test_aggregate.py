"""Local results merge to the global result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import geozone as gz
from geozone.functions.measures import DISTINCT_ERROR, QUANTILE_ERROR, merges, partial_names

MEASURES = {"n": ("count", "*"), "n_v": ("count", "v"), "total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v"), "mean": ("avg", "v")}


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (
            start + dt.timedelta(seconds=rng.randrange(6 * 3600)),
            "hot" if rng.random() < 0.5 else rng.choice(["a", "b"]),
            rng.choice(["x", "y", None]),
            None if rng.random() < 0.1 else rng.randrange(100),
        )
        for _ in range(2_000)
    ]
    return spark.createDataFrame(rows, "ts timestamp_ntz, zone string, key string, v bigint")


def plain(df, by):
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("v").alias("n_v"), F.sum("v").alias("total"),
        F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"),
    )


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_local_equals_plain_group(events):
    local = gz.local_result(gz.zone_local_agg(events, "zone", ["key"], MEASURES), "zone", ["key"], MEASURES)
    columns = ["zone", "key", *MEASURES]
    assert rows(local, columns) == rows(plain(events, ["zone", "key"]), columns)


def test_global_merges_locals(events):
    local = gz.zone_local_agg(events, "zone", ["key"], MEASURES)
    columns = ["key", *MEASURES]
    assert rows(gz.global_agg(local, ["key"], MEASURES), columns) == rows(plain(events, ["key"]), columns)


def test_global_from_stored_locals(spark, events, tmp_path):
    path = str(tmp_path / "local")
    local = gz.zone_local_agg(events, "zone", ["key"], MEASURES, "ts", "1 hour")
    assert set(partial_names(MEASURES)) == set(local.columns) - {"window", "zone", "key"}
    local.write.parquet(path)
    merged = gz.global_agg(spark.read.parquet(path), ["key"], MEASURES)
    hourly = plain(events.withColumn("window_start", F.date_trunc("hour", "ts").cast("timestamp_ntz")), ["window_start", "key"])
    columns = ["window_start", "key", *MEASURES]
    assert rows(merged, columns) == rows(hourly, columns)


def test_both_side_by_side(events):
    both = gz.local_and_global(events, "zone", ["key"], MEASURES, "ts", "30 minutes")
    local = gz.zone_local_agg(events, "zone", ["key"], MEASURES, "ts", "30 minutes")
    columns = ["window_start", "window_end", "key", *MEASURES]
    assert rows(both.filter("scope = 'global'"), columns) == rows(gz.global_agg(local, ["key"], MEASURES), columns)
    columns = ["zone", *columns]
    assert rows(both.filter("scope = 'local'"), columns) == rows(gz.local_result(local, "zone", ["key"], MEASURES), columns)


def test_null_zone_is_a_local_row(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "zone string, v int")
    both = gz.local_and_global(df, "zone", [], {"total": ("sum", "v")}).collect()
    assert sorted((r.scope, r.zone or "", r.total) for r in both) == [("global", "", 3), ("local", "", 1), ("local", "a", 2)]


def test_no_keys_no_window(events):
    local = gz.zone_local_agg(events, "zone", [], MEASURES)
    assert gz.global_agg(local, [], MEASURES).first().n == 2_000


def test_bad_measures(events):
    with pytest.raises(ValueError, match="median"):
        gz.zone_local_agg(events, "zone", [], {"m": ("median", "v")})
    with pytest.raises(ValueError):
        gz.zone_local_agg(events, "zone", [], {})


def test_raw_rows_are_read_once(spark, events, tmp_path):
    path = str(tmp_path / "events")
    events.write.parquet(path)
    plan = gz.local_and_global(spark.read.parquet(path), "zone", ["key"], MEASURES, "ts", "1 hour")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1
    # The grouping sets expand rows that are aggregated already.
    assert text.index("Expand") < text.index("FileScan")
    assert "HashAggregate" in text[text.index("Expand") : text.index("FileScan")]


EXTRA = {
    "users": ("distinct", "u"),
    "exact": ("variance", "d"),
    "whole": ("variance", "u"),
    "apart": ("stddev", "x"),
    "p90": ("quantile", "x", 0.9),
}


def test_sketches_and_moments_merge(spark):
    """Many zones or one: sketches and exact moments are the same, the others within their bounds."""
    wide = spark.range(60_000).select(
        (F.col("id") % 9).cast("string").alias("zone"),
        (F.col("id") % 2).alias("key"),
        (F.xxhash64("id") % 20_000).alias("u"),
        ((F.col("id") * 7919 % 1_000) / 10).cast("decimal(18,2)").alias("d"),
        (F.col("id") * 0.25 + 1e6).alias("x"),
    )
    local = gz.zone_local_agg(wide, "zone", ["key"], EXTRA)
    merged = {r.key: r for r in gz.global_agg(local, ["key"], EXTRA).collect()}
    again = local.withColumn("zone", F.lit("all")).groupBy("key").agg(*merges(EXTRA, local.columns))
    assert {r.key: (r.users, r.exact) for r in gz.global_agg(again, ["key"], EXTRA).collect()} == {k: (r.users, r.exact) for k, r in merged.items()}
    one = {r.key: r for r in gz.global_agg(gz.zone_local_agg(wide.withColumn("zone", F.lit("a")), "zone", ["key"], EXTRA), ["key"], EXTRA).collect()}
    plain = wide.groupBy("key").agg(
        F.countDistinct("u").alias("users"), F.var_pop("d").alias("exact"), F.var_pop("u").alias("whole"), F.stddev_pop("x").alias("apart")
    )
    for r in plain.collect():
        m, o = merged[r.key], one[r.key]
        assert m.users == o.users and abs(m.users - r.users) <= 4 * DISTINCT_ERROR * r.users
        assert m.exact == o.exact and abs(m.exact - r.exact) < 1e-9 * r.exact
        assert abs(m.whole - r.whole) < 1e-9 * r.whole and abs(m.apart - r.apart) < 1e-6 * r.apart
        share = wide.filter((F.col("key") == r.key) & (F.col("x") <= m.p90)).count() / 30_000
        assert abs(share - 0.9) <= 2 * QUANTILE_ERROR


def test_merged_registers_are_those_of_the_whole(spark):
    df = spark.range(50_000).select((F.col("id") % 5).cast("string").alias("zone"), (F.col("id") * 31 % 17_000).alias("u"))
    measures = {"users": ("distinct", "u")}
    local = gz.zone_local_agg(df, "zone", [], measures)
    whole = gz.zone_local_agg(df.withColumn("zone", F.lit("a")), "zone", [], measures)
    both = [f.agg(F.hll_union_agg("users__sketch").alias("s")).select(F.hll_union("s", "s").alias("s")).first().s for f in (local, whole)]
    assert both[0] == both[1]


def test_measures_of_nothing(spark):
    df = spark.createDataFrame([("a", None, None, None)], "zone string, u bigint, d decimal(18,2), x double")
    got = gz.global_agg(gz.zone_local_agg(df, "zone", [], EXTRA), [], EXTRA).first()
    assert tuple(got) == (0, None, None, None, None)
    empty = gz.global_agg(gz.zone_local_agg(df.filter("zone = 'b'"), "zone", [], EXTRA), [], EXTRA).first()
    assert empty.users == 0 and empty.exact is None and empty.p90 is None


def test_ranks_are_checked(events):
    for bad in ({"q": ("quantile", "v")}, {"q": ("quantile", "v", 1.5)}, {"q": ("sum", "v", 0.5)}):
        with pytest.raises(ValueError, match="rank"):
            gz.zone_local_agg(events, "zone", [], bad)
