"""The plans and the repository hold what the design promises."""

import pathlib

import pytest

from pyspark.sql import functions as F

import geozone as gz
from geozone import session
from geozone.plans.queries import REGISTRY

DATA = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parent.parent
# Queries that run a stream and return the table it wrote.
STREAMS = {"stream_zone_local_agg", "stream_global_agg", "stream_global_complete", "stream_late_complete", "stream_route", "stream_route_live", "stream_zone_members"}


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - STREAMS))
def test_no_python_rows_no_cross_join_no_forced_broadcast(spark, name):
    query = REGISTRY[name](spark, DATA)._jdf.queryExecution()
    physical, logical = query.executedPlan().toString(), query.optimizedPlan().toString()
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in physical
    assert "strategy=broadcast" not in logical


def test_scans_read_only_the_needed_columns(spark):
    text = REGISTRY["observed_latency"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1] for line in text.splitlines() if "ReadSchema: " in line]
    assert schemas and all("l_extendedprice" not in s and "c_name" not in s for s in schemas)


def test_no_local_checkpoints_or_forced_broadcasts_in_the_library():
    for path in set((ROOT / "geozone").rglob("*.py")) - set((ROOT / "geozone" / "llm").rglob("*.py")):
        text = path.read_text()
        for word in ("localCheckpoint", "broadcast(", ".toPandas(", ".rdd", "udf("):
            assert word not in text, (path, word)


class Conf:
    def __init__(self, master, named=None):
        self.master, self.named, self.applicationId = master, named, f"app-{master}"

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.named


class Session:
    def __init__(self, master, named=None):
        self.sparkContext = Conf(master, named)
        self.conf = self.sparkContext


def test_shared_folder_comes_from_the_cluster():
    assert session.scratch_root(Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.scratch_path(Session("local[2]", "/shared"), "x").startswith("/shared/geozone-app-local[2]/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session("yarn"))
    assert session.scratch_root(Session("local[2]")) == session.scratch_root(Session("local[2]"))


def test_scratch_is_removed_by_one_call(spark):
    folder = pathlib.Path(session.run_folder(spark))
    table = session.written(spark.range(3), "kept")
    assert table.count() == 3 and any(folder.iterdir())
    gz.clear_scratch(spark)
    assert not folder.exists()


def test_facts_are_not_dealt_by_zone_or_type(spark):
    """With a threshold between the size of a lookup and of the facts, lookups are broadcast from the start."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    facts = session.written(spark.range(200_000).select("id", (F.col("id") % 5).cast("string").alias("source")), "facts")
    pairs = [(str(k), f"z{k}", 0) for k in range(5)]
    lookup = session.written(spark.createDataFrame(pairs, "source string, zone string, zone_ord int"), "lookup")
    rows = [("0", "1", 5), ("1", "2", 7)]
    latency = session.written(spark.createDataFrame(rows, "from_zone string, to_zone string, latency bigint"), "latency")
    spark.conf.set(key, "100k")
    try:
        for df in (gz.tag_zones(facts, "source", lookup), gz.latency_of(facts, latency, "source", "source", "l")):
            text = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    finally:
        spark.conf.set(key, before)
