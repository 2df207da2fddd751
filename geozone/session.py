"""Session helpers: a local session for tests, the shared scratch folder, the time zone check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Names of UTC that the session time zone may carry.
UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "Zulu", "+00:00"}

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_scratch: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "geozone", **conf: str) -> SparkSession:
    """A `local[cpus]` session for tests and benchmarks. On a cluster, bring your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    The cluster names it in `spark.checkpoint.dir`. Where that is unset, a local session gets a temporary
    folder; on a cluster a temporary folder would be visible to one machine only, so it is refused.
    """
    named = spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(_CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_CONF} to a folder that every executor can reach")
    app_id = spark.sparkContext.applicationId
    if app_id not in _local_scratch:
        _local_scratch[app_id] = tempfile.mkdtemp(prefix="geozone-")
    return _local_scratch[app_id]


def run_folder(spark: SparkSession) -> str:
    """What this application has written to the shared folder: tables live as long as the caller wants."""
    return f"{scratch_root(spark)}/geozone-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that `written` and `scratch_path` left behind in this application.

    To be called when no result of the library is read any more: frames that read such tables fail afterwards.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, read often, and of a size Spark knows.

    The table belongs to the running application; `clear_scratch` removes all of them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require_utc(spark: SparkSession) -> None:
    """Streams turn zoneless timestamps into instants and back, which is only safe in UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"streaming windows need a UTC session time zone, not {zone}")
