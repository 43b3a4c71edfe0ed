"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "tablequill") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine: on a
    cluster the executors would not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="tablequill-")
    return _local_scratch[app]


_job: ContextVar[str | None] = ContextVar("job", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the folder of the job, or the scratch folder outside of one."""
    return f"{_job.get() or scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def job_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A scratch folder for the tables that a job stores, removed when the job ends.

    For jobs that write their results elsewhere: a frame that still reads one
    of these tables is unusable afterwards. A job inside a job shares its folder.
    """
    if _job.get():
        yield _job.get()
        return
    path = fresh_path(spark, name)
    token = _job.set(path)
    try:
        yield path
    finally:
        _job.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def session_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of one action."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


# Spark's setting for removing an action's shuffle files when it ends (from Spark 4.1 on;
# before, they stay until the driver collects its garbage).
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files below a folder of any store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def settle(
    df: DataFrame, name: str = "settled", partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner
    the real size of the table.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_sized(df: DataFrame, name: str = "settled") -> tuple[DataFrame, int]:
    """``settle`` and the size of the rows in bytes of JSON, measured while writing."""
    seen = Observation()
    size = F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("bytes")
    stored = settle(df.observe(seen, size), name)
    return stored, seen.get["bytes"] or 0
