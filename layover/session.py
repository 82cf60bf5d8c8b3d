"""Spark session defaults for the retention jobs.

Everything here is plain Spark configuration.  The important choices:

* session time zone pinned to UTC (all timestamps are wall-clock
  ``timestamp_ntz``; the zone only matters for casts to ``timestamp``);
* adaptive query execution with skew-join splitting and partition
  coalescing, because accounts are heavily skewed (some hold thousands of
  passengers);
* the Spark UI is off;
* a checkpoint directory is taken from the session when the cluster sets
  one (``spark.checkpoint.dir``) and only set by us when it is missing,
  as in tests.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "layover", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    # delete reliable RDD checkpoints once their DataFrames are garbage collected
    conf.setdefault("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL-level defaults to an existing session (idempotent).

    Only runtime-settable SQL options are touched, so this is safe on a
    session the cluster created for us.
    """
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the platform (a shared file system);
    we never invent a machine-local folder there.  When Spark runs in local
    mode and nothing is configured (tests, the bench), a scratch folder
    under the system temp dir is created once per application.
    """
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    return (sc.getConf().get("spark.checkpoint.dir", None) or _LOCAL_DIRS.get(sc.applicationId)
            or sc.getCheckpointDir())


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return
    if sc.applicationId in _LOCAL_DIRS or sc.getCheckpointDir() is not None:
        return  # ours, or a folder that the application has set itself
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = os.path.abspath(tempfile.mkdtemp(prefix="layover-ckpt-"))
    sc.setCheckpointDir(local)
    _LOCAL_DIRS[sc.applicationId] = local


#: bytes of input that a range of a parallel scan should hold, and the most ranges
RANGE_BYTES, MOST_RANGES = 256 << 20, 50_000


def range_count(df) -> int:
    """Number of ranges to deal ``df`` into: the session's shuffle partitions,
    or more where the tables it reads are larger than they can hold.  (An
    explicit number is not adapted at run time, so it has to follow the size.)"""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # a plan without statistics counts as endless
    return max(least, min(-(-known // RANGE_BYTES), MOST_RANGES))


#: bytes of Parquet input a shuffle partition of the airline jobs starts with, and
#: bytes of shuffled data that adaptive execution joins small ones up to
DEAL_BYTES, JOINED_BYTES = 4 << 20, 32 << 20


def deal_by_size(spark: SparkSession, *tables) -> None:
    """Let shuffles start from as many partitions as ``tables`` ask for, never
    fewer than the session's.

    The session's number of shuffle partitions does not follow the data: with a
    fixed one a task of a join or a window holds a fixed share of the tables, and
    spills once that share outgrows its memory.  Adaptive execution joins small
    partitions again, so that small tables do not pay for the number."""
    sizes = [int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in tables]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, min(-(-sum(sizes) // DEAL_BYTES), MOST_RANGES))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(JOINED_BYTES))


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of a write in this block are deleted when it ends, not when
    the JVM collects its garbage.  (For plans that run once: a frame run again
    would have to make its shuffles again.)"""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def write_stage(df, path: str) -> None:
    """``df`` as Parquet under ``path``, in little space."""
    with freed_shuffles(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


# ---------------------------------------------------------------------------
# Scratch outputs (staged tables, stored adapter tables) are removed at exit.
# ---------------------------------------------------------------------------
_SCRATCH: list[tuple[SparkSession, str]] = []


def register_scratch(spark: SparkSession, path: str) -> str:
    """Remember a folder this process wrote under the checkpoint dir."""
    _SCRATCH.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if path.startswith("file:") or "://" not in path:
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)
        return
    try:  # other file systems through Hadoop, while the JVM is up
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - best effort
        pass


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of this process before its end."""
    if (spark, path) in _SCRATCH:
        _SCRATCH.remove((spark, path))
        _delete(spark, path)


def release_scratch() -> None:
    """Delete the scratch folders written by this process (local or shared FS)."""
    while _SCRATCH:
        _delete(*_SCRATCH.pop())


atexit.register(release_scratch)
