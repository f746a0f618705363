"""Session construction and shared-folder helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this library relies on. The time zone matters for
# P14/S6 (calendar dates of timestamps); ANSI mode is Spark 4's default and the
# operators are written for it (try_* functions where input may be malformed).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_STAGED: list[str] = []


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tidings", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own session."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    Looked for in this order: ``spark.checkpoint.dir`` of the session or of the
    context's configuration, then the folder given to
    ``SparkContext.setCheckpointDir``. Only a local master may go without: it
    gets a temporary folder. On a cluster a missing setting is an error, since
    a machine-local folder cannot be read by the other executors.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and sc.getCheckpointDir() is not None:
        # the context keeps its files in <folder>/<random id>; stage beside them
        configured = sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidings-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def checkpoint_root(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing sub-folder of the shared checkpoint folder
    (streams, staged tables). It is removed by :func:`release_staged`, by an
    enclosing :func:`staging` block, or when the Python process ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidings/{name}-{uuid.uuid4().hex[:12]}"
    if not _STAGED:
        atexit.register(_release_at_exit)
    _STAGED.append(path)
    return path


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`stage`, with the folder of the copy, for :func:`release`."""
    spark = df.sparkSession
    path = checkpoint_root(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts
    the lineage, survives lost executors, and is computed once however often
    the result is used. The shuffle files of the write are removed with it,
    rather than whenever the driver collects its garbage."""
    return stage_at(df, name)[0]


def release_staged(spark: SparkSession, since: int = 0) -> None:
    """Delete the staged folders registered after position ``since``."""
    while len(_STAGED) > since:
        _delete(spark, _STAGED.pop())


def release(spark: SparkSession, path: str) -> None:
    """Delete one staged folder that nothing reads any more; whatever else has been staged stays."""
    if path in _STAGED:
        _STAGED.remove(path)
    _delete(spark, path)


@contextmanager
def staging(spark: SparkSession):
    """Folders staged inside the block are removed at its end; use the results
    (write or collect them) before leaving it."""
    since = len(_STAGED)
    try:
        yield
    finally:
        release_staged(spark, since)


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _STAGED:
        try:
            release_staged(spark)
        except Exception as e:  # the JVM may be gone already; say what was left behind
            print(f"tidings: staged folders left behind: {len(_STAGED) + 1} ({e})")


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 128 << 20) -> dict:
    """Settings for a cluster run sized to the input.

    Shuffle partitions: enough that one post-shuffle partition is about
    ``target_partition_bytes`` even before AQE coalesces (so a task's
    aggregation and sort buffers fit executor memory without spilling much),
    and at least 2 x the cores so every core has work. Scan splits of 256 MiB
    keep the task count of a 100 TB scan near 400k. AQE stays on to coalesce
    small partitions and split skewed ones at run time.
    """
    shuffle = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
        # a side is broadcast only when its measured size is below this
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }
