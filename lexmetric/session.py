"""Session settings and the shared scratch folder.

Work that must survive executor loss or cut lineage goes under the folder the
cluster names in ``spark.checkpoint.dir``.  A folder of our own is set only
when the session has none (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "lexmetric", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench: AQE on, UI off, UTC, Arrow on."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Broadcast only on measured sizes: no broadcast from static estimates
        # (they undercount exploded and aggregated tables); adaptive execution
        # broadcasts a side whose runtime size is under 32 MB.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the session's checkpoint folder, setting one only if unset.

    (A remote session has no local SparkContext: its server's setting rules.)
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session
        return spark.conf.get("spark.checkpoint.dir", None)
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    local = tempfile.mkdtemp(prefix="lexmetric-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def shared_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder under the shared checkpoint folder (never reused)."""
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of an execution when it ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the executions inside go as soon as each is done."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)


def staged(df, name: str = "staged"):
    """``df`` by way of zstd Parquet in the shared folder.

    Used before an order is dealt out by ranges: sampling the ranges then reads
    the files instead of running the work behind ``df`` again, and the shuffle
    files of that work are gone before the ordered rows are shuffled.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df):
    """Cut lineage: a reliable checkpoint into the shared checkpoint folder.

    Used where one frame feeds two branches that must see the very same rows
    in the very same partitions (chunk numbering, in-task row ids).  Never a
    local checkpoint: the files survive the loss of any executor.  The shuffle
    files behind it go as soon as it is written; the setting holds for this
    one execution, of a frame of its own, since ``df`` may be run again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with shuffles_freed(spark):
        return df.select("*").checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Put this package on every Python worker's path (``addPyFile``, as
    ``--py-files`` would), once per application.  User functions defined in
    the package (predictors, packers, formatters) are pickled by reference,
    so workers must be able to import it."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session: the server ships code
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="lexmetric-pkg-"), "lexmetric.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _dirs, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder (only if unset) and the package on the workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
