"""Session settings and shared staging storage.

Jobs that use an expensive intermediate table more than once write it to the
shared folder named by ``spark.checkpoint.dir`` and read it back. That cuts
lineage, survives executor loss, and gives the optimiser real file sizes to
choose join strategies from.
"""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings every job relies on; none of them names a machine or a data size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins on (article, ...) may use a placement by article alone.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may be whole texts: what a Python worker holds at once is bounded by bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings of :data:`SETTINGS` to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "newsflow", checkpoint_dir: str | None = None) -> SparkSession:
    """Session for tests and the single-node bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if checkpoint_dir is not None:
        builder = builder.config(CHECKPOINT_KEY, checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir``, read from the session.

    Only a ``local`` master may fall back to a temporary folder (tests). On a
    cluster an unset folder is an error, because a machine-local path would be
    invisible to the other executors.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    fallback = tempfile.mkdtemp(prefix="newsflow-")
    spark.conf.set(CHECKPOINT_KEY, fallback)
    return fallback


# Folders staged in the open scopes, innermost last.
_SCOPES: list[list[str]] = []


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it belongs to the innermost open scope, if any."""
    path = f"{shared_dir(spark)}/newsflow/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Folders staged inside are removed at the end, also after an error. What reads them must be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            discard(spark, path)


def job(run: Callable) -> Callable:
    """A job that writes its results: staged folders go when it ends. A frame it returns is a report of a few rows and is kept as rows."""

    @functools.wraps(run)
    def wrapped(*args, **options):
        spark = next(x if isinstance(x, SparkSession) else x.sparkSession for x in (*args, *options.values()) if isinstance(x, (SparkSession, DataFrame)))
        with staging_scope(spark):
            report = run(*args, **options)
            return None if report is None else spark.createDataFrame(report.collect(), report.schema)

    return wrapped


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once per context, so that they need no copy of it on their path."""
    context = spark.sparkContext
    if not getattr(context, "_newsflow_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="newsflow-package-"), "newsflow-package.zip")
        with zipfile.ZipFile(archive, "w") as packed:
            for folder, _, files in os.walk(root):
                for name in sorted(files):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        packed.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(archive)
        context._newsflow_shipped = True
    return spark
