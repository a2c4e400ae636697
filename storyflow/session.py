"""Session helpers: UTC, adaptive execution, and a durable scratch area."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SCRATCH_KEY = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that results depend on and make the package known to tasks."""
    _ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Whole pages and texts go to Python: the batches bound what a worker holds, however many rows a task has.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    # Streaming sessions merge inside a task before the shuffle.
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return spark


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, wherever it was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="storyflow-code-")) / "storyflow.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def local_session(name: str = "storyflow", cpus: int | str = "*", shuffle: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def bounded(df: DataFrame, limit: int, what: str) -> DataFrame:
    """Check that ``df`` has at most ``limit`` rows before it is broadcast or collected."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return df


_local_scratch: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    On a cluster this is the session's ``spark.checkpoint.dir``. Only a local
    master without that setting (tests) falls back to a temporary folder.
    """
    global _local_scratch
    configured = spark.conf.get(_SCRATCH_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError(f"set {_SCRATCH_KEY} to a folder that every executor can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="storyflow-")
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/storyflow/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch area and read it back.

    Cuts lineage in iterative operators and lets the job survive lost
    executors: a retried task re-reads files instead of recomputing rounds.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
