"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Sequence, TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app_name: str = "fwlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints go with the frames that read them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Window frames are computed on epoch microseconds, so the session clock has to be UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in {"UTC", "Etc/UTC", "Z", "GMT", "+00:00"}:
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session may fall back to a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fwlens-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")


T = TypeVar("T")


def concurrently(spark: SparkSession, steps: Sequence[Callable[[], T]]) -> list[T]:
    """Run independent driver steps side by side, so that their Spark jobs overlap; results keep the order."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=max(1, len(steps))) as pool:
        return [future.result() for future in [pool.submit(inherit(step)) for step in steps]]


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in reliable storage, so that reuse survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet beside the checkpoints and read it back, so that each reader scans its columns only.

    The folder goes when the driver's program ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove():
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session may have ended before; the folder belongs to it
            pass

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)


# A broadcast side is held by the driver and every executor: at some 100 bytes per row this stays near 50 MB.
BROADCAST_ROWS = 500_000


def settled(df: DataFrame) -> DataFrame:
    """Materialise a per-source or per-asset table and broadcast it only if its counted size is small.

    Beyond the bound it stays a shuffle join side, which adaptive execution splits when a key is skewed.
    """
    stored = checkpointed(df)
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored
