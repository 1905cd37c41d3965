"""Intermediate tables as parquet in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame

from fwlens.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """Writes a table to the checkpoint folder and reads it back: compressed, by column, and safe when executors go.

    The folder goes when the driver's program ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/table-{uuid.uuid4().hex}"
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
