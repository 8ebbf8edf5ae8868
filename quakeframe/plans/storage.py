"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one only where none is set (local tests)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quakeframe-")
        context.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quakeframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
