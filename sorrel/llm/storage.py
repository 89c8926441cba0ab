"""The shared folder: where lineage is cut so that lost executors cost no recomputation of what came before."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder if Spark runs on this machine only.

    On a cluster it must be set, as a folder of one machine can't be read by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "here" not in _own:
        _own["here"] = tempfile.mkdtemp(prefix="sorrel-")
        atexit.register(shutil.rmtree, _own["here"], ignore_errors=True)
    return f"file://{_own['here']}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again with its own schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sorrel-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sorrel_path = path
    return out


def settle(spark: SparkSession) -> None:
    """Has the shuffle files of tables that are no longer referred to deleted now; else they stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._sorrel_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def size_in_bytes(df: DataFrame) -> int:
    """About what the rows of a stored table take in memory."""
    width = F.lit(16 + 8 * len(df.columns))
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            width = width + 8 * F.coalesce(F.size(field.name), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(width), F.lit(0)).cast("long")).first()[0])


def limited_broadcast(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """A stored table marked for broadcast if its rows take at most so many bytes; beyond, Spark joins by shuffle."""
    if size_in_bytes(df) > limit:
        return df
    out = F.broadcast(df)
    out._sorrel_path = df.__dict__.get("_sorrel_path")
    return out


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out
