"""Continuous indexing: sources that land in a folder are taken into the catalog batch by batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sorrel.plans.catalog import SOURCE, Store


def landed(spark: SparkSession, landing: str) -> DataFrame:
    """A stream of sources (rel_path, content, mtime) from files of JSON lines in a landing folder."""
    return spark.readStream.schema(SOURCE).json(landing).where("rel_path is not null and content is not null")


def merged(store: Store, batch: DataFrame) -> DataFrame:
    """The catalog's sources with those of a batch in their place; the latest of several versions counts."""
    fresh = batch.groupBy("rel_path").agg(F.max_by(F.struct("content", "mtime"), F.struct("mtime", "content")).alias("s")).select("rel_path", "s.content", "s.mtime")
    return store.open().source.select("rel_path", "content", "mtime").join(fresh, "rel_path", "left_anti").unionByName(fresh)


def watch(spark: SparkSession, landing: str, store: str, **trigger) -> StreamingQuery:
    """Starts indexing; trigger: what DataStreamWriter.trigger takes (default: all there is now, then stop).

    A batch that is run again after a failure gives the same catalog, as sources are matched by path and content.
    """
    os.makedirs(store, exist_ok=True)
    target = Store(spark, store)

    def take(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            target.index(merged(target, batch))

    return landed(spark, landing).writeStream.foreachBatch(take).option("checkpointLocation", f"{store}/stream").trigger(**(trigger or {"availableNow": True})).start()
