"""A log of edits as a stream: applied batch by batch to a versioned table, with a feed of changes.

A version is either whole (``v=n``) or a delta (``d=n``): the keys that a batch touched, with their documents, null
where deleted. Every so many deltas a whole version is written and what the one before it replaced is deleted.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..frame import DocumentFrame


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _complete(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, v or d) of the complete versions of a table, in order."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [(int(m[2]), m[1]) for n in names if (m := re.fullmatch(r"([vd])=(\d+)", n)) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(done)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table."""
    return sorted({n for n, _ in _complete(spark, path)})


def _layers(spark: SparkSession, path: str, upto: int | None) -> tuple[int | None, list[int]]:
    """The newest whole version, and the deltas after it."""
    have = [(n, kind) for n, kind in _complete(spark, path) if upto is None or n <= upto]
    base = max((n for n, kind in have if kind == "v"), default=None)
    return base, [n for n, kind in have if kind == "d" and (base is None or n > base)]


def current(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The newest (key, doc), or those of a version still kept. Only the deltas' keys are shuffled."""
    base, deltas = _layers(spark, path, upto)
    read = lambda name: spark.read.schema("key string, doc string").parquet(f"{path}/{name}")
    whole = spark.createDataFrame([], "key string, doc string") if base is None else read(f"v={base}")
    if not deltas:
        return whole
    layers = [read(f"d={n}").withColumn("n", F.lit(n)) for n in deltas]
    changed = reduce(DataFrame.unionByName, layers).groupBy("key").agg(F.max_by(F.struct("doc"), "n").alias("last")).select("key", "last.doc")
    return whole.join(changed, "key", "left_anti").unionByName(changed.where("doc is not null"))


def apply_stream(log: DataFrame, table: str, checkpoint: str, feed: str | None = None, compact: int = 16, **trigger) -> StreamingQuery:
    """Apply a streaming log (key, seq, op, args, and ts if it has one) to the table at a path; lines without a key are left out.

    Batch n makes version n + 1 from version n, from the documents of its keys alone, and written whole before it
    counts, so a batch that is run again after a failure starts from the same version and ends in the same one.
    ``feed``: where change events (key, seq, ts, event, reply, error, batch) are written, a folder per batch.
    ``compact``: deltas before a whole version is written; it and the one before stay.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = batch.where("key is not null").withColumn("key", F.col("key").cast("string")).persist()
        try:
            touched = batch.select("key").distinct()
            frame = DocumentFrame(current(spark, table, n).join(touched, "key", "left_semi"))
            if feed:
                frame.apply_log(batch, feed=True).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{feed}/batch={n}")
            touched.join(frame.apply_log(batch), "key", "left").write.mode("overwrite").parquet(f"{table}/d={n + 1}")
        finally:
            batch.unpersist()
        base, deltas = _layers(spark, table, n + 1)
        if len(deltas) >= compact:
            current(spark, table, n + 1).write.mode("overwrite").parquet(f"{table}/v={n + 1}")
            for old, kind in _complete(spark, table):
                if old < (base or 0) or (kind == "d" and old <= (base or 0)):
                    fs, p = _fs(spark, f"{table}/{kind}={old}")
                    fs.delete(p, True)

    return log.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_counts(feed: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Changes per window and event of a streaming feed with an event time ``ts``."""
    return feed.withWatermark("ts", late).groupBy(F.window("ts", every), "event").agg(F.count(F.lit(1)).alias("n"))
