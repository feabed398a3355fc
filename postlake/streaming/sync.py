"""Incremental sync: changes merged into a message table, deletions, and windowed counts of a stream.

A change has uid, uidvalidity, modseq and vanished.  Of a uid the change with the greatest
(uidvalidity, modseq) holds, so re-delivered changes do nothing (X02-X05).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(changes: DataFrame, keys: tuple[str, ...] = ("account_id", "mailbox", "uid")) -> DataFrame:
    """The change of each key that holds; vanished ones stay as marks, so that late older changes can't bring them back.

    A max over a struct combines before the shuffle.
    """
    rest = [c for c in changes.columns if c not in (*keys, "uidvalidity", "modseq")]
    best = F.max(F.struct("uidvalidity", "modseq", *rest)).alias("b")
    return changes.groupBy(*keys).agg(best).select(*keys, "b.*").select(*changes.columns)


def forced(state: DataFrame, full: DataFrame) -> DataFrame:
    """state with a full read of some mailboxes in place of all that is known of them."""
    boxes = full.select("account_id", "mailbox").distinct()
    return state.join(boxes, ["account_id", "mailbox"], "left_anti").select(*full.columns).unionByName(full)


def unseen(messages: DataFrame, flags: str = "flags") -> DataFrame:
    """A snapshot of the messages without the seen flag; no checkpoint moves."""
    return messages.where(~F.coalesce(F.array_contains(F.col(flags), "\\Seen"), F.lit(False)))


def each_message(stream: DataFrame, handle: Callable, checkpoint: str) -> StreamingQuery:
    """Call handle(row) on the executors for every message of a stream; nothing is kept."""
    return stream.writeStream.foreach(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def visible(state: DataFrame) -> DataFrame:
    """Messages that are there: not vanished, and of their mailbox's newest uidvalidity."""
    newest = state.groupBy("account_id", "mailbox").agg(F.max("uidvalidity").alias("__v"))
    return state.join(newest, ["account_id", "mailbox"]).where("uidvalidity = __v and not vanished").drop("__v")


def checkpoints(state: DataFrame) -> DataFrame:
    """Per mailbox the place to go on from: uidvalidity, last uid, highest modseq."""
    top = state.groupBy("account_id", "mailbox").agg(F.max("uidvalidity").alias("uidvalidity"))
    return state.join(top, ["account_id", "mailbox", "uidvalidity"]).groupBy("account_id", "mailbox", "uidvalidity").agg(F.max("uid").alias("last_uid"), F.max("modseq").alias("highest_modseq"))


BOXES = 1024  # parts that the table is merged by


def box() -> Column:
    return F.pmod(F.xxhash64("account_id", "mailbox"), F.lit(BOXES)).cast("int")


def state(spark: SparkSession, folder: str, before: int | None = None, fresh: bool = False) -> DataFrame | None:
    """The table as of its newest version (or that before a version), None if there is none.

    A version has only the boxes that its batch touched; of each box the newest version holds.
    With fresh, a table that can't be opened counts as none, with a warning (X08).
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
    found = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))
    found = [v for v in found if before is None or v < before]
    if not found:
        return None
    try:
        every = spark.read.option("basePath", folder).parquet(*(f"{folder}/version={v}" for v in found))
    except Exception as e:
        if not fresh:
            raise
        warnings.warn(f"the table in {folder} can't be read, starting anew: {e}", stacklevel=2)
        return None
    # of partition columns alone, so no data is read for it; of BOXES rows at most
    newest = every.groupBy("box").agg(F.max("version").alias("version"))
    return every.join(F.broadcast(newest), ["box", "version"], "left_semi").drop("box", "version")


def merge_into(folder: str, fresh: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch into the boxes that it touches, as version n of these.

    A version is named by its batch and made of those before, so a batch that is run again
    after a failure writes the same version again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, mine = batch.sparkSession, batch.withColumn("box", box())
        old = state(spark, folder, number, fresh)
        if old is not None:
            touched = mine.select(F.col("box").alias("t")).distinct()  # of BOXES rows at most
            kept = old.withColumn("box", box()).join(F.broadcast(touched), F.col("box") == F.col("t"), "left_semi")
            mine = kept.unionByName(mine)
        latest(mine.drop("box")).withColumn("box", box()).write.mode("overwrite").partitionBy("box").parquet(f"{folder}/version={number}")

    return run


def vacuum(spark: SparkSession, folder: str) -> None:
    """Delete what newer versions have replaced; not while a batch runs."""
    every = spark.read.option("basePath", folder).parquet(folder).select("box", "version").distinct()
    newest = every.groupBy("box").agg(F.max("version").alias("top"))
    old = every.join(newest, "box").where("version < top").collect()  # of boxes and versions, not of rows
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for r in old:
        path = make(f"{folder}/version={r['version']}/box={r['box']}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sync(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Merge change files of a folder into the versioned table, until all are done."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(merge_into(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts in tumbling windows, for streams with a watermark after which late rows are dropped."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    counted = events.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n")
