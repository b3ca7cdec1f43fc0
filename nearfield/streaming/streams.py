"""Structured Streaming forms: each reads a stream to its end (availableNow) and returns the table it has written."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from nearfield.sources.records import append_new


def folder(spark: SparkSession) -> str:
    """A new folder below the one that executors share, a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "nearfield-streams")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


#: Files read at a time, and batches that a table is read in (more files at a time where it has more).
FILES, BATCHES = 1, 8


def source(spark: SparkSession, path: str) -> DataFrame:
    """A table (a folder, or a single file) read as a stream, some files at a time: what a batch costs by itself (some
    1.5 s) is paid about BATCHES times, however many files there are."""
    at = spark.read.parquet(path)
    reader = spark.readStream.schema(at.schema).option("maxFilesPerTrigger", max(FILES, -(-len(at.inputFiles()) // BATCHES)))
    above, _, name = path.rstrip("/").rpartition("/")
    if any(f.endswith(f"/{name}") for f in at.inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(above)
    return reader.parquet(path)


def routed(events: DataFrame, kind: str, wanted: list[str]) -> DataFrame:
    """Only the kinds that are acted on leave the source."""
    return events.filter(F.col(kind).isin(wanted))


def _drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    spark, at = stream.sparkSession, folder(stream.sparkSession)
    out = f"{at}/out"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """Events by type and six hours of event time."""
    d = source(spark, path).withColumn("t", F.col("ts").cast("timestamp"))
    g = d.withWatermark("t", "1 day").groupBy("event_type", F.window("t", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return _drain(g, "complete").select("event_type", F.col("w.start").cast("timestamp_ntz").alias("period"), "n")


def dedup(spark: SparkSession, path: str) -> DataFrame:
    """A row for each user and type that is new within the watermark (long enough here to hold all)."""
    d = source(spark, path).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("t"))
    return _drain(d.withWatermark("t", "10000 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])).select("user_id", "event_type")


class Siblings(StatefulProcessor):
    """Of each conversation: turns wait until one is confirmed; then they, and all that follow, are escalated, once each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.confirmed = handle.getValueState("confirmed", "value boolean")
        self.waiting = handle.getListState("waiting", "turn bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        open_, any_ = [], False
        for d in rows:
            turn, confirmed = d["turn"].to_numpy(), d["confirmed"].to_numpy(bool)
            open_ += turn[~confirmed].tolist()
            any_ = any_ or bool(confirmed.any())
        known = self.confirmed.exists()  # every call of the state is a message to the JVM
        if not known and any_:
            self.confirmed.update((True,))
            open_ = [int(x[0]) for x in self.waiting.get()] + open_
            self.waiting.clear()
        if known or any_:
            if open_:
                yield pd.DataFrame({"conv_id": [key[0]] * len(open_), "turn": open_})
        elif open_:
            self.waiting.appendList([(t,) for t in open_])

    def close(self) -> None:
        pass


def siblings(spark: SparkSession, path: str) -> DataFrame:
    """Turns that a confirmed sibling escalates, in either order of arrival."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        d = source(spark, path).select("conv_id", F.col("turn").cast("bigint").alias("turn"), (F.length("text") % 5 == 0).alias("confirmed"))
        out = d.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=Siblings(), outputStructType="conv_id bigint, turn bigint", outputMode="Append", timeMode="None")
        return _drain(out)
    finally:
        spark.conf.set(provider, before)


def append_sink(spark: SparkSession, path: str) -> DataFrame:
    """Micro-batches appended to a table, rows whose key is stored or repeated in the batch left out."""
    at = folder(spark)
    d = source(spark, path).select((F.col("user_id") % 10).alias("guild"), "event_type")
    q = d.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(lambda b, _: append_new(b, f"{at}/out", ["guild", "event_type"])).start()
    q.awaitTermination()
    return spark.read.schema(d.schema).parquet(f"{at}/out")
