"""Runs as streams: resumable micro-batches and windowed counts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.tables import MANIFEST

EVENTS = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def manifest_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Manifest lines as they arrive, with the manifest's schema (all texts)."""
    schema = ", ".join(f"{f.name} string" for f in MANIFEST.fields)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def claim_run(spark: SparkSession, checkpoint: str, config: dict) -> str:
    """The fingerprint of a run's configuration, kept beside its checkpoint; raises if the checkpoint was made under another one."""
    text = json.dumps(config, sort_keys=True, default=str)
    mark = hashlib.sha256(text.encode()).hexdigest()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}.run.json")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path):
        held = json.loads("".join(r["value"] for r in spark.read.text(path.toString()).collect()))
        if held["fingerprint"] != mark:
            raise ValueError(f"{checkpoint} belongs to a run under another configuration: {json.dumps(held['config'], sort_keys=True)}")
        return mark
    out = files.create(path, False)
    try:
        out.write(json.dumps({"fingerprint": mark, "config": json.loads(text)}).encode())
    finally:
        out.close()
    return mark


def run_resumable(stream: DataFrame, work: Callable[[DataFrame], DataFrame], key: str, out: str, checkpoint: str, config: dict | None = None) -> None:
    """Works through what is available in micro-batches and appends to out; a rerun goes on where the checkpoint stands.

    A batch that runs twice after a failure is written once: each batch has a folder of its own that it overwrites, and
    keys within a batch are unique. With config, a rerun under another configuration raises before it reads anything (see claim_run()).
    """
    if config is not None:
        claim_run(stream.sparkSession, checkpoint, config)

    def write(batch: DataFrame, number: int) -> None:
        work(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


PROGRESS = "run string, done long, failed long, last_ms long, status string"


class _Progress(StatefulProcessor):
    """State of a run: its items, so that repeated events count once, its counts, and a timer that ends it when it has been idle."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item string", "failed boolean")
        self.counts = handle.getValueState("counts", "done long, failed long, last_ms long")

    def _row(self, key: tuple, status: str) -> Row:
        done, failed, last = self.counts.get()
        return Row(run=key[0], done=done, failed=failed, last_ms=last, status=status)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        done, failed, last = self.counts.get() if self.counts.exists() else (0, 0, None)
        for r in rows:
            if r.item is None or self.items.containsKey((r.item,)):
                continue
            self.items.updateValue((r.item,), (bool(r.failed),))
            done, failed, last = done + 1, failed + bool(r.failed), r.ms if last is None else max(last, r.ms)
        if last is None:
            return
        self.counts.update((done, failed, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.idle_ms)
        yield self._row(key, "running")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.counts.exists():
            yield self._row(key, "idle")
        self.items.clear()
        self.counts.clear()

    def close(self) -> None:
        pass


def progress(stream: DataFrame, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(run, done, failed, last, status) of a stream of events (run, item, failed, ts): after each batch the runs that had events,
    "running", and, once the watermark has passed a run's last event by idle, a closing row, "idle", after which its state is gone.

    Repeated events of an item count once. Events that are later than the watermark are left out. State is kept per run and item by
    Spark's state store (the session needs the RocksDB provider); a run's items are a map that is read key by key.
    """
    amount, unit = idle.split()
    ms = int(amount) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]
    x = stream.withWatermark("ts", late).select("run", F.col("item").cast("string").alias("item"), "failed", "ts", F.unix_millis("ts").alias("ms"))
    out = x.groupBy("run").transformWithState(_Progress(ms), PROGRESS, "Update", "EventTime")
    return out.select("run", "done", "failed", F.timestamp_millis("last_ms").alias("last"), "status")


def answered(asked: DataFrame, replies: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(question_id, asked_at, replied_at, reply) of two streams, asked (question_id, ts) and replies (question_id, ts, reply): each question with
    its replies that come within the time after it. Both sides' state goes as the watermarks pass."""
    a = asked.select(F.col("question_id"), F.col("ts").alias("asked_at")).withWatermark("asked_at", late)
    b = replies.select(F.col("question_id").alias("_id"), F.col("ts").alias("replied_at"), "reply").withWatermark("replied_at", late)
    on = (F.col("question_id") == F.col("_id")) & (F.col("replied_at") >= F.col("asked_at")) & (F.col("replied_at") <= F.col("asked_at") + F.expr(f"interval {within}"))
    return a.join(b, on).drop("_id")


def windowed(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per type and tumbling window; state older than the watermark goes."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with less than gap between them (batch or stream with a watermark)."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
