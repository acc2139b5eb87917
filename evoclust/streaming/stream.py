"""Structured Streaming driver of the online phase.

The stream is decoded with built-in expressions and every micro-batch goes
through ``ClusterModel.process_batch`` inside ``foreachBatch``.  The
stream's checkpoint holds the source offsets; the model's versioned state
holds the clusters, so a restarted query that replays a batch id restores
that batch's stored result instead of folding it twice.
"""

from __future__ import annotations

import json
import os
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from evoclust.plans.model import ClusterModel
from evoclust.session import remove, scratch_path
from evoclust.sources.points import decode_marked, decode_points


def decode_stream(raw: DataFrame, num_dims: int, marked: bool = False) -> DataFrame:
    """Envelope records -> points; Kafka offsets give the arrival order.
    ``marked`` keeps records that are no points, for the rejects table."""
    decode = decode_marked if marked else decode_points
    if "offset" in raw.columns and "partition" in raw.columns:
        raw = raw.withColumn("_seq", F.shiftleft(F.col("partition").cast("long"), 40) + F.col("offset"))
        return decode(raw, num_dims, seq_col="_seq")
    # arrival position is assigned per micro-batch (file order of the batch)
    return decode(raw, num_dims, seq_col="none")


def run_stream(points: DataFrame, model: ClusterModel, *, trigger_seconds: int | None = None,
               available_now: bool = False, checkpoint: str | None = None, results=None,
               timeout: float | None = None, on_batch=None) -> StreamingQuery:
    """Fold every micro-batch into ``model``.

    ``available_now`` drains what is there and stops; otherwise the query
    fires every ``trigger_seconds`` (default: the model's batch seconds) and
    is stopped after ``timeout`` seconds when given.  ``results`` gets the
    snapshot, progress and (of a marked stream) rejects of every batch; a
    replayed batch writes its stored snapshot again, in case the run ended
    between state and results.
    """
    params = model.params

    def fold(df: DataFrame, batch_id: int) -> None:
        if "seq" not in df.columns:
            df = df.withColumn("seq", F.monotonically_increasing_id())
        if "_ok" in df.columns:
            if results is not None:
                results.write_rejects(df.filter(~F.col("_ok")).select(F.col("value").cast("string")), batch_id)
            df = df.filter(F.col("_ok")).select("time", "features", "label", "seq")
        rec = model.process_batch(df, batch_id)
        if results is not None and rec is not None:
            results.write_batch(model.state, batch_id, rec["rows"], params, model.contingency([batch_id]))
            results.write_progress(rec, batch_id)
        elif results is not None:
            stored = model.stored(batch_id)
            if stored is not None:
                results.write_batch(stored[0], batch_id, stored[1], params, model.contingency([batch_id]))
        if on_batch is not None:
            on_batch(batch_id, rec)

    w = (points.writeStream.foreachBatch(fold)
         .option("checkpointLocation", checkpoint or scratch_path(model.spark, "stream-ckpt")))
    if available_now:
        w = w.trigger(availableNow=True)
    else:
        w = w.trigger(processingTime=f"{trigger_seconds or params.batch_seconds} seconds")
    log = ProgressTable(model.spark, results.root) if results is not None else None
    if log is not None:
        model.spark.streams.addListener(log)
    q = w.start()
    if available_now or timeout is not None:
        try:
            if available_now:
                q.awaitTermination()
            else:
                q.awaitTermination(timeout)
                q.stop()
        finally:
            if log is not None:  # events come after the query's end
                log.ended.wait(30)
                model.spark.streams.removeListener(log)
    return q


def forget_commit(spark: SparkSession, checkpoint: str, batch_id: int) -> None:
    """Takes back the commit of a batch, as if the run had ended before it: a
    query over this checkpoint runs the batch again."""
    for name in (str(batch_id), f".{batch_id}.crc"):
        remove(spark, os.path.join(checkpoint, "commits", name))


def preview_stream(points: DataFrame, sink: str = "console", name: str = "points_preview",
                   trigger_seconds: int = 5) -> StreamingQuery:
    """Print (``console``) or keep in memory (``memory``) the parsed rows."""
    w = points.writeStream.outputMode("append").trigger(processingTime=f"{trigger_seconds} seconds")
    if sink == "memory":
        return w.format("memory").queryName(name).start()
    return w.format("console").option("truncate", "false").start()


def default_timeout(total_rows: int, rate: int, batch_seconds: int) -> float:
    """10 s of start-up plus the time to send the data at ``rate``."""
    return 10 + (total_rows / (batch_seconds * rate)) * batch_seconds


class ProgressTable(StreamingQueryListener):
    """Every event of a query as a JSON document of the ``listener``
    folder, written where it happens; nothing is kept on the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.sc, self.folder, self.ended = spark.sparkContext, os.path.join(root, "listener"), threading.Event()

    def _write(self, name: str, **row) -> None:
        jvm = self.sc._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder, f"{name}.json")
        out = path.getFileSystem(self.sc._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray((json.dumps({**row, "at": time.time()}) + "\n").encode()))
        out.close()

    def onQueryStarted(self, event):
        self._write(f"{event.runId}-started", event="started", run_id=str(event.runId))

    def onQueryProgress(self, event):
        p = event.progress
        self._write(f"{p.runId}-{p.batchId}-{p.numInputRows > 0}", event="progress", run_id=str(p.runId), batch_id=p.batchId,
                    rows=p.numInputRows, trigger_ms=p.durationMs.get("triggerExecution"), durations=json.dumps(dict(p.durationMs)))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._write(f"{event.runId}-terminated", event="terminated", run_id=str(event.runId))
        self.ended.set()
