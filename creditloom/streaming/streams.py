"""Structured Streaming forms of the time-windowed computations.

* R1 feedback ingest: canonicalise and append to the log; each batch is merged
  into the touched buckets of the latest-per-account table.
* R2 dead letters per sliding event-time window.
* R3 request counts and latency buckets per tumbling window.
* R4 per-key admission limiter with keyed state.

Every stream is a transformation of an input streaming DataFrame (file,
Kafka, ... source chosen by the caller) and is tested against its batch
form: rows behind the watermark are dropped by Spark, while the batch job
over the stored log stays exact.
"""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.exprs import instant_to_wall, wall_to_instant
from ..operators import collections_plan as cp
from ..operators.request_log import LATENCY_BUCKETS_MS, admit, status_group
from ..sources.bucketed import BucketedTable
from ..sources.files import align_feedback, canonicalize_feedback

LATEST_PAYLOAD = ["Outcome", "PromiseStatus", "SupervisorEscalation", "FieldNotes", "RecordedAt"]


def event_time(c: str) -> F.Column:
    """Event time as TIMESTAMP for watermarks/windows (wall clock read as UTC,
    independent of the session time zone)."""
    return wall_to_instant(F.col(c))


def _wall(c: str) -> F.Column:
    """Window bound back as wall-clock TIMESTAMP_NTZ (the log's own type)."""
    return instant_to_wall(F.col(c))


# ---------------------------------------------------------------------------
# R1 feedback ingest
# ---------------------------------------------------------------------------


#: Buckets of the latest-per-account table: about one for every few million accounts.
LATEST_BUCKETS = 64


def _latest_table(spark, latest_path: str, buckets: int = LATEST_BUCKETS) -> BucketedTable:
    return BucketedTable(spark, latest_path, "AccountId", buckets)


def read_latest(spark, latest_path: str) -> DataFrame:
    """The current latest-per-account table written by ``feedback_ingest``."""
    return _latest_table(spark, latest_path).read()


def read_log(spark, log_path: str) -> DataFrame:
    """The feedback log, each feedback once: rows that agree in every column are the same feedback."""
    return spark.read.parquet(log_path).drop("batch_id").dropDuplicates()


def feedback_ingest(stream: DataFrame, log_path: str, latest_path: str, checkpoint: str, now_ts: str | None = None,
                    today: str | None = None, trigger: dict | None = None, rejected_path: str | None = None,
                    buckets: int = LATEST_BUCKETS):
    """Start the ingest query; each micro-batch appends canonical rows to the
    log and merges them into the latest-per-account table. Rows without an
    AccountId are rejected (written under ``rejected_path`` when given).

    However late a row is, it is logged: the log is the only copy, so no
    watermark stands before it. Rows of a batch that agree in every source column
    are written once; such rows of different batches are one row of ``read_log``
    if they have a stamp of their own. A missing stamp takes
    ``now_ts`` and ``today``, or else the time its batch starts.

    Every write is keyed by the micro-batch id, so a replayed batch overwrites
    its own output instead of duplicating it. Of the latest table, a batch
    reads and writes only the buckets of its accounts, and readers of the
    version before keep theirs (``sources.bucketed``).
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark, start = batch.sparkSession, datetime.now(timezone.utc)
        accepted, rejected = canonicalize_feedback(
            batch.dropDuplicates(), now_ts or start.strftime("%Y-%m-%dT%H:%M:%SZ"), today or start.strftime("%Y-%m-%d"))
        if rejected_path:
            align_feedback(rejected).write.mode("overwrite").parquet(f"{rejected_path}/batch_id={batch_id}")
        align_feedback(accepted).write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
        # latest-per-account is a max over (stamp, tie, payload): merging the
        # touched buckets with this batch equals recomputing it over the whole log
        stored = spark.read.schema(align_feedback(accepted).schema).parquet(f"{log_path}/batch_id={batch_id}")
        fresh = cp.latest_feedback(stored.select("AccountId", *LATEST_PAYLOAD))
        table = _latest_table(spark, latest_path, buckets)
        if any(v < batch_id for v in table.versions()):
            table.change(fresh, lambda current, new: cp.latest_feedback(current.unionByName(new)), batch_id)
        else:
            table.write(fresh, batch_id)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


# ---------------------------------------------------------------------------
# R2 / R3 windowed counts
# ---------------------------------------------------------------------------


def dead_letters_per_window(jobs: DataFrame, window: str = "1 hour", slide: str = "5 minutes",
                            watermark: str = "1 hour") -> DataFrame:
    """Dead letters per (sliding window, job type); valid batch or stream."""
    dl = jobs.filter(F.col("status") == "dead_letter").withColumn("_et", event_time("updated_at"))
    if dl.isStreaming:
        dl = dl.withWatermark("_et", watermark)
    return dl.groupBy(F.window("_et", window, slide).alias("w"), "job_type").agg(
        F.count(F.lit(1)).alias("dead_letter")
    ).select(_wall("w.start").alias("window_start"), _wall("w.end").alias("window_end"), "job_type", "dead_letter")


def requests_per_window(req: DataFrame, window: str = "1 minute", watermark: str = "5 minutes") -> DataFrame:
    """Requests, 5xx errors and latency-bucket counts per tumbling window and route."""
    r = req.withColumn("_et", event_time("ts"))
    if r.isStreaming:
        r = r.withWatermark("_et", watermark)
    d = F.col("duration_ms")
    buckets = [F.sum(F.when(d <= F.lit(b), 1).otherwise(0)).cast("bigint").alias(f"le_{int(b)}") for b in LATENCY_BUCKETS_MS]
    return r.groupBy(F.window("_et", window).alias("w"), "route", status_group("status_code").alias("status_group")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.when(F.col("status_code") >= 500, 1).otherwise(0)).cast("bigint").alias("errors_5xx"),
        *buckets,
    ).select(_wall("w.start").alias("window_start"), _wall("w.end").alias("window_end"), "route", "status_group",
             "requests", "errors_5xx", *[f"le_{int(b)}" for b in LATENCY_BUCKETS_MS])


# ---------------------------------------------------------------------------
# R4 keyed admission limiter
# ---------------------------------------------------------------------------

ADMISSION_OUT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("client_key", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("admitted", T.BooleanType()),
    ]
)

class AdmissionProcessor(StatefulProcessor):
    """Holds a key's attempts back, by time bucket, until the watermark has
    passed the bucket, then decides them in order of time and id.

    State: the attempts of each open bucket (one map entry a bucket, read once
    and removed), and the admitted stamps that still count (at most
    ``limit``). A timer at the end of each bucket decides it; one more, a
    window after the last admitted stamp, clears a key that fell silent.
    """

    def __init__(self, limit: int, window_us: int, bucket_us: int):
        self.limit, self.window_us, self.bucket_us = limit, window_us, bucket_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "bucket long", "stamps array<long>, ids array<long>")
        self.held = handle.getValueState("held", "stamps array<long>")

    def _due(self, bucket: int) -> int:
        """The first millisecond at which no attempt of the bucket can come any more."""
        return -(-(bucket + 1) * self.bucket_us // 1000)

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            stamps, ids = pdf["micros"].to_numpy(), pdf["event_id"].to_numpy()
            buckets = stamps // self.bucket_us
            for bucket in np.unique(buckets).tolist():
                new = buckets == bucket
                old_stamps, old_ids = self.pending.getValue((bucket,)) if self.pending.containsKey((bucket,)) else ([], [])
                self.pending.updateValue((bucket,), ([*old_stamps, *stamps[new].tolist()], [*old_ids, *ids[new].tolist()]))
                self.handle.registerTimer(self._due(bucket))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        closed = sorted(b for (b,) in self.pending.keys() if self._due(b) <= now)
        held = list(self.held.get()[0]) if self.held.exists() else []
        for bucket in closed:
            stamps, ids = (np.array(x, np.int64) for x in self.pending.getValue((bucket,)))
            self.pending.removeKey((bucket,))
            order = np.lexsort((ids, stamps))
            admitted, held = admit(stamps[order], held, self.limit, self.window_us)
            yield pd.DataFrame({"event_id": ids[order], "client_key": [key[0]] * len(ids),
                                "ts": pd.to_datetime(stamps[order], unit="us", utc=True), "admitted": admitted})
        if closed and held:
            self.held.update((held,))
            self.handle.registerTimer(self._due((held[-1] + self.window_us) // self.bucket_us))
        elif held and self._due((held[-1] + self.window_us) // self.bucket_us) <= now:
            self.held.clear()  # every attempt that could still see the last admitted one is decided

    def close(self) -> None:
        pass


def admission_stream(req: DataFrame, limit: int = 30, window_seconds: int = 60, lateness_seconds: int | None = None,
                     bucket_seconds: float = 1.0) -> DataFrame:
    """Keyed admission over a request stream, equal to the batch decisions for any
    order of arrival within ``lateness_seconds`` (default: one window).

    An attempt is decided once the watermark has passed its time bucket, so
    attempts that arrive late, in the same or a later micro-batch, still take
    their place in time; attempts behind the watermark are dropped by Spark.
    State of a key: its undecided attempts and at most ``limit`` stamps; rows
    are read batch by batch and never gathered per key. Needs the RocksDB
    state store (``session.SESSION_DEFAULTS``); attempts without a stamp are left out.
    """
    w_us = int(window_seconds * 1_000_000)
    rows = req.select("event_id", "client_key", event_time("ts").alias("ts")).where(F.col("ts").isNotNull())
    rows = rows.withColumn("micros", F.unix_micros("ts"))
    rows = rows.withWatermark("ts", f"{int(window_seconds if lateness_seconds is None else lateness_seconds)} seconds")
    processor = AdmissionProcessor(limit, w_us, max(1, int(bucket_seconds * 1_000_000)))
    return rows.groupBy("client_key").transformWithStateInPandas(processor, ADMISSION_OUT, "append", "EventTime")
