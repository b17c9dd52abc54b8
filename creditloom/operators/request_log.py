"""Request-log metrics: route/status counts, latency histogram, trailing
attempts and the per-key admission limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import count_if, ntz_micros
from ..schema import LATENCY_BUCKETS_MS
from ..session import cut_lineage, new_table_path
from .ordering import rank_within_groups


def status_group(code) -> F.Column:
    return F.concat(F.floor(F.col(code) / 100).cast("string"), F.lit("xx"))


def requests_by_route(req: DataFrame) -> DataFrame:
    """Requests and 5xx errors per (route, status group 'Nxx')."""
    return req.groupBy("route", status_group("status_code").alias("status_group")).agg(
        F.count(F.lit(1)).alias("requests"), count_if(F.col("status_code") >= 500).alias("errors_5xx")
    )


def latency_histogram(req: DataFrame) -> DataFrame:
    """Cumulative 'le' buckets 50, 100, 250, 500, 1000, +Inf ms.

    Each request falls in the first bucket whose bound it does not exceed;
    per-bucket counts are a map-side-combined aggregate, and the running
    sum runs over the fixed six-row bucket table only.
    """
    d = F.col("duration_ms")
    idx = F.lit(len(LATENCY_BUCKETS_MS))
    for i, b in reversed(list(enumerate(LATENCY_BUCKETS_MS))):
        idx = F.when(d <= F.lit(b), F.lit(i)).otherwise(idx)
    idx = F.when(d.isNull() | F.isnan(d), F.lit(None)).otherwise(idx)
    counts = req.select(idx.alias("bucket")).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("bucket_count")
    )
    labels = [(i, f"{b:.0f}") for i, b in enumerate(LATENCY_BUCKETS_MS)] + [(len(LATENCY_BUCKETS_MS), "+Inf")]
    buckets = req.sparkSession.createDataFrame(labels, "bucket int, le string")
    joined = F.broadcast(buckets).join(counts, "bucket", "left").fillna(0, subset=["bucket_count"])
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # six rows, fixed by code
    return joined.select("bucket", "le", "bucket_count", F.sum("bucket_count").over(running).alias("cumulative_count"))


def _micros(c: str, df: DataFrame | None = None) -> F.Column:
    """Event time in epoch microseconds (wall clock read as UTC)."""
    if df is not None and isinstance(df.schema[c].dataType, T.TimestampType):
        return F.unix_micros(F.col(c))
    return ntz_micros(F.col(c).cast("timestamp_ntz"))


# Time buckets are this many windows wide; only rows in the last window of a
# bucket are copied (as context) into the next one, so rows are shuffled
# 1 + 1/BUCKET_WINDOWS times while every row still sees its whole window.
BUCKET_WINDOWS = 4


def _with_context(rows: DataFrame, window_us: int) -> DataFrame:
    """Rows tagged with their time bucket (``_b``, own rows) plus copies of the
    last window of each bucket tagged with the next bucket (context rows)."""
    width = window_us * BUCKET_WINDOWS
    b = F.floor(F.col("_t") / F.lit(width))
    own = rows.withColumn("_b", b).withColumn("_own", F.lit(True))
    tail = F.col("_t") >= (b + 1) * F.lit(width) - F.lit(window_us)
    ctx = rows.where(tail).withColumn("_b", b + 1).withColumn("_own", F.lit(False))
    return own.unionByName(ctx)


def trailing_attempts(req: DataFrame, window_seconds: int = 60, key: str = "client_key", ts: str = "ts") -> DataFrame:
    """Attempts by the same key within [t - w, t] (peers at t included).

    A hot key is split by time: rows are bucketed into spans of a few
    windows; the last window of each span is copied, as context only, into
    the next span, so each (key, bucket) partition holds everything its own
    rows can see.
    """
    w_us = int(window_seconds * 1_000_000)
    both = _with_context(req.withColumn("_t", _micros(ts, req)), w_us)
    win = Window.partitionBy(key, "_b").orderBy("_t").rangeBetween(-w_us, 0)
    out = both.withColumn("trailing_attempts", F.count(F.lit(1)).over(win)).where("_own")
    return out.drop("_t", "_b", "_own")


#: Events of one key that one task decides at a time.
SLICE_EVENTS = 500_000


def admit(stamps: np.ndarray, state: Sequence[int], limit: int, window_us: int) -> tuple[np.ndarray, list[int]]:
    """Decisions for ``stamps`` (ascending), and the admitted stamps that still count after the last one.

    ``state`` holds the admitted stamps before them (at most ``limit``). When
    the window is full, the scan jumps to the first stamp after the oldest
    admitted one leaves it, so rejected stretches cost one binary search.
    """
    admitted, held = np.zeros(len(stamps), bool), deque(state)
    i = 0
    while limit > 0 and i < len(stamps):
        now = int(stamps[i])
        while held and held[0] < now - window_us:
            held.popleft()
        if len(held) < limit:
            admitted[i] = True
            held.append(now)
            i += 1
        else:
            i = int(np.searchsorted(stamps, held[0] + window_us, side="right"))
    last = int(stamps[-1]) if len(stamps) else 0
    return admitted, [s for s in held if s >= last - window_us]


def _flag_crowded(rows: DataFrame, limit: int, window_us: int) -> DataFrame:
    """``_crowded``: ``limit`` earlier attempts of the key lie in the trailing window.

    Any other attempt is admitted whatever was decided before it, because the
    admitted attempts are among the attempts. One window per (key, time
    bucket), the bucket's preceding window copied in as context.
    """
    w = Window.partitionBy("_key", "_b").orderBy("_t", "event_id")
    seen = _with_context(rows, window_us).withColumn("_back", F.lag("_t", limit).over(w)).where("_own")
    crowded = F.coalesce(F.col("_back") >= F.col("_t") - F.lit(window_us), F.lit(False))
    return seen.withColumn("_crowded", crowded).drop("_b", "_own", "_back")


def _decide_slices(limit: int, window_us: int):
    """Decisions of one slice; its last row carries the state for the next slice."""

    def run(key, events: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        events = events.sort_values("_rank", kind="mergesort")
        before = sorted(state["_held"].iloc[0]) if len(state) and state["_held"].iloc[0] is not None else []
        admitted, held = admit(events["_t"].to_numpy(), [int(s) for s in before], limit, window_us)
        out = events[["event_id", "client_key", "ts", "_key", "_slice"]].assign(admitted=admitted)
        out["_held"] = [None] * (len(out) - 1) + [held] if len(out) else []
        return out

    return run


def rate_limit_admission(req: DataFrame, limit: int = 30, window_seconds: int = 60, slice_events: int = SLICE_EVENTS) -> DataFrame:
    """Admit an attempt if fewer than ``limit`` *admitted* attempts of the same
    key fall within the trailing ``window_seconds`` (inclusive); attempts at
    one instant follow each other by ``event_id``.

    1. An attempt with fewer than ``limit`` earlier attempts in its window is
       admitted; a window function finds these (``_flag_crowded``).
    2. Each key's attempts are ranked and cut into slices of ``slice_events``.
       A slice without a crowded attempt is done, and leaves its own last
       attempts as the state for the next one.
    3. Only slices with crowded attempts are scanned. A chain of such slices of
       one key is decided slice by slice: one round decides the next slice of
       every chain at once, and hands on at most ``limit`` stamps. A round's
       decisions are written before the next one reads its states, so a lost
       executor repeats one slice, and no task holds more than a slice.

    A null key is a key of its own. Attempts without a stamp are not admitted
    (the trailing window of an unknown instant is unknown).
    """
    w_us, step = int(window_seconds * 1_000_000), max(int(slice_events), limit + 1, 2)
    key = F.coalesce(F.concat(F.lit("k"), F.col("client_key")), F.lit("null"))
    every = req.select("event_id", "client_key", "ts", _micros("ts", req).alias("_t"), key.alias("_key"))
    undated = every.where(F.col("_t").isNull())
    flagged = _flag_crowded(every.where(F.col("_t").isNotNull()), limit, w_us)
    ranked = rank_within_groups(flagged, ["_key"], [F.col("_t"), F.col("event_id")], "_rank", few_groups=False)
    events = cut_lineage(ranked.withColumn("_slice", F.floor((F.col("_rank") - 1) / F.lit(step))))

    slices = events.groupBy("_key", "_slice").agg(F.max("_crowded").alias("_crowded"))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_slice"))
    chained = slices.where("_crowded").withColumn("_chain", F.col("_slice") - nth)
    depth = F.row_number().over(Window.partitionBy("_key", "_chain").orderBy("_slice")) - 1
    chained = cut_lineage(chained.select("_key", "_slice", depth.alias("_depth")))
    rounds = chained.agg(F.max("_depth")).first()[0]

    columns = ["event_id", "client_key", "ts"]
    done = events.join(chained.select("_key", "_slice"), ["_key", "_slice"], "left_anti").select(*columns, F.lit(True).alias("admitted"))
    out = done.unionByName(undated.select(*columns, F.lit(False).alias("admitted")))
    if rounds is None:
        return out

    # the slice before a chain has no crowded attempt: its last ``limit`` attempts are all admitted
    first = chained.where("_depth = 0").select("_key", "_slice")
    tail = events.where((F.col("_rank") - 1) % step >= step - limit).select("_key", (F.col("_slice") + 1).alias("_slice"), "_t")
    state = tail.join(first, ["_key", "_slice"], "left_semi").groupBy("_key", "_slice").agg(F.collect_list("_t").alias("_held"))

    crowded = cut_lineage(events.join(chained, ["_key", "_slice"]).drop("_crowded"))
    path, spark = new_table_path(req.sparkSession), req.sparkSession
    types = {f.name: f.dataType.simpleString() for f in req.schema.fields}
    schema = ", ".join([*[f"{c} {types[c]}" for c in columns], "_key string, _slice bigint, admitted boolean, _held array<bigint>"])
    for depth in range(rounds + 1):
        now = crowded.where(F.col("_depth") == depth).drop("_depth")
        decided = now.groupBy("_key", "_slice").cogroup(state.groupBy("_key", "_slice")).applyInPandas(_decide_slices(limit, w_us), schema)
        decided.write.parquet(f"{path}/depth={depth}")
        state = spark.read.schema(schema).parquet(f"{path}/depth={depth}").where(F.col("_held").isNotNull())
        state = state.select("_key", (F.col("_slice") + 1).alias("_slice"), "_held").join(
            chained.where(F.col("_depth") == depth + 1).select("_key", "_slice"), ["_key", "_slice"], "left_semi")
    scanned = spark.read.schema(schema).parquet(*[f"{path}/depth={depth}" for depth in range(rounds + 1)])
    return out.unionByName(scanned.select(*columns, "admitted"))
