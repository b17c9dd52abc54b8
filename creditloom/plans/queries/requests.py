"""Queries: request counts, latency buckets, trailing counts, limiter, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ...operators import request_log as rl
from ...schema import LATENCY_BUCKETS_MS
from ...streaming import streams
from .common import J, jobs, R, register, requests


register(
    "requests_by_route",
    O.with_ctes(R, "SELECT route, concat(cast(floor(status_code / 100) AS bigint), 'xx') AS status_group, count(*) AS requests, "
                   f"{O.cnt('status_code >= 500')} AS errors_5xx FROM req GROUP BY 1, 2"),
)(lambda spark, d: rl.requests_by_route(requests(spark, d)))


_BUCKET = "CASE " + " ".join(f"WHEN duration_ms <= {O._f(b)} THEN {i}" for i, b in enumerate(LATENCY_BUCKETS_MS)) + \
    f" ELSE {len(LATENCY_BUCKETS_MS)} END"


_LABELS = ", ".join(f"({i}, '{b:.0f}')" for i, b in enumerate(LATENCY_BUCKETS_MS)) + f", ({len(LATENCY_BUCKETS_MS)}, '+Inf')"


register(
    "latency_histogram",
    O.with_ctes(R, f"SELECT l.bucket, le, coalesce(c.n, 0) AS bucket_count, "
                   "cast(sum(coalesce(c.n, 0)) OVER (ORDER BY l.bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) "
                   "AS cumulative_count "
                   f"FROM (VALUES {_LABELS}) l(bucket, le) LEFT JOIN (SELECT {_BUCKET} AS bucket, count(*) AS n FROM req "
                   "WHERE duration_ms IS NOT NULL AND NOT isnan(duration_ms) GROUP BY 1) c ON l.bucket = c.bucket"),
)(lambda spark, d: rl.latency_histogram(requests(spark, d)))


register(
    "trailing_attempts",
    O.with_ctes(R, "SELECT *, count(*) OVER (PARTITION BY client_key ORDER BY epoch_us(ts) "
                   "RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS trailing_attempts FROM req"),
)(lambda spark, d: rl.trailing_attempts(requests(spark, d), 60))


def _admission_sql(key: str, limit: int, window_us: int) -> str:
    """Event by event in each key's order, with the admitted stamps that still count."""
    return "WITH RECURSIVE " + R[0].strip("\n") + f""",
attempt AS (
  SELECT event_id, {key} AS client_key, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY epoch_us(ts), event_id) AS n FROM req
),
step AS (
  SELECT n, client_key, event_id, ts, true AS admitted, [t] AS held FROM attempt WHERE n = 1
  UNION ALL
  SELECT a.n, a.client_key, a.event_id, a.ts, len(list_filter(s.held, lambda x: x >= a.t - {window_us})) < {limit},
         CASE WHEN len(list_filter(s.held, lambda x: x >= a.t - {window_us})) < {limit}
              THEN list_append(list_filter(s.held, lambda x: x >= a.t - {window_us}), a.t)
              ELSE list_filter(s.held, lambda x: x >= a.t - {window_us}) END
  FROM step s JOIN attempt a ON a.client_key = s.client_key AND a.n = s.n + 1
)
SELECT event_id, client_key, ts, admitted FROM step"""


register("rate_limit_admission", _admission_sql("client_key", 30, 60_000_000))(
    lambda spark, d: rl.rate_limit_admission(requests(spark, d), 30, 60))


# keys that are over the limit most of the time: every slice hands its state on
register("rate_limit_saturated", _admission_sql("route", 2, 3_600_000_000))(
    lambda spark, d: rl.rate_limit_admission(requests(spark, d).withColumn("client_key", F.col("route")), 2, 3600))


register(
    "dead_letter_windows",
    O.with_ctes(
        J,
        "SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, job_type, count(*) AS dead_letter FROM ("
        "SELECT job_type, updated_at, time_bucket(INTERVAL 5 MINUTE, updated_at) - k * INTERVAL 5 MINUTE AS window_start "
        "FROM job CROSS JOIN range(12) r(k) WHERE status = 'dead_letter') "
        "WHERE updated_at >= window_start AND updated_at < window_start + INTERVAL 1 HOUR GROUP BY 1, 2, 3",
    ),
)(lambda spark, d: streams.dead_letters_per_window(jobs(spark, d)))


_LE = ", ".join(f"{O.cnt(f'duration_ms <= {O._f(b)}')} AS le_{int(b)}" for b in LATENCY_BUCKETS_MS)


register(
    "request_windows",
    O.with_ctes(
        R,
        "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE "
        "AS window_end, route, concat(cast(floor(status_code / 100) AS bigint), 'xx') AS status_group, count(*) AS requests, "
        f"{O.cnt('status_code >= 500')} AS errors_5xx, {_LE} FROM req GROUP BY 1, 2, 3, 4",
    ),
)(lambda spark, d: streams.requests_per_window(requests(spark, d)))
