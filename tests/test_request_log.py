"""Request metrics, trailing window counts and the admission limiter."""

import random
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest

from creditloom.operators import request_log as rl


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, client_key string, ts timestamp_ntz")


def _brute_admission(rows, limit, window_s):
    state, out = {}, {}
    for eid, key, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        q = state.setdefault(key, deque())
        while q and q[0] < ts - timedelta(seconds=window_s):
            q.popleft()
        ok = len(q) < limit
        if ok:
            q.append(ts)
        out[eid] = ok
    return out


def test_limit_two_in_sixty_seconds(spark):
    t0 = datetime(2026, 1, 1)
    df = _events(spark, [(1, "k", t0), (2, "k", t0 + timedelta(seconds=1)), (3, "k", t0 + timedelta(seconds=2))])
    got = {r.event_id: r.admitted for r in rl.rate_limit_admission(df, 2, 60).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_admission_matches_brute_force_with_hot_key(spark):
    rnd = random.Random(7)
    t0 = datetime(2026, 1, 1)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 40)}"
        rows.append((i, key, t0 + timedelta(seconds=rnd.randint(0, 900))))
    got = {r.event_id: r.admitted for r in rl.rate_limit_admission(_events(spark, rows), 5, 60).collect()}
    assert got == _brute_admission(rows, 5, 60)


def test_trailing_attempts_brute_force(spark):
    rnd = random.Random(3)
    t0 = datetime(2026, 1, 1)
    rows = [(i, "hot" if i % 2 else f"k{i % 5}", t0 + timedelta(seconds=rnd.randint(0, 600))) for i in range(800)]
    got = {r.event_id: r.trailing_attempts for r in rl.trailing_attempts(_events(spark, rows), 60).collect()}
    for eid, key, ts in rows:
        exp = sum(1 for _, k, t in rows if k == key and ts - timedelta(seconds=60) <= t <= ts)
        assert got[eid] == exp


def test_latency_histogram_is_cumulative(spark):
    df = spark.createDataFrame([(float(x),) for x in [10, 50, 51, 400, 2000]], "duration_ms double")
    got = [(r.le, r.bucket_count, r.cumulative_count) for r in rl.latency_histogram(df).orderBy("bucket").collect()]
    assert got == [("50", 2, 2), ("100", 1, 3), ("250", 0, 3), ("500", 1, 4), ("1000", 0, 4), ("+Inf", 1, 5)]


def test_requests_by_route(spark):
    df = spark.createDataFrame([("/a", 200), ("/a", 503), ("/a", 502), ("/b", 404)], "route string, status_code int")
    got = {(r.route, r.status_group): (r.requests, r.errors_5xx) for r in rl.requests_by_route(df).collect()}
    assert got == {("/a", "2xx"): (1, 0), ("/a", "5xx"): (2, 2), ("/b", "4xx"): (1, 0)}


def _decisions(spark, rows, limit, window, **more):
    got = rl.rate_limit_admission(_events(spark, rows), limit, window, **more).collect()
    assert len(got) == len(rows)
    return {r.event_id: r.admitted for r in got}


@pytest.mark.parametrize("slice_events", [25, 100_000])
def test_one_key_without_a_gap_is_decided_over_many_slices(spark, slice_events):
    """Always saturated: every slice but the first needs the state of the one before it."""
    rnd = random.Random(5)
    t0 = datetime(2026, 1, 1)
    rows = [(i, "only", t0 + timedelta(milliseconds=i * 900 + rnd.randint(0, 4000))) for i in range(400)]
    expected = _brute_admission(rows, 6, 60)
    assert 0.05 < sum(expected.values()) / 400 < 0.2
    assert _decisions(spark, rows, 6, 60, slice_events=slice_events) == expected


def test_bursts_pauses_ties_and_null_keys(spark):
    rnd = random.Random(11)
    t0 = datetime(2026, 1, 1)
    rows, t = [], t0
    for i in range(1500):
        # bursts, quiet gaps longer than the window, stretches at the limit, and many equal stamps
        t = t + timedelta(seconds=rnd.choice([0, 0, 1, 2, 20, 90]) if i % 300 < 200 else 25)
        rows.append((i, None if i % 5 == 0 else "hot" if i % 4 else f"k{i % 7}", t))
    expected = _brute_admission([(i, k or "", t) for i, k, t in rows], 3, 60)
    for slice_events in (90, 100_000):
        assert _decisions(spark, rows, 3, 60, slice_events=slice_events) == expected


def test_admission_of_nothing_of_a_zero_limit_and_of_undated_rows(spark):
    t0 = datetime(2026, 1, 1)
    assert _decisions(spark, [], 3, 60) == {}
    assert _decisions(spark, [(1, "a", t0), (2, "a", None)], 0, 60) == {1: False, 2: False}
    assert _decisions(spark, [(1, "a", t0), (2, "a", None), (3, "b", None)], 2, 60) == {1: True, 2: False, 3: False}


def test_admit_hands_on_the_stamps_that_still_count():
    stamps = np.array([0, 1, 2, 10, 11, 12, 13])
    whole, held = rl.admit(stamps, [], 2, 10)
    assert whole.tolist() == [True, True, False, False, True, True, False] and held == [11, 12]
    for cut in range(len(stamps) + 1):
        first, between = rl.admit(stamps[:cut], [], 2, 10)
        second, end = rl.admit(stamps[cut:], between, 2, 10)
        assert [*first, *second] == whole.tolist()
