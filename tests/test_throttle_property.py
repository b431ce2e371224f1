"""Property test: the distributed throttle equals a sequential walk."""
import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from revspark.streaming import throttle as WT
from test_state_and_flow import brute_throttle

BASE = dt.datetime(2024, 1, 1)

events = st.lists(
    st.tuples(st.sampled_from([1, 1, 1, 2, 3]),          # key 1 is hot
              st.integers(min_value=0, max_value=200)),  # seconds after BASE (ties allowed)
    min_size=1, max_size=40)


@settings(max_examples=12, deadline=None)
@given(rows=events, gap=st.sampled_from([1, 7, 30]))
def test_throttle_matches_walk(spark, rows, gap):
    data = [(i, BASE + dt.timedelta(seconds=s), k) for i, (k, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, user_id long")
    got = {r.event_id: r.accepted for r in WT.throttle(df, "user_id", "ts", "event_id", gap).collect()}
    walk = brute_throttle([(k, s * 1_000_000, i) for i, (k, s) in enumerate(rows)], gap * 1_000_000)
    assert got == walk


def brute_served(rows, gap_us):
    last, served = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k not in last or t - last[k][0] >= gap_us:
            last[k] = (t, i)
        served[i] = last[k][1]
    return served


@settings(max_examples=10, deadline=None)
@given(rows=events, gap=st.sampled_from([1, 7, 30]))
def test_first_version_matches_walk(spark, rows, gap):
    data = [(i, BASE + dt.timedelta(seconds=s), k) for i, (k, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, user_id long")
    got = {r.event_id: r.set_id for r in WT.first_version(df, "user_id", "ts", "event_id", gap).collect()}
    exp = brute_served([(k, s * 1_000_000, i) for i, (k, s) in enumerate(rows)], gap * 1_000_000)
    assert got == exp
