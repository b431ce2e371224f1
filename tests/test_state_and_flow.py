"""Throttle / TTL against a brute-force walk, streaming = batch, flow graphs."""
from file_tables import SF01

from pyspark.sql import functions as F

from revspark.operators import flow as FL
from revspark.sources import event_flow as EF
from revspark.streaming import throttle as WT


def brute_throttle(rows, gap_us):
    last, out = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        ok = k not in last or t - last[k] >= gap_us
        if ok:
            last[k] = t
        out[i] = ok
    return out


def test_throttle_batch_matches_brute_force(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "ts", "user_id")
    gap = 3 * 3600
    got = {r.event_id: r.accepted for r in WT.throttle(ev, "user_id", "ts", "event_id", gap).collect()}
    rows = [(r.user_id, r.t, r.event_id) for r in ev.select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).collect()]
    assert got == brute_throttle(rows, gap * 1_000_000)


def test_first_version_every_event_served_once(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "ts", "user_id") \
        .withColumn("k", F.col("user_id") % 20)
    fv = WT.first_version(ev, "k", "ts", "event_id", 3600)
    assert fv.count() == ev.count() == fv.select("event_id").distinct().count()


def test_stream_in_time_order_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "ts", "user_id")
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for lo, hi in ((1, 10), (11, 20), (21, 31)):
        ev.filter(F.dayofmonth("ts").between(lo, hi)).write.mode("append").parquet(src)
        WT.throttle_stream(spark.readStream.schema(ev.schema).parquet(src), "user_id", "ts", "event_id", 36000, out, f"{tmp_path}/ck", 36000)
    got = WT.read_answers(spark, out)
    assert got.filter("late").isEmpty() and got.select("batch_id").distinct().count() == 3
    batch = WT.first_version(ev, "user_id", "ts", "event_id", 36000)
    assert {(r.event_id, r.accepted, r.set_id) for r in got.collect()} == {(r.event_id, r.event_id == r.set_id, r.set_id) for r in batch.collect()}


def walk_batches(batches, gap, delay):
    """Plain walk: batch after batch, in (time, id) order; a window that the watermark has passed is forgotten."""
    last, seen, out = {}, None, {}
    for n, rows in enumerate(batches):
        mark = None if seen is None else seen - delay
        if mark is not None:
            last = {k: v for k, v in last.items() if v[0] + gap > mark}
        for k, t, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
            ok = k not in last or t >= last[k][0] + gap
            if ok:
                last[k] = (t, i)
            out[i] = (ok, last[k][1], mark is not None and t < mark, n)
            seen = t if seen is None else max(seen, t)
        out.update({i: (False, None, False, n) for _, t, i in rows if t is None})
    return out


def test_stream_with_late_rows_over_many_batches(spark, tmp_path, monkeypatch):
    """Every event is answered: late ones, a hot key, a null key, a null time; changes are compacted on the way."""
    import datetime as dt
    import random

    from revspark.streaming import batch_tables

    monkeypatch.setattr(batch_tables, "COMPACT_EVERY", 3)
    rng = random.Random(3)
    base, schema = dt.datetime(2024, 5, 1), "event_id long, ts timestamp, user_id long"
    src, out, batches, i = f"{tmp_path}/in", f"{tmp_path}/out", [], 0
    for n in range(5):
        rows = []
        for _ in range(80):
            i += 1
            t = 100 * n + rng.randint(0, 99) - (rng.choice([150, 300, 600]) if rng.random() < 0.2 else 0)
            rows.append((rng.choice([1, 1, 1, 2, 3, None]), None if rng.random() < 0.03 else t, i))
        batches.append(rows)
        data = [(i, None if t is None else base + dt.timedelta(seconds=t), k) for k, t, i in rows]
        spark.createDataFrame(data, schema).repartition(3).write.mode("append").parquet(src)
        WT.throttle_stream(spark.readStream.schema(schema).parquet(src), "user_id", "ts", "event_id", 40, out, f"{tmp_path}/ck", 50)
    got = {r.event_id: (r.accepted, r.set_id, r.late, r.batch_id) for r in WT.read_answers(spark, out).collect()}
    assert got == walk_batches(batches, 40, 50)
    assert sum(v[2] for v in got.values()) > 20


def test_a_killed_batch_shows_nothing(spark, tmp_path):
    """Outputs without a commit are not read, and are replaced when the batch is done again."""
    from revspark.streaming.batch_tables import BatchTables

    out = f"{tmp_path}/out"
    first = BatchTables(spark, out, 0)
    first.write("a", spark.range(3), 0)
    assert BatchTables(spark, out).read("a") is None
    first.commit(0)
    second = BatchTables(spark, out, 1)
    second.write("a", spark.range(10, 15), 1)
    assert sorted(r.id for r in BatchTables(spark, out).read("a").collect()) == [0, 1, 2]
    again = BatchTables(spark, out, 1)
    again.write("a", spark.range(20, 21), 1)
    again.commit(1)
    assert sorted(r.id for r in BatchTables(spark, out).read("a").collect()) == [0, 1, 2, 20]


def test_reaching_defs_and_leak_small_graph(spark):
    edges = spark.createDataFrame(
        [(1, "ENTRY", "signup"), (1, "signup", "view"), (1, "view", "EXIT"), (1, "signup", "purchase"),
         (1, "purchase", "EXIT"), (2, "ENTRY", "signup"), (2, "signup", "error"), (2, "error", "EXIT")],
        "graph_id long, src string, dst string").withColumn("edge_type", F.lit("UNCONDITIONAL"))
    nodes = EF.flow_nodes(edges)
    defs = EF.flow_defs(nodes)
    reach = {(r.graph_id, r.node, r.def_id) for r in FL.reaching_definitions(edges, defs).collect()}
    assert (1, "EXIT", "signup:acct") in reach and (1, "EXIT", "purchase:acct") in reach
    assert (1, "purchase", "signup:acct") in reach
    leaks = [(r.graph_id, list(r.path)) for r in FL.leak_paths(edges, nodes, *(EF.flow_marks(nodes, n) for n in (EF.RESOURCE_DEF, EF.CLOSE_NODE, EF.ESCAPE_NODE))).collect()]
    assert leaks == [(1, [5, 6, 1])]
