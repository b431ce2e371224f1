"""W2 per-key throttle and W3 first-version-within-TTL.

Both are the same greedy rule: per key, an event is *accepted* iff no
accepted event of that key lies less than ``gap`` before it; rejected events
do not extend the window.  The rule is order dependent, so no window
expression computes it directly.

Batch twin (exact, distributed):
  1. next(i) = first event of the key at or after t_i + gap (an as-of
     lookup in gap-wide time buckets, see ``next_pointers``);
  2. the accepted events are the chain head, next(head), next(next(head)), ...
     found by pointer doubling: log2(chain length) rounds of joins on event
     ids (unique keys, so no hot key), each round checkpointed.
Every table here grows with the events, and a written one looks small to the
planner (ids compress well): the joins are sort-merge joins, so that no round
sends its pointers through the driver.

Streaming form (``throttle_stream``): each micro-batch joins its events to the
last accepted event of their key, answers what lies inside that window at once
and gives the rest to the batch twin, so a key's rows are spread over its time
buckets there as well and never gathered.  The keys' last accepted events are
a keyed table of changes (``batch_tables``).  No watermark filters rows: every
event of the stream gets an answer, late ones too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revspark.session import cut_lineage
from revspark.streaming.batch_tables import BatchTables, compact


def _cut(df: DataFrame) -> DataFrame:
    return cut_lineage(df)


def next_pointers(events: DataFrame, key: str, ts: str, eid: str, gap_seconds: int) -> DataFrame:
    """(k, id, t, nxt): nxt = id of the first event (in (t, id) order) with
    t >= t_i + gap.

    Skew-safe: time is cut into buckets one gap wide.  The probe t_i + gap
    lies in bucket b(t_i) + 1; a window over (key, bucket) finds the nearest
    later event inside that bucket.  Probes left without one take the first
    event of the next non-empty bucket, looked up once per (key, bucket) from
    one summary row per non-empty bucket.  A key holding a large share of all
    events is therefore spread over its time buckets.
    """
    g = gap_seconds * 1_000_000
    t_us = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.select(F.col(key).alias("k"), F.col(eid).alias("id"), t_us.alias("t")) \
        .withColumn("b", F.floor(F.col("t") / g))
    ev_t = "struct<t:bigint,id:bigint>"
    real = e.select("k", "b", "t", F.lit(1).alias("kind"), "id", F.struct("t", "id").alias("ev"))
    probe = e.select("k", (F.col("b") + 1).alias("b"), (F.col("t") + g).alias("t"), F.lit(0).alias("kind"), "id",
                     F.lit(None).cast(ev_t).alias("ev"))
    # in descending (t, kind, id) order a growing frame ends at the nearest later real event
    w = Window.partitionBy("k", "b").orderBy(F.col("t").desc(), F.col("kind").desc(), F.col("id").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    u = real.unionByName(probe).withColumn("nx", F.last("ev", ignorenulls=True).over(w)) \
        .filter(F.col("kind") == 0).select("k", "b", "id", F.col("nx.id").alias("nxt"))
    # unresolved probes: first event of the first non-empty bucket after b (one lookup per (k, b))
    summ = e.groupBy("k", "b").agg(F.min_by("id", F.struct("t", "id")).alias("first_id"))
    open_b = u.filter(F.col("nxt").isNull()).select("k", "b").distinct()
    look = summ.select("k", "b", "first_id", F.lit(1).alias("kind")).unionByName(
        open_b.select("k", "b", F.lit(None).cast("long").alias("first_id"), F.lit(0).alias("kind")))
    # bucket descending, lookup row before the summary of its own bucket: the frame holds later buckets only
    wb = Window.partitionBy("k").orderBy(F.col("b").desc(), F.col("kind").asc()).rowsBetween(
        Window.unboundedPreceding, -1)
    later = look.withColumn("later", F.last("first_id", ignorenulls=True).over(wb)) \
        .filter(F.col("kind") == 0).select("k", "b", "later")
    nxt = u.join(later.hint("merge"), ["k", "b"], "left").select(
        "k", "id", F.coalesce(F.col("nxt"), F.col("later")).alias("nxt"))
    return e.select("k", "id", "t").join(nxt.hint("merge"), ["k", "id"])


def accepted_ids(events: DataFrame, key: str, ts: str, eid: str, gap_seconds: int) -> DataFrame:
    """Batch twin: (key, id) of accepted events."""
    nodes = _cut(next_pointers(events, key, ts, eid, gap_seconds))
    reached = [_cut(nodes.groupBy("k").agg(F.min_by("id", F.struct("t", "id")).alias("id")))]
    jump = nodes.filter(F.col("nxt").isNotNull()).select("id", F.col("nxt").alias("to"))
    # pointers double every round and only lead forward in time: the loop ends when none is left.  A round moves the
    # reached events (k, at) and the pointers' ends (id, at) in one join and writes what it adds
    while True:
        ends = jump.select(F.lit(None).cast(nodes.schema["k"].dataType).alias("k"), "id", F.col("to").alias("at"))
        here = _union(reached).select("k", F.lit(None).cast(nodes.schema["id"].dataType).alias("id"), F.col("id").alias("at"))
        ahead = jump.select(F.col("id").alias("at"), "to")
        moved = _cut(here.withColumn("head", F.lit(True)).unionByName(ends.withColumn("head", F.lit(False)))
                     .join(ahead.hint("merge"), "at").select("head", "k", "id", "to"))
        step = moved.filter("head").select("k", F.col("to").alias("id"))
        if step.isEmpty():
            break
        reached.append(step)
        jump = moved.filter("not head").select("id", "to")
    return _union(reached).select(F.col("k").alias(key), F.col("id").alias(eid))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def throttle(events: DataFrame, key: str, ts: str, eid: str, gap_seconds: int) -> DataFrame:
    """W2 batch twin: every event with ``accepted``."""
    acc = accepted_ids(events, key, ts, eid, gap_seconds).withColumn("accepted", F.lit(True))
    return events.join(acc.hint("merge"), [key, eid], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def first_version(events: DataFrame, key: str, ts: str, eid: str, gap_seconds: int) -> DataFrame:
    """W3 batch twin: each event is served the version set by the accepted
    event s of its key with s <= e < s.t + gap (exactly one such s).  The
    lookup is an equi-join on (key, time bucket of width gap): a set covers
    its own bucket and the next one."""
    acc = accepted_ids(events, key, ts, eid, gap_seconds)
    t_us = F.unix_micros(F.col(ts).cast("timestamp"))
    g = gap_seconds * 1_000_000
    sets = events.join(acc.hint("merge"), [key, eid]).select(F.col(key).alias("k"), F.col(eid).alias("set_id"),
                                               t_us.alias("st"))
    sets = sets.withColumn("bucket", F.explode(F.array(F.floor(F.col("st") / g), F.floor(F.col("st") / g) + 1)))
    ev = events.select(F.col(key).alias("k"), F.col(eid).alias("id"), t_us.alias("t")) \
        .withColumn("bucket", F.floor(F.col("t") / g))
    j = ev.join(sets.hint("merge"), ["k", "bucket"]).filter(
        ((F.col("st") < F.col("t")) | ((F.col("st") == F.col("t")) & (F.col("set_id") <= F.col("id"))))
        & (F.col("t") < F.col("st") + g))
    return j.select(F.col("k").alias(key), F.col("id").alias(eid), "set_id")


# ------------------------------------------------------------------ streaming

def answer_batch(events: DataFrame, known: DataFrame | None, gap_seconds: int) -> DataFrame:
    """(k, id, ts, accepted, set_id) of a batch's events (k, id, ts), judged against ``known`` (k, last, last_id).

    An event less than the gap after the key's last accepted event, or before
    it, is rejected and served by it.  The others are judged among themselves
    in (time, id) order."""
    t = F.unix_micros("ts")
    if known is None:
        rest, shut = events, None
    else:
        met = events.join(known.hint("merge"), "k", "left")
        inside = F.coalesce(t < F.col("last") + gap_seconds * 1_000_000, F.lit(False))
        shut = met.filter(inside).select("k", "id", "ts", F.lit(False).alias("accepted"), F.col("last_id").alias("set_id"))
        rest = cut_lineage(met.filter(~inside).select("k", "id", "ts"))
    served = rest.join(first_version(rest, "k", "ts", "id", gap_seconds).hint("merge"), ["k", "id"])
    served = served.select("k", "id", "ts", (F.col("id") == F.col("set_id")).alias("accepted"), "set_id")
    return served if shut is None else served.unionByName(shut)


def throttle_stream(stream: DataFrame, key: str, ts: str, eid: str, gap_seconds: int, out_dir: str, checkpoint: str,
                    delay_seconds: int, trigger: dict | None = None) -> None:
    """W2 / W3 over a stream until it is drained (or by ``trigger``).

    Batches are answered in order; inside a batch events go in (time, id)
    order.  ``accepted`` answers W2; ``set_id``, the accepted event whose version
    is served, answers W3.  ``late`` marks events more than ``delay_seconds``
    behind the latest time that earlier batches have seen (the watermark).
    They are answered like any other.  A key's last accepted event is forgotten
    once the watermark has passed its window: a later event of the key that is
    on time would be accepted anyway.  Ids are unique in a batch; a null key is
    a key; events without a time are answered as rejected, served by nothing."""
    gap = gap_seconds * 1_000_000
    rows = stream.select(F.col(key).cast("long").alias("k"), F.col(eid).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts"))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tables = BatchTables(spark, out_dir, batch_id)
        seen = tables.last.seen_until if tables.last else None
        watermark = F.lit(None if seen is None else seen - delay_seconds * 1_000_000).cast("long")
        live = F.coalesce(F.col("last") + gap > watermark, F.lit(True))
        known = tables.latest("state", ["k"])
        # a struct is never null, so that a null key joins like any other
        events = cut_lineage(batch.withColumn("k", F.struct("k")))
        timed = events.filter("ts is not null")
        answers = cut_lineage(answer_batch(timed, None if known is None else known.filter(live), gap_seconds))
        untimed = events.filter("ts is null").select("k", "id", "ts", F.lit(False).alias("accepted"), F.lit(None).cast("long").alias("set_id"))
        late = F.coalesce(F.unix_micros("ts") < watermark, F.lit(False)).alias("late")
        tables.write("answers", answers.unionByName(untimed).select(F.col("k.k").alias(key), F.col("id").alias(eid), "ts", "accepted", "set_id", late), batch_id)
        last = F.max(F.struct(F.unix_micros("ts").alias("last"), F.col("id").alias("last_id"))).alias("v")
        tables.write("state", answers.filter("accepted").groupBy("k").agg(last).select("k", "v.*"), batch_id)
        now = timed.agg(F.max(F.unix_micros("ts"))).first()[0]
        seen = max((x for x in (seen, now) if x is not None), default=None)
        base = tables.compacts(batch_id)
        if base:
            old = F.lit(None if seen is None else seen - delay_seconds * 1_000_000).cast("long")
            compact(tables, "state", ["k"], batch_id, F.coalesce(F.col("last") + gap > old, F.lit(True)))
        tables.commit(batch_id, seen, base)

    q = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()


def read_answers(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The answers of all committed batches (None before the first): key, id, ts, accepted, set_id, late, batch_id."""
    return BatchTables(spark, out_dir).read("answers")
