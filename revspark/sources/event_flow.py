"""Flow tables derived from ``events`` (FIXTURES.md B2): one graph per user and
week, a node per event type, an edge per pair of consecutive events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revspark.operators.flow import ENTRY, EXIT, G

# Event-graph fixture (FIXTURES.md B2).
NODE_IDS = {"ENTRY": 0, "EXIT": 1, "click": 2, "error": 3, "purchase": 4, "signup": 5, "view": 6}
DEFS = [("view", "nav", True), ("click", "nav", False), ("signup", "acct", True), ("purchase", "acct", False)]
USES = [("error", "acct"), ("purchase", "acct"), ("error", "nav"), ("click", "nav")]
RESOURCE_DEF, CLOSE_NODE, ESCAPE_NODE = "signup", "purchase", "error"
GUARD_SRC, GUARD_VAR = "click", "acct"
BUCKET_SECONDS = 60


def graph_key(events: DataFrame) -> DataFrame:
    week = F.date_trunc("week", F.col("ts"))
    gid = F.col("user_id") * 100000 + F.datediff(F.to_date(week), F.lit("1970-01-01"))
    return events.select(gid.cast("long").alias(G), "ts", "event_id", F.col("event_type").alias("node"))


def event_edges(events: DataFrame) -> DataFrame:
    """Distinct consecutive (src, dst) pairs per graph in (ts, event_id)
    order, plus ENTRY -> first and last -> EXIT.

    Skew-safe: events are ordered inside (graph, minute) buckets; only one
    summary row per non-empty bucket is ordered per graph to stitch the
    pairs that cross bucket borders.  A graph holding a large share of all
    events is therefore spread over many tasks.
    """
    e = graph_key(events).withColumn(
        "bucket", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / BUCKET_SECONDS))
    order = [F.col("ts"), F.col("event_id")]
    w = Window.partitionBy(G, "bucket").orderBy(*order)
    inner = e.withColumn("dst", F.lead("node").over(w)).filter(F.col("dst").isNotNull()) \
        .select(G, F.col("node").alias("src"), "dst")
    summ = e.groupBy(G, "bucket").agg(
        F.min_by("node", F.struct(*order)).alias("first"), F.max_by("node", F.struct(*order)).alias("last"))
    wb = Window.partitionBy(G).orderBy("bucket")
    summ = summ.withColumn("next_first", F.lead("first").over(wb)) \
        .withColumn("is_first", F.row_number().over(wb) == 1) \
        .withColumn("is_last", F.lead("bucket").over(wb).isNull())
    border = summ.filter(F.col("next_first").isNotNull()).select(G, F.col("last").alias("src"),
                                                                  F.col("next_first").alias("dst"))
    entry = summ.filter("is_first").select(G, F.lit(ENTRY).alias("src"), F.col("first").alias("dst"))
    exit_ = summ.filter("is_last").select(G, F.col("last").alias("src"), F.lit(EXIT).alias("dst"))
    return inner.unionByName(border).unionByName(entry).unionByName(exit_).distinct() \
        .withColumn("edge_type", F.lit("UNCONDITIONAL"))


def _lookup(pairs, key_col, value_name):
    m = F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, key_col).alias(value_name)


def flow_nodes(edges: DataFrame) -> DataFrame:
    n = edges.select(G, F.col("src").alias("node")).unionByName(edges.select(G, F.col("dst").alias("node"))).distinct()
    node_id = _lookup(NODE_IDS.items(), F.col("node"), "node_id")
    # ENTRY and EXIT are on no line
    line = F.when(F.col("node").isin(ENTRY, EXIT), F.lit(-1)).otherwise(node_id).cast("int").alias("line")
    return n.select(G, "node", node_id, F.concat(F.lit("graph/"), F.col(G).cast("string")).alias("file"), line, F.col("node").alias("label"))


def flow_defs(nodes: DataFrame) -> DataFrame:
    rows = []
    for node, var, is_null in DEFS:
        rows.append(nodes.filter(F.col("node") == node).select(
            G, "node", F.lit(var).alias("var"), F.lit(is_null).alias("is_null")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("def_id", F.concat(F.col("node"), F.lit(":"), F.col("var")))


def flow_uses(nodes: DataFrame) -> DataFrame:
    out = None
    for node, var in USES:
        r = nodes.filter(F.col("node") == node).select(G, "node", F.lit(var).alias("var"))
        out = r if out is None else out.unionByName(r)
    return out


def flow_guards(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") == GUARD_SRC).select(G, "src", "dst", F.lit(GUARD_VAR).alias("var"))


def flow_marks(nodes: DataFrame, node: str, var: str = GUARD_VAR) -> DataFrame:
    """(graph_id, node, var) of the nodes of that name."""
    return nodes.filter(F.col("node") == node).select(G, "node", F.lit(var).alias("var"))
