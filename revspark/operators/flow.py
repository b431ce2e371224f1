"""Flow-graph operators G1-G7 over node / edge / def / use / guard tables.

The reference builds one control-flow graph per method and runs a worklist
fixpoint and DFS path search on it.  Here all graphs live in shared tables
keyed by ``graph_id`` and every analysis is a semi-naive loop of DataFrame
joins run for all graphs at once: the number of rounds is the longest
shortest path, not the number of graphs.  Each round's frontier is
checkpointed into the shared checkpoint folder (``spark.checkpoint.dir``),
which cuts the lineage and survives executor loss.

Tables
  edges(graph_id, src, dst, edge_type)               (a set)
  nodes(graph_id, node, node_id, file, line, label)  node_id orders witness paths
  defs(graph_id, node, var, def_id, is_null)         a parameter is a def at ENTRY
  uses(graph_id, node, var)
  guards(graph_id, src, dst, var)                    guarding edges per var
  resources / closes / escapes(graph_id, node, var)  for the leak search

``sources.event_flow`` derives such tables from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.session import cut_lineage

G = "graph_id"
ENTRY, EXIT = "ENTRY", "EXIT"
SEEN_CUT_EVERY = 4


# ------------------------------------------------------------------- G1 / G2

def successors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select(G, "node").join(edges.select(G, F.col("src").alias("node"), "dst"), [G, "node"])


def predecessors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select(G, "node").join(edges.select(G, F.col("dst").alias("node"), "src"), [G, "node"])


def remove_edge(edges: DataFrame, drop: DataFrame) -> DataFrame:
    return edges.join(drop.select(G, "src", "dst"), [G, "src", "dst"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """G1: out- and in-degree of every node (partial aggregation, one shuffle each)."""
    out_d = edges.groupBy(G, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    in_d = edges.groupBy(G, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out_d.join(in_d, [G, "node"], "full").select(
        G, "node", F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"),
        F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))


def gen_kill(defs: DataFrame) -> DataFrame:
    """gen(n) = defs at n; kill(n) = other defs of every var defined at n."""
    gen = defs.select(G, "node", "def_id", F.lit("gen").alias("kind"))
    a = defs.select(G, "node", "var")
    b = defs.select(G, F.col("node").alias("other"), "var", "def_id")
    kill = a.join(b, [G, "var"]).filter(F.col("other") != F.col("node")).select(
        G, "node", "def_id", F.lit("kill").alias("kind"))
    return gen.unionByName(kill)


# ------------------------------------------------------------ fixpoint loops

def _cut(df: DataFrame) -> DataFrame:
    return cut_lineage(df)


def same_graphs(edges: DataFrame, defs: DataFrame) -> DataFrame:
    """(graph_id, rep): rep is the smallest graph with the same edges and the same definitions.

    Graphs are equal if the counts and two independent sums of 64-bit hashes of
    their rows are; no row lists are built, partial sums travel.  Among 10 ** 12
    graphs two different ones meet with a probability below 1e-13."""
    def facts(df: DataFrame, kind: str, cols: list[str]) -> DataFrame:
        text = F.to_json(F.struct(*cols))
        return df.select(G, F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), text).alias("h1"), F.xxhash64(text, F.lit(kind), F.lit(1)).alias("h2"))

    rows = facts(edges, "e", ["src", "dst"]).unionByName(facts(defs, "d", ["node", "var", "def_id"]))
    total = lambda h: F.sum(F.col(h).cast("decimal(38,0)")).alias(h)
    shapes = rows.groupBy(G).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "e").alias("n_edges"), total("h1"), total("h2"))
    key = ["n", "n_edges", "h1", "h2"]
    return shapes.join(shapes.groupBy(*key).agg(F.min(G).alias("rep")), key).select(G, "rep")


def reaching_definitions(edges: DataFrame, defs: DataFrame) -> DataFrame:
    """(graph_id, node, def_id, var, def_node) for every def in IN(node).

    Equal graphs (``same_graphs``) are solved once; the facts of the one that
    stands for them are handed to all.  Rounds and their rows so depend on
    different graphs only.

    Semi-naive: a def enters the successors of its node; it passes a node
    unless that node kills it (defines the same var elsewhere); facts already
    known are dropped (left_anti), so the loop ends when no new fact appears.
    """
    shapes = _cut(same_graphs(edges, defs))
    reps = shapes.select(F.col("rep").alias(G)).distinct()
    # loop invariants are materialised once, not recomputed every round
    e = _cut(edges.select(G, "src", "dst").join(reps, G, "left_semi"))
    d = _cut(defs.select(G, F.col("node").alias("def_node"), "var", "def_id").join(reps, G, "left_semi"))
    killers = d.select(G, F.col("def_node").alias("node"), "var")
    frontier = _cut(d.join(e.withColumnRenamed("src", "def_node"), [G, "def_node"])
                    .select(G, F.col("dst").alias("node"), "def_id", "var", "def_node").distinct())
    seen = frontier
    rnd = 0
    # every round adds facts that were not known; there are finitely many
    while not frontier.isEmpty():
        passing = frontier.join(killers, [G, "node", "var"], "left_anti") \
            .unionByName(frontier.filter(F.col("node") == F.col("def_node")))  # its own def node regenerates it
        nxt = passing.join(e.withColumnRenamed("src", "node"), [G, "node"]) \
            .select(G, F.col("dst").alias("node"), "def_id", "var", "def_node").distinct()
        new = _cut(nxt.join(seen, [G, "node", "def_id"], "left_anti"))
        # the new facts are materialised every round; the accumulated set only every few rounds
        seen = seen.unionByName(new)
        if rnd % SEEN_CUT_EVERY == SEEN_CUT_EVERY - 1:
            seen = _cut(seen)
        frontier, rnd = new, rnd + 1
    return shapes.join(seen.withColumnRenamed(G, "rep"), "rep").select(*seen.columns)


def def_use_chains(reach: DataFrame, uses: DataFrame) -> DataFrame:
    """(graph_id, def_node, use_node, var) for defs reaching a use of their var."""
    return uses.select(G, F.col("node"), "var").join(reach, [G, "node", "var"]).select(
        G, "def_node", F.col("node").alias("use_node"), "var", "def_id")


def parameter_defs(params: DataFrame) -> DataFrame:
    """params(graph_id, var) as definitions at ENTRY (never null)."""
    return params.select(G, F.lit(ENTRY).alias("node"), "var", F.concat(F.lit(ENTRY + ":"), "var").alias("def_id"),
                         F.lit(False).alias("is_null"))


def _reach_from(starts: DataFrame, edges: DataFrame, nodes: DataFrame, blocked: DataFrame | None = None,
                without: DataFrame | None = None) -> DataFrame:
    """BFS of all (graph, var, start) at once, carrying the shortest path (of
    equal ones the smallest by node ids).

    starts(graph_id, var, start, node) with node = start; ``blocked(graph_id,
    var, node)`` nodes are reached but not expanded; ``without(graph_id, var,
    src, dst)`` edges do not exist for that var.  Returns (graph_id, var,
    start, node, path of node ids)."""
    key = [G, "var", "start", "node"]
    ids = nodes.select(G, F.col("node").alias("dst"), "node_id")
    e = _cut(edges.select(G, F.col("src").alias("node"), "dst").join(ids, [G, "dst"]))
    blocked = None if blocked is None else _cut(blocked.select(G, "var", "node").distinct())
    without = None if without is None else _cut(without.select(G, "var", F.col("src").alias("node"), "dst").distinct())
    own = nodes.select(G, "node", "node_id")
    frontier = _cut(starts.select(*key).join(own, [G, "node"]).select(*key, F.array("node_id").alias("path")))
    seen, rnd = frontier, 0
    # every round adds nodes that were not reached; there are finitely many
    while not frontier.isEmpty():
        expand = frontier if blocked is None else frontier.join(blocked, [G, "var", "node"], "left_anti")
        nxt = expand.join(e, [G, "node"])
        if without is not None:
            nxt = nxt.join(without, [G, "var", "node", "dst"], "left_anti")
        nxt = nxt.select(G, "var", "start", F.col("dst").alias("node"), F.concat("path", F.array("node_id")).alias("path"))
        best = nxt.groupBy(*key).agg(F.min("path").alias("path"))
        new = _cut(best.join(seen, key, "left_anti"))
        # the new facts are materialised every round; the accumulated set only every few rounds
        seen = seen.unionByName(new)
        if rnd % SEEN_CUT_EVERY == SEEN_CUT_EVERY - 1:
            seen = _cut(seen)
        frontier, rnd = new, rnd + 1
    return seen


def leak_paths(edges: DataFrame, nodes: DataFrame, resources: DataFrame, closes: DataFrame, escapes: DataFrame) -> DataFrame:
    """G5 + G7: resource definitions from which EXIT is reachable through nodes
    that neither close nor let escape the resource (the definition's own node
    included), with the witness path (shortest, then smallest node ids)."""
    barrier = closes.select(G, "var", "node").unionByName(escapes.select(G, "var", "node")).distinct()
    starts = resources.select(G, "var", F.col("node").alias("start"), "node").join(barrier, [G, "var", "node"], "left_anti")
    r = _reach_from(starts, edges, nodes, blocked=barrier)
    return r.filter(F.col("node") == EXIT).select(G, "var", F.col("start").alias("def_node"), "path")


def unguarded_null_uses(edges: DataFrame, nodes: DataFrame, defs: DataFrame, uses: DataFrame, guards: DataFrame,
                        reach: DataFrame) -> DataFrame:
    """One row per (graph, use node, var) when some null def of var both
    reaches the use (G3) and has a path to it without a guarding edge for var
    (the two may be different paths; def node = use node counts)."""
    starts = defs.filter("is_null").select(G, "var", F.col("node").alias("start"), "node")
    r = _reach_from(starts, edges, nodes, without=guards).select(G, "var", "start", "node")
    cand = uses.select(G, "node", "var").join(r, [G, "node", "var"])
    ok = cand.join(reach.select(G, "node", "var", F.col("def_node").alias("start")), [G, "node", "var", "start"],
                   "left_semi")
    return ok.select(G, "node", "var").distinct()


def witness_steps(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds steps array<struct<file, line, description>> of each path."""
    at = paths.select(*[c for c in paths.columns], F.posexplode("path").alias("at", "node_id"))
    keys = [c for c in paths.columns if c != "path"]
    named = at.join(nodes.select(G, "node_id", "file", "line", "label"), [G, "node_id"])
    steps = named.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "file", "line", F.col("label").alias("description")))).alias("_s"))
    return steps.select(*keys, F.transform("_s", lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), x["description"].alias("description"))).alias("steps"))
