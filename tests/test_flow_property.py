"""Property test: semi-naive reaching definitions equal a worklist fixpoint."""
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from revspark.operators import flow as FL
from revspark.sources import event_flow as EF

NODES = ["ENTRY", "EXIT", "click", "error", "purchase", "signup", "view"]


def worklist(edges):
    defs = {n: (v, f"{n}:{v}") for n, v, _ in EF.DEFS}
    nodes = {x for e in edges for x in e}
    preds = {n: {s for s, d in edges if d == n} for n in nodes}
    gen = {n: ({defs[n][1]} if n in defs else set()) for n in nodes}
    by_var = {}
    for n, (v, d) in defs.items():
        by_var.setdefault(v, set()).add(d)
    kill = {n: (by_var[defs[n][0]] - gen[n] if n in defs else set()) for n in nodes}
    IN = {n: set() for n in nodes}
    OUT = {n: set(gen[n]) for n in nodes}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            i = set().union(*[OUT[p] for p in preds[n]]) if preds[n] else set()
            o = gen[n] | (i - kill[n])
            if i != IN[n] or o != OUT[n]:
                IN[n], OUT[n], changed = i, o, True
    return {(n, d) for n in nodes for d in IN[n] if d.split(":")[0] in nodes}


graphs = st.lists(st.lists(st.tuples(st.sampled_from(NODES[:1] + NODES[2:]), st.sampled_from(NODES[1:])),
                           min_size=1, max_size=12), min_size=1, max_size=3)


@settings(max_examples=8, deadline=None)
@given(gs=graphs)
def test_reaching_defs_match_worklist(spark, gs):
    rows = [(g, s, d) for g, es in enumerate(gs) for s, d in set(es)]
    edges = spark.createDataFrame(rows, "graph_id long, src string, dst string") \
        .withColumn("edge_type", F.lit("UNCONDITIONAL"))
    defs = EF.flow_defs(EF.flow_nodes(edges))
    got = {(r.graph_id, r.node, r.def_id) for r in FL.reaching_definitions(edges, defs).collect()}
    exp = {(g, n, d) for g, es in enumerate(gs) for n, d in worklist(set(es))}
    assert got == exp


def brute_witness(edges):
    """Enumerate every simple path signup -> EXIT avoiding close/escape nodes;
    keep the shortest, then the smallest by node ids."""
    if not any(s == EF.RESOURCE_DEF for s, _ in edges):
        return None
    barrier = {EF.CLOSE_NODE, EF.ESCAPE_NODE}
    succ = {}
    for s, d in edges:
        succ.setdefault(s, set()).add(d)
    best = None
    stack = [[EF.RESOURCE_DEF]]
    while stack:
        p = stack.pop()
        n = p[-1]
        if n == "EXIT":
            key = (len(p), [EF.NODE_IDS[x] for x in p])
            best = key if best is None or key < best else best
            continue
        if n in barrier:
            continue
        for d in succ.get(n, ()):
            if d not in p:
                stack.append(p + [d])
    return best[1] if best else None


@settings(max_examples=8, deadline=None)
@given(gs=graphs)
def test_leak_witness_matches_brute_force(spark, gs):
    rows = [(g, s, d) for g, es in enumerate(gs) for s, d in set(es)]
    edges = spark.createDataFrame(rows, "graph_id long, src string, dst string") \
        .withColumn("edge_type", F.lit("UNCONDITIONAL"))
    nodes = EF.flow_nodes(edges)
    marks = [EF.flow_marks(nodes, n) for n in (EF.RESOURCE_DEF, EF.CLOSE_NODE, EF.ESCAPE_NODE)]
    got = {r.graph_id: list(r.path) for r in FL.leak_paths(edges, nodes, *marks).collect()}
    exp = {g: w for g, es in enumerate(gs) if (w := brute_witness(set(es))) is not None}
    assert got == exp


def test_leaks_and_null_uses_on_named_tables(spark):
    """A graph with node names, lines and two variables of its own."""
    e = [("ENTRY", "open"), ("open", "check"), ("check", "read"), ("check", "skip"), ("read", "shut"), ("shut", "EXIT"), ("skip", "EXIT"), ("read", "peek"), ("peek", "EXIT")]
    edges = spark.createDataFrame([(7, s, d) for s, d in e], "graph_id long, src string, dst string")
    names = ["ENTRY", "open", "check", "read", "skip", "shut", "peek", "EXIT"]
    nodes = spark.createDataFrame([(7, n, 10 * k, "A.java", k, f"step {n}") for k, n in enumerate(names)],
                                  "graph_id long, node string, node_id int, file string, line int, label string")
    mark = lambda *rows: spark.createDataFrame([(7, n, v) for n, v in rows], "graph_id long, node string, var string")
    # f is shut on one branch only; g escapes everywhere
    leaks = FL.leak_paths(edges, nodes, mark(("open", "f"), ("check", "g")), mark(("shut", "f")), mark(("read", "g"), ("skip", "g")))
    got = FL.witness_steps(leaks, nodes).collect()
    assert [(r.var, [(s.line, s.description) for s in r.steps]) for r in got] == [
        ("f", [(1, "step open"), (2, "step check"), (4, "step skip"), (7, "step EXIT")])]
    params = FL.parameter_defs(spark.createDataFrame([(7, "p")], "graph_id long, var string"))
    defs = params.unionByName(spark.createDataFrame([(7, "open", "x", "open:x", True), (7, "shut", "x", "shut:x", False)],
                                                    "graph_id long, node string, var string, def_id string, is_null boolean"))
    reach = FL.reaching_definitions(edges, defs)
    assert {r.node for r in reach.filter("var = 'p'").collect()} == set(names) - {"ENTRY"}
    uses = mark(("read", "x"), ("skip", "x"), ("peek", "x"))
    guards = spark.createDataFrame([(7, "check", "skip", "x")], "graph_id long, src string, dst string, var string")
    out = FL.unguarded_null_uses(edges, nodes, defs, uses, guards, reach).collect()
    assert {r.node for r in out} == {"read", "peek"}


def test_equal_graphs_are_solved_once_and_for_all(spark):
    """Copies of a graph, one with another edge and one with another definition: the copies share a representative."""
    from pyspark.sql import functions as F

    edges, defs = [], []
    for g in range(12):
        edges += [(g, a, b) for a, b in (("ENTRY", "a"), ("a", "b"), ("b", "a"), ("b", "EXIT"))] + ([(g, "a", "EXIT")] if g == 7 else [])
        defs += [(g, "a", "x", "d1"), (g, "b", "y" if g == 9 else "x", "d2")]
    e = spark.createDataFrame(edges, "graph_id long, src string, dst string").withColumn("edge_type", F.lit("UNCONDITIONAL")).repartition(5)
    d = spark.createDataFrame(defs, "graph_id long, node string, var string, def_id string").repartition(3)
    reps = {r.graph_id: r.rep for r in FL.same_graphs(e, d).collect()}
    assert reps == {g: g if g in (7, 9) else 0 for g in range(12)}
    facts = {}
    for r in FL.reaching_definitions(e, d).collect():
        facts.setdefault(r.graph_id, set()).add((r.node, r.def_id))
    assert set(facts) == set(range(12)) and all(facts[g] == facts[0] for g in range(12) if g not in (7, 9))
    assert facts[7] != facts[0] and ("EXIT", "d1") in facts[9] and ("EXIT", "d1") not in facts[0]
