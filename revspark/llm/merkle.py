"""Merkle manifest of a dataset (operator 13), in DataFrame functions only.

Nodes are lowercase hex SHA-256 strings.  The rows of a group stand in a fixed
order; every FAN consecutive nodes (the last run may be shorter, even one)
become one parent, until one node is left: the group's subroot.  The subroots,
ordered by group, give the root in the same way.

A block is an aligned stretch of BLOCK = FAN ** LEVELS nodes, gathered into one
row.  It keeps each of its levels as one concatenated hex string (its ASCII
bytes, so that a substring is found by its offset): parents are the hashes of
the level's fixed-width substrings, and a node's siblings are the two
substrings that flank it in its run.  The blocks' top nodes are the next
round's nodes, so a group of any size is log(rows) rounds of rows that never
grow beyond BLOCK nodes.  On the way back each block hands the siblings above
it to its nodes; every join there is between unique keys on both sides, so a
group with a third of all rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revspark.llm.common import stored

FAN = 8
LEVELS = 3
BLOCK = FAN**LEVELS
#: Characters of a node.
WIDTH = 64
_SIDES = "array<struct<l:binary,r:binary>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column | str) -> Column:
    """A value's part of a leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column | str) -> Column:
    """The leaf of a row: the hash of its values' parts."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def lower_ascii(text: Column | str) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def fold(node: Column, sides: Column) -> Column:
    """The root that follows from a node and its siblings (left and right of it, level by level)."""
    return F.aggregate(sides, node, lambda h, s: F.sha2(F.concat(s["l"], h.cast("binary"), s["r"]), 256))


def proof_sha256(sides: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.aggregate(sides, F.lit("").cast("binary"), lambda a, s: F.concat(a, s["l"], s["r"])), 256)


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos`` (from 0) and ``n``: a row's place in its ``grp`` and the group's size.

    Rows are range partitioned and sorted; a row's place is its place in the
    partition and group plus the group's rows in earlier partitions.  Only
    counts, one per (partition, group), are added up in a window: no more per
    group than there are partitions."""
    sorted_rows = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    placed = stored(sorted_rows.withColumns({"pid": F.spark_partition_id(), "mid": F.monotonically_increasing_id()}), "merkle-sorted")
    here = placed.groupBy("grp", "pid").agg(F.count("*").alias("here"), F.min("mid").alias("first"))
    group = Window.partitionBy("grp")
    before = F.sum("here").over(group.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    counts = here.select("grp", "pid", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(group).alias("n"))
    return placed.join(counts, ["grp", "pid"]).withColumn("pos", F.col("mid") + F.col("shift")).drop("pid", "mid", "shift")


def _text(nodes: Column) -> Column:
    return F.array_join(nodes, "").cast("binary")


def _count(level: Column) -> Column:
    return (F.octet_length(level) / WIDTH).cast("int")


def _parents(level: Column) -> Column:
    """The next level: the hashes of the level's substrings of FAN nodes."""
    runs = F.sequence(F.lit(0), F.ceil(_count(level) / FAN).cast("int") - 1)
    return _text(F.transform(runs, lambda i: F.sha2(F.substring(level, i * (FAN * WIDTH) + 1, F.lit(FAN * WIDTH)), 256)))


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """One row per block of ``nodes`` (grp, pos, n, node, payload): grp, block, n, items, l0 .. lLEVELS.

    A group of several blocks is hashed up through all levels of each; a group
    of one block until one node is left, so a level may equal the one below."""
    at = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
    rows = at.groupBy("grp", "block").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node", *payload))).alias("items"))
    rows = rows.withColumn("l0", _text(F.transform("items", lambda x: x["node"])))
    for k in range(LEVELS):
        own = F.col(f"l{k}")
        rows = rows.withColumn(f"l{k + 1}", F.when((F.col("n") > BLOCK) | (_count(own) > 1), _parents(own)).otherwise(own))
    keep = F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in payload])) if payload else F.lit(None)
    return rows.select("grp", "block", "n", keep.alias("items"), *[f"l{k}" for k in range(LEVELS + 1)])


def _sides(i: Column) -> Column:
    """The siblings of the block's node ``i``, level by level; none for a level that was not hashed."""
    out = []
    for k in range(LEVELS):
        level = F.col(f"l{k}")
        at = F.floor(i / FAN**k).cast("int")
        run = at - at % FAN
        pair = F.struct(
            F.substring(level, run * WIDTH + 1, (at - run) * WIDTH).alias("l"),
            F.substring(level, (at + 1) * WIDTH + 1, (run + FAN - 1 - at) * WIDTH).alias("r"))
        hashed = (F.col("n") > BLOCK) | (_count(level) > 1)
        out.append(F.when(hashed, F.array(pair)).otherwise(F.array().cast(_SIDES)))
    return F.concat(*out)


def _expand(blocks: DataFrame, above: DataFrame, payload: list[str]) -> DataFrame:
    """One row per node of the blocks: grp, pos, node, payload, subroot, root, sides up to the root.

    ``above`` has (grp, block, subroot, root, sides) of each block's top."""
    joined = blocks.join(above.withColumnRenamed("sides", "upper"), ["grp", "block"])
    one = F.struct(
        (F.col("block") * BLOCK + F.col("i")).alias("pos"), F.substring(F.col("l0"), F.col("i") * WIDTH + 1, F.lit(WIDTH)).cast("string").alias("node"),
        *[F.col("items")[F.col("i")][c].alias(c) for c in payload], F.concat(_sides(F.col("i")), "upper").alias("sides"))
    return (joined.select("*", F.explode(F.sequence(F.lit(0), _count(F.col("l0")) - 1)).alias("i"))
            .select("grp", "subroot", "root", one.alias("x")).select("grp", "subroot", "root", "x.*"))


def _rounds(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """The block tables from the rows up to one block per group."""
    out = []
    while True:
        out.append(stored(_blocks(nodes, payload if not out else []), f"merkle-{len(out)}"))
        n = out[-1].agg(F.max("n")).first()[0] or 0
        if n <= BLOCK:
            return out
        nodes = out[-1].select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col(f"l{LEVELS}").cast("string").alias("node"))


def _top(rounds: list[DataFrame]) -> DataFrame:
    return rounds[-1].select("grp", "block", "n", F.col(f"l{LEVELS}").cast("string").alias("node"))


def tree(rows: DataFrame, group: Column, order: list[str], payload: list[str]) -> DataFrame:
    """One row per row: payload, pos, node, subroot, root, sides.

    ``rows`` needs a column ``node`` (its leaf).  Groups are ordered as strings,
    a null group first; inside a group rows go by ``order``, nulls first, then
    by leaf.  Rows equal in all of that are dealt out by their place in the
    input, so no partition has to hold all copies; which of them comes first
    does not change the result.  An empty table gives an empty result."""
    key = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))
    own = stored(rows.select(key.alias("grp"), *payload, "node", *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.monotonically_increasing_id().alias("copy")), "merkle-leaves")
    leaves = _positions(own, [f"o{k}" for k in range(len(order))] + ["node", "copy"])
    rounds = _rounds(leaves, payload)
    tops = _top(rounds).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node")
    group_rounds = _rounds(_positions(tops, ["name"]), ["name"])
    top = _top(group_rounds).select("grp", "block", F.col("node").alias("subroot"), F.col("node").alias("root"), F.array().cast(_SIDES).alias("sides"))

    def down(tables: list[DataFrame], above: DataFrame, last: list[str]) -> DataFrame:
        for k, table in enumerate(reversed(tables)):
            names = last if k == len(tables) - 1 else []
            above = _expand(table, above, names)
            if k < len(tables) - 1:
                above = above.select("grp", F.col("pos").alias("block"), "subroot", "root", "sides")
        return above

    groups = down(group_rounds, top, ["name"])
    start = groups.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("block"), F.col("node").alias("subroot"), "root", "sides")
    return down(rounds, start, payload).drop("grp")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, sides (the inclusion proof) and tampered_leaf.

    A leaf is the hash of doc_id, source, lang, n_chars and text; the groups
    are the languages, a null one being a group of its own.  Where ``tampered``
    holds, tampered_leaf is the leaf of the row with A-Z of its text in lower
    case; elsewhere it is null.  Null ids come first; repeated rows and ids are
    leaves like any other; extra columns are never read."""
    values = ["doc_id", "source", "lang", "n_chars"]
    hit = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    rows = docs.select("doc_id", "lang", leaf(*values, "text").alias("node"), F.when(hit, leaf(*values, lower_ascii("text"))).alias("tampered_leaf"))
    return tree(rows, F.col("lang"), ["doc_id"], ["doc_id", "tampered_leaf"]).withColumnRenamed("node", "leaf")


def verify(manifest_df: DataFrame) -> DataFrame:
    """Adds proof_sha256, folded_root (from the tampered leaf if there is one) and verified."""
    folded = fold(F.coalesce("tampered_leaf", "leaf"), F.col("sides"))
    out = manifest_df.withColumns({"proof_sha256": proof_sha256(F.col("sides")), "folded_root": folded})
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
