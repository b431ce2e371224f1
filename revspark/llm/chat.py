"""Chat formatting of reply trees (operator 1), in DataFrame functions only.

Messages form reply trees.  Iterative self-joins by pointer doubling (each
round joins the table of 2**k-th ancestors with itself) enumerate the path
from every leaf to its root in a logarithmic number of rounds; branches are
ranked by the sum of their messages' scores, and each chosen path becomes one
formatted conversation with a loss mask over the assistant texts.

Template, turn by turn: START role NEWLINE text END NEWLINE.  Control strings
inside roles and texts are broken by an escape that unescape() takes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from revspark.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that common chat templates treat as control (fixed values).
CONTROL = (START, END, "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
           "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESC = "␛"
TRAINED_ROLE = "assistant"


def escape(x: Column) -> Column:
    """No control string and no bare ESC is left; unescape() gives x back."""
    x = F.replace(x, F.lit(ESC), F.lit(ESC + "0"))
    for c in CONTROL:
        x = F.replace(x, F.lit(c), F.lit(c[0] + ESC + "1" + c[1:]))
    return x


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit(ESC + "1"), F.lit("")), F.lit(ESC + "0"), F.lit(ESC))


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit(ESC + "2"))


def unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit(ESC + "2"), F.lit("\n")))


def ancestors(messages: DataFrame) -> list[DataFrame]:
    """Tables (conv_id, msg_id, to, sum): the message 1, 2, 4, ... replies above each, and the scores from it up to there.

    messages: conv_id, msg_id (unique in its conversation), parent_id, score.
    A message whose parent is null or absent is a root.  Messages on a reply
    cycle raise an error.  The last table is empty."""
    keys = messages.select("conv_id", "msg_id", "parent_id", "score")
    known = keys.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("p"))
    ups = [stored(
        keys.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent_id") == F.col("p")), "left_semi")
        .select("conv_id", "msg_id", F.col("parent_id").alias("to"), F.col("score").alias("sum")), "ancestors")]
    n, rounds = keys.count(), 0
    while not ups[-1].isEmpty():
        if 2**rounds > n:
            raise ValueError("the messages hold a reply cycle")
        a, b = ups[-1].alias("a"), ups[-1].alias("b")
        same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.to") == F.col("b.msg_id"))
        ups.append(stored(a.join(b, same).select("a.conv_id", "a.msg_id", "b.to", (F.col("a.sum") + F.col("b.sum")).alias("sum")), "ancestors"))
        rounds += 1
    return ups


def leaf_scores(messages: DataFrame, ups: list[DataFrame]) -> DataFrame:
    """(conv_id, leaf, score, depth): the sum over each leaf's path and the number of replies above the leaf.

    One row per leaf throughout: the steps up take the largest jump first."""
    own = messages.select("conv_id", "msg_id", "score")
    parents = ups[0].select(F.col("conv_id").alias("c"), F.col("to").alias("p"))
    leaves = own.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg_id") == F.col("p")), "left_anti")
    rows = leaves.select("conv_id", F.col("msg_id").alias("leaf"), F.col("msg_id").alias("at"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("depth"))
    for k in reversed(range(len(ups) - 1)):
        step = ups[k].select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), "to", "sum")
        met = rows.join(step, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("m")), "left")
        rows = met.select("conv_id", "leaf", F.coalesce("to", "at").alias("at"), (F.col("score") + F.coalesce("sum", F.lit(0.0))).alias("score"),
                          (F.col("depth") + F.when(F.col("to").isNotNull(), 2**k).otherwise(0)).alias("depth"))
    root = own.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), F.col("score").alias("root_score"))
    met = rows.join(root, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("m")))
    return stored(met.select("conv_id", "leaf", (F.col("score") + F.col("root_score")).alias("score"), "depth"), "leaf-scores")


def leaf_paths(leaves: DataFrame, ups: list[DataFrame]) -> DataFrame:
    """(conv_id, leaf, up, msg_id): msg_id is ``up`` replies above ``leaf``, for every message above the given leaves."""
    paths = leaves.select("conv_id", "leaf", F.lit(0).cast("long").alias("up"), F.col("leaf").alias("msg_id"))
    for k in reversed(range(len(ups) - 1)):
        step = ups[k].select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), "to")
        above = paths.join(step, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg_id") == F.col("m")))
        paths = stored(paths.unionByName(above.select("conv_id", "leaf", (F.col("up") + 2**k).alias("up"), F.col("to").alias("msg_id"))), "paths")
    return paths


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` branches of each conversation, formatted.

    messages: conv_id, msg_id, parent_id, role, text, score.  Returns conv_id,
    branch (1 = best), leaf, score, formatted, loss array<struct<start,end>>
    (code points of the escaped assistant texts in formatted).  A branch's
    score is the sum of its messages' scores, null counting 0; ties go to the
    longer, then to the smaller leaf.  Null roles and texts count as empty.
    An empty table gives an empty result; other columns are never read."""
    rows = stored(messages.select("conv_id", "msg_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"),
                                  F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    # all leaves are ranked by their sums; only the chosen ones are expanded to messages
    ups = ancestors(rows)
    ranked = (leaf_scores(rows, ups)
              .withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("score").desc(), F.col("depth").desc(), "leaf")))
              .filter(F.col("branch") <= branches))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg_id") == F.col("m"))
    paths = leaf_paths(ranked, ups)
    chosen = ranked.select(F.col("conv_id").alias("rc"), F.col("leaf").alias("rl"), "score", "branch", "depth")
    turns = paths.join(chosen, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("leaf") == F.col("rl")))
    texts = rows.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    turns = turns.join(texts, on).select("conv_id", "branch", "leaf", "score", (F.col("depth") - F.col("up")).alias("at"), "role", "text")
    piece = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    order = Window.partitionBy("conv_id", "branch", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("piece", piece).withColumn("stop", F.sum(F.length("piece")).over(order) - len(END) - 1)
    span = F.struct((F.col("stop") - F.length("text")).alias("start"), F.col("stop").alias("end"))
    one = (turns.groupBy("conv_id", "branch", "leaf")
           .agg(F.first("score").alias("score"), F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
                F.sort_array(F.collect_list(F.when(F.col("role") == TRAINED_ROLE, span))).alias("loss")))
    return one.select("conv_id", "branch", "leaf", "score", F.array_join("pieces.piece", "").alias("formatted"), "loss")


def linear(conversations: DataFrame) -> DataFrame:
    """Messages of conversations given turn by turn: each turn replies to the one before.

    Turns are ordered by turn (null first), then role and text, so repeated
    rows and ties each keep a place of their own.  Every message scores 1."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    numbered = rows.withColumn("msg_id", at)
    return numbered.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns array<struct<role,text>> (unescaped) and loss_text, both parsed from formatted and loss."""
    pieces = F.filter(F.split("formatted", F.lit(START.replace("|", "\\|")), -1), lambda p: p != "")
    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))
    masked = F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(masked, ""))
