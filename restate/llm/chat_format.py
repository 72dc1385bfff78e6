"""Reply trees to conversations: native DataFrame operations only.

Messages form trees by parent links.  Paths from a root to a leaf are found with
self-joins that double their reach: after k joins every message knows its 2^k-th
ancestor, so a chain of n messages takes log2(n) joins.  Branches are ranked by
the sum of their messages' scores, the best ones are chosen for each root, and
only the chosen leaves are expanded back into all their ancestors, by the same
jump tables from the longest jump to the shortest.

Template of one turn::

    ### <role>:\\n<escaped text>\\n</turn>\\n

In a text every backslash, ``#`` and ``<`` gets a backslash before it, so neither
a header nor ``\\n</turn>`` can occur inside one, and dropping that backslash
restores the text.  Roles are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restate.llm.common import store

TURN_END = "\n</turn>\n"
ESCAPED = r"([\\#<])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame, paths_per_tree: int = 1) -> DataFrame:
    """Chosen root-to-leaf paths, a row per message: path (the leaf's node), tree, node, depth, path_score, path_rank.

    ``messages`` has tree, node, parent, score; (tree, node) names a message and
    may not be null.  A parent that is null or absent makes a root.  A null score
    counts 0.  Ties between branches go to the smaller leaf node.  Of messages
    with one (tree, node) one is kept: callers number repeated rows apart.
    Messages whose parent links form a cycle have no root and give no path.
    """
    base = messages.select("tree", "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"))
    base = base.dropDuplicates(["tree", "node"])
    known = base.select(F.col("tree").alias("k_tree"), F.col("node").alias("k_node"))
    jump = base.join(known, (F.col("tree") == F.col("k_tree")) & (F.col("parent") == F.col("k_node")), "left").select(
        "tree", "node", F.col("k_node").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"))
    jump = store(jump, "reply-jump")
    tables, rounds = [jump], max(1, jump.count()).bit_length() + 1
    for _ in range(rounds):
        if not jump.where(F.col("up").isNotNull()).take(1):
            break
        far = jump.select(F.col("tree").alias("f_tree"), F.col("node").alias("f_node"), F.col("up").alias("f_up"),
                          F.col("steps").alias("f_steps"), F.col("total").alias("f_total"))
        # messages that have reached their root are through: only the others are joined
        moved = jump.where(F.col("up").isNotNull()).join(far, (F.col("tree") == F.col("f_tree")) & (F.col("up") == F.col("f_node"))).select(
            "tree", "node", F.col("f_up").alias("up"), (F.col("steps") + F.col("f_steps")).alias("steps"),
            (F.col("total") + F.col("f_total")).alias("total"))
        jump = store(jump.where(F.col("up").isNull()).unionByName(moved), "reply-jump")
        tables.append(jump)
    # `up` is null for all now (but in cycles): steps is the depth, total the score of the whole path
    done = jump.where(F.col("up").isNull()).select("tree", "node", "steps", "total")
    inner = tables[0].where(F.col("up").isNotNull()).select(F.col("tree").alias("i_tree"), F.col("up").alias("i_node")).distinct()
    leaves = done.join(inner, (F.col("tree") == F.col("i_tree")) & (F.col("node") == F.col("i_node")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = leaves.withColumn("path_rank", F.row_number().over(best)).where(F.col("path_rank") <= paths_per_tree)
    on_path = chosen.select("tree", F.col("node").alias("path"), "node", F.col("total").alias("path_score"), "path_rank")
    for t in reversed(tables[:-1]):
        up = t.where(F.col("up").isNotNull()).select(F.col("tree").alias("u_tree"), F.col("node").alias("u_node"), "up")
        found = on_path.join(up, (F.col("tree") == F.col("u_tree")) & (F.col("node") == F.col("u_node"))).select(
            "tree", "path", F.col("up").alias("node"), "path_score", "path_rank")
        on_path = store(on_path.unionByName(found), "reply-path")
    depth = done.select(F.col("tree").alias("d_tree"), F.col("node").alias("d_node"), F.col("steps").alias("depth"))
    return on_path.join(depth, (F.col("tree") == F.col("d_tree")) & (F.col("node") == F.col("d_node"))).select(
        "tree", "path", "node", "depth", "path_score", "path_rank")


def format_paths(messages: DataFrame, paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per path: tree, path, formatted, loss_spans.

    ``messages`` has tree, node, role, text (null role or text: empty).
    ``loss_spans`` are the (start, end) code points of the ``loss_role`` texts in
    ``formatted``.  A path is one conversation and so one row of text.
    """
    m = messages.select(F.col("tree").alias("m_tree"), F.col("node").alias("m_node"),
                        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    m = m.dropDuplicates(["m_tree", "m_node"])
    head = F.concat(F.lit("### "), F.url_encode("role"), F.lit(":\n"))
    turns = paths.join(m, (F.col("tree") == F.col("m_tree")) & (F.col("node") == F.col("m_node"))).select(
        "tree", "path", "depth", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(TURN_END)))
    before = Window.partitionBy("tree", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == loss_role, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    rows = turns.groupBy("tree", "path").agg(F.sort_array(F.collect_list(F.struct("depth", "turn", span.alias("span")))).alias("t"))
    return rows.select(
        "tree", "path", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text recovered from ``formatted`` alone: adds turns (role, text) and loss_text."""
    parts = F.split(F.col("formatted"), r"\n</turn>\n")
    turn = r"(?s)^### ([^\n]*):\n(.*)$"
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.struct(
        F.url_decode(F.regexp_extract(x, turn, 1)).alias("role"), unescape(F.regexp_extract(x, turn, 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})


def chains(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Messages of plain conversations: each row replies to the row before it, by turn.

    Rows with one turn follow by role, then text; repeated rows are turns of
    their own; null turns come first; null ids form one conversation.
    """
    key = F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("null"))
    order = Window.partitionBy("tree").orderBy("c_turn", "role", "text")
    m = rows.select(key.alias("tree"), F.col(conv_col).alias("c_id"), F.col(turn_col).alias("c_turn"),
                    F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    m = m.withColumn("node", F.row_number().over(order).cast("long"))
    return m.select("tree", "c_id", "node", (F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
