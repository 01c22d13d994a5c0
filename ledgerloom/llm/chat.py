"""Chat formatting of reply trees: self-joins enumerate root-to-leaf paths, scores rank the branches, each chosen path is one conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """A text without `<|`: backslashes doubled, then `<|` written `<\\|`."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Inverse of escape: between `<` and `|` an escaped text has an odd number of backslashes only where `<|` stood."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\^"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\^"), F.lit("\n")))


def paths(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The leaves of reply trees (tree, leaf, depth, path_score) and the pointers (tree, node, up, dist) to the ancestors 1, 2, 4, ... steps up;
    tree is a struct around the tree's id.

    messages: tree, node, parent (null at a root), score. Pointer doubling: in each round a message learns its ancestor
    twice as far up with the scores between, so a thread of any length takes logarithmically many self-joins; rounds end
    when all have met their root, so rows whose parent is missing count as roots, and rings of parents, which have no
    root, are left out. A null tree is a tree like any other (trees travel as structs, which join null to null); rows without a
    node are no messages; of rows that repeat a node the least parent counts, null first, with the least score.
    """
    one = F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("r")
    nodes = messages.where("node IS NOT NULL").groupBy(F.struct("tree").alias("tree"), "node").agg(one).select("tree", "node", "r.*")
    known = nodes.select("tree", F.col("node").alias("up"), F.lit(True).alias("_ll_is"))
    start = nodes.withColumnRenamed("parent", "up").join(known, ["tree", "up"], "left")
    # up: an ancestor, null once the root is met; dist: steps to it; total: scores from the node up to but without it
    hop = stage(start.select("tree", "node", F.when(F.col("_ll_is"), F.col("up")).alias("up"), F.lit(1).cast("long").alias("dist"), F.col("score").alias("total")))
    hops, steps = [hop], 0
    at = stage(hop.select("tree", "node", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("total").alias("path_score")))
    limit = max(1, hop.count()).bit_length() + 1
    while steps < limit and hops[-1].where("up IS NOT NULL").limit(1).count():
        h = hops[-1].where("up IS NOT NULL")
        o = hops[-1].select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"))
        hops.append(stage(h.join(o, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("dist") * 2).alias("dist"), (F.col("total") + F.col("total2")).alias("total"))))
        a = at.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("path_score").alias("s2"))
        open_, done = at.where("up IS NOT NULL"), at.where("up IS NULL")
        at = stage(done.unionByName(open_.join(a, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("path_score") + F.col("s2")).alias("path_score"))))
        steps += 1
    rooted = at.where("up IS NULL").select("tree", "node", "depth", "path_score")
    inner = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "path_score", "depth")
    return leaves, hops


def best_branches(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, node): the messages on the per_tree best paths of each tree.

    Branches are ranked by the mean score of their messages, then by length, longest first, then by the smallest leaf. No
    messages give no branches; other columns do not matter.
    """
    leaves, hops = paths(messages)
    rank = Window.partitionBy("tree").orderBy(F.desc(F.col("path_score") / (F.col("depth") + 1)), F.desc("depth"), "leaf")
    chosen = leaves.withColumn("_ll_rank", F.row_number().over(rank)).where(F.col("_ll_rank") <= per_tree)
    on = chosen.select("tree", "leaf", F.col("leaf").alias("node"))
    for h in reversed(hops):  # distances to ancestors are sums of powers of two, each used once
        up = on.join(h.where("up IS NOT NULL").select("tree", "node", "up"), ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"))
        on = stage(on.unionByName(up))
    return on.select("tree.tree", "leaf", "node")


def format_paths(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """One formatted conversation per chosen path: tree, leaf, formatted.

    A turn is `<|im_start|>role\\ntext<|im_end|>\\n` with control strings inside roles and texts escaped; turns stand in the
    order of their place (column `place`), then of node, null roles and texts count as empty. A null tree is a tree of its own;
    a row that repeats the node before it in that order is left out. Other columns of messages do not matter.
    """
    turn = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"), escape(F.coalesce("text", F.lit(""))), F.lit(END + "\n"))
    tree = F.struct("tree").alias("tree")
    rows = chosen.select(tree, "leaf", "node").join(messages.select(tree, "node", "place", turn.alias("turn")), ["tree", "node"])
    out = rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("place", "node", "turn"))).alias("turns"))
    new = F.filter("turns", lambda x, i: (i == 0) | (F.get(F.col("turns"), i - 1)["node"] != x["node"]))
    return out.select("tree.tree", "leaf", F.array_join(F.transform(new, lambda x: x["turn"]), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.array_remove(F.split(formatted, r"<\|im_start\|>", -1), "")  # before the first turn is nothing

    def turn(p: Column) -> Column:
        end = F.call_function("locate", F.lit("\n"), p)
        body = F.substr(p, end + 1, F.char_length(p) - end - len(END) - 1)
        return F.struct(unescape_role(F.substr(p, F.lit(1), end - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def digests(formatted: DataFrame, id_col: str) -> DataFrame:
    """Per conversation, read back from the formatted column: turn and loss digests. The loss mask covers assistant texts.

    One row per row, null ids and equal conversations included; other columns are left out.
    """
    out = formatted.withColumn("_ll_turns", read_turns(F.col("formatted")))
    all_ = F.array_join(F.transform("_ll_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("_ll_turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    out = out.select(id_col, "formatted", F.size("_ll_turns").cast("long").alias("n_turns"), all_.alias("_ll_all"), loss.alias("_ll_loss"))
    return out.select(
        id_col,
        "n_turns",
        F.sha2(F.encode("_ll_all", "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("_ll_loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("_ll_loss", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def thread(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each row answers the one before it.

    Rows are ordered by turn (null first), then role and text, so repeated rows stay, side by side.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    out = conversations.select("conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return out.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), F.col("node").alias("place"), "role", "text")
