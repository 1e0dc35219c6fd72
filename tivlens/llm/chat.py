"""Chat formatting: reply trees become conversations, one per chosen root-to-leaf path.

Paths are found by iterative self-joins that double the distance they cover, so a tree of
depth d takes log2(d) rounds. Branches are ranked by the sum of their turns' scores, the
best ``top_k`` of each tree are formatted, and the spans of the assistant's words are kept
as the loss mask. DataFrame functions only.

Template, for every turn: ``<turn>`` role, line feed, text, ``</turn>``, line feed. Inside
roles and texts a backslash is written ``\\b`` and ``<`` is written ``\\l``; in roles a line
feed is written ``\\e``. A backslash in the output thus always starts one of these pairs,
which makes the escape reversible, and no text can hold a control string.

Defined cases: a null tree is a tree like any other; a null text or role is empty; a turn whose parent does not exist is a root;
turns whose ancestors form a cycle have no root and give no path; repeated node ids within a
tree are not allowed (the nodes made from flat tables are numbered, so never repeat).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tivlens.llm.common import stored

OPEN, CLOSE = "<turn>", "</turn>\n"


def escaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    return F.replace(c, F.lit("<"), F.lit("\\l"))


def unescaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\l"), F.lit("<"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def escaped_role(c: Column) -> Column:
    return F.replace(escaped(c), F.lit("\n"), F.lit("\\e"))


def unescaped_role(c: Column) -> Column:
    return unescaped(F.replace(c, F.lit("\\e"), F.lit("\n")))


def chains(turns: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Flat conversations as trees of one branch: ``tree, node, parent, score, role, text``.

    Rows of one turn number follow each other by role, then text.
    """
    rows = turns.select(F.col(tree).alias("tree"), F.col(order).alias("turn"), F.col(role).alias("role"),
                        F.col(text).alias("text"))
    n = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return rows.select("tree", n.alias("node"), F.when(n > 1, n - 1).alias("parent"),
                       F.lit(0.0).alias("score"), "role", "text")


def paths(nodes: DataFrame) -> DataFrame:
    """``tree, leaf, node, up``: the turns of each root-to-leaf path, ``up`` steps above its leaf."""
    return _paths(_keyed(nodes)).withColumn("tree", F.col("tree.id"))


def _keyed(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the tree as a struct, by which null trees meet too when tables are joined."""
    return nodes.withColumn("tree", F.struct(F.col("tree").isNull().alias("none"), F.col("tree").alias("id")))


def _paths(nodes: DataFrame) -> DataFrame:
    ids = nodes.select("tree", "node")
    jump = nodes.where(F.col("parent").isNotNull()).select("tree", "node", F.col("parent").alias("above"))
    jump = stored(jump.join(ids.withColumnRenamed("node", "above"), ["tree", "above"], "left_semi")
                  .select("tree", "node", "above"), "jump")
    leaves = ids.join(jump.select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti")
    members = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    members, covered, total = stored(members, "members"), 1, ids.count()
    while covered <= total and not jump.isEmpty():
        further = (members.join(jump, ["tree", "node"])
                   .select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + covered).alias("up")))
        members = stored(members.unionByName(further), "members")
        second = jump.select("tree", F.col("node").alias("above"), F.col("above").alias("top"))
        jump = stored(jump.join(second, ["tree", "above"]).select("tree", "node", F.col("top").alias("above")), "jump")
        covered *= 2
    if not jump.isEmpty():  # longer than all turns together: a cycle
        endless = jump.select("tree", F.col("node").alias("leaf"))
        members = members.join(endless, ["tree", "leaf"], "left_anti")
    return members


def format_trees(nodes: DataFrame, top_k: int = 1, learn_role: str = "assistant") -> DataFrame:
    """``tree, leaf, score, rank, n_turns, formatted, loss_spans`` of the best paths of each tree.

    ``loss_spans`` holds (start, length) in code points of ``formatted``, one per turn of ``learn_role``.
    Ties in score go to the smaller leaf.
    """
    nodes = _keyed(nodes)
    steps = _paths(nodes).join(nodes.select("tree", "node", "score", "role", "text"), ["tree", "node"])
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    steps = steps.select(
        "tree", "leaf", "up", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.concat(F.lit(OPEN), escaped_role(role), F.lit("\n")).alias("head"), escaped(text).alias("body"),
        (role == learn_role).alias("learn"))
    scores = steps.groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    best = scores.withColumn("rank", rank).where(F.col("rank") <= top_k)
    size = F.length("head") + F.length("body") + len(CLOSE)
    end = F.sum(size).over(Window.partitionBy("tree", "leaf").orderBy(F.desc("up")))
    turns = steps.drop("score").join(best, ["tree", "leaf"]).withColumn(
        "start", end - F.length("body") - len(CLOSE))
    turn = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "start",
                    F.length("body").alias("length"), "learn")
    grouped = turns.groupBy("tree", "leaf", "score", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        F.col("tree.id").alias("tree"), "leaf", "score", "rank", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]),
                    lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: array of (role, text)."""
    pieces = F.split(formatted, CLOSE, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    inner = F.transform(pieces, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(inner, lambda p: F.struct(
        unescaped_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")))


def learned_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, read back."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substring(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
