"""Reply trees to conversations: paths by iterative self-joins, ranked, formatted with a loss mask, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.common import checked, ranked, stored

HEAD, TELL, END = "### ", ": ", "</turn>\n"
#: More rounds than any tree of 2**60 nodes takes; beyond it, replies go round in a circle.
MAX_ROUNDS = 60


def escaped(text: Column) -> Column:
    """Reversible; what comes out holds neither ``#`` without a backslash before it nor the end of a turn."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("#"), F.lit("\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\:"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chains(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations of numbered turns as reply trees: ``tree, node, parent, role, text``, each turn a reply to the
    one before by turn (null first), then role and text. Rows with a null conversation id are one conversation."""
    checked(turns, conv_col, turn_col, "role", "text")
    rows = turns.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("_turn"), "role", "text")
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    order = ranked(rows, "turns", "tree", "_turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), "_tie")
    order = stored(order.select("tree", F.col("pos").alias("node"), "role", "text"), "nodes")
    before = order.select(F.col("tree").alias("_tree"), (F.col("node") + 1).alias("_next"), F.col("node").alias("parent"))
    follows = (order["node"] == before["_next"]) & order["tree"].eqNullSafe(before["_tree"])
    return order.join(before, follows, "left").select("tree", "node", "parent", "role", "text")


def paths(nodes: DataFrame) -> DataFrame:
    """``leaf, node, above`` for each node on the way from each leaf up to its root; ``above``: steps above the leaf.

    Round by round the known stretch of every path doubles: it is joined with the ancestors as many steps up, which
    are joined with themselves. So rounds grow with the logarithm of the depth and rows with the paths' own length.
    ``nodes`` has unique ``node`` and ``parent``; a parent that is no node makes a root. Replies in a circle raise.
    """
    known = stored(nodes.select("node", "parent"), "tree")
    ids = known.select(F.col("node").alias("_n"))
    jump = known.where("parent is not null").join(ids, F.col("parent") == F.col("_n"), "left_semi").select("node", F.col("parent").alias("up"))
    jump = stored(jump, "jumps")
    parents = jump.select(F.col("up").alias("_n")).distinct()
    found = stored(
        known.join(parents, F.col("node") == F.col("_n"), "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above")),
        "paths",
    )
    step = 1
    for _ in range(MAX_ROUNDS):
        if jump.isEmpty():
            return found
        at = jump.select(F.col("node").alias("_n"), "up")
        longer = found.join(at, F.col("node") == F.col("_n")).select("leaf", F.col("up").alias("node"), (F.col("above") + step).alias("above"))
        found = stored(found.unionAll(longer), "paths")
        jump = stored(jump.select("node", F.col("up").alias("_m")).join(at, F.col("_m") == F.col("_n")).select("node", "up"), "jumps")
        step *= 2
    raise ValueError("replies go round in a circle")


def chosen(nodes: DataFrame, way: DataFrame, score: Column, keep: int | None = 1) -> DataFrame:
    """``tree, leaf, branch_score, branch_rank`` of the ``keep`` best branches of each tree (None: all): by the sum
    of ``score`` over their nodes (null counts 0), ties to the smaller leaf. Only the best of each task are shuffled."""
    worth = nodes.select("tree", F.col("node").alias("_n"), F.coalesce(score.cast("double"), F.lit(0.0)).alias("_score"))
    branches = (
        way.join(worth, F.col("node") == F.col("_n")).groupBy("leaf", "tree").agg(F.sum("_score").alias("branch_score"))
    )
    best = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    if keep is None:
        return branches.withColumn("branch_rank", F.row_number().over(best))
    return branches.withColumn("branch_rank", F.row_number().over(best)).where(F.col("branch_rank") <= keep)


def formatted(nodes: DataFrame, score: Column | None = None, keep: int | None = 1) -> DataFrame:
    """One conversation per chosen branch: ``tree, leaf, branch_score, branch_rank, formatted, loss_spans``.

    A turn is ``### role: text</turn>`` and a new line, with role and text escaped. ``loss_spans``: start and end (code
    points) of each assistant text within ``formatted``, in order. Null texts and roles count as empty. A branch is
    one value, as long as its texts together. ``score``: by default the length of the text.
    """
    checked(nodes, "tree", "node", "parent", "role", "text")
    way = paths(nodes)
    branch = chosen(nodes, way, F.length("text") if score is None else score, keep)
    said = nodes.select(
        F.col("node").alias("_n"), F.col("role").eqNullSafe("assistant").alias("_loss"),
        F.concat(F.lit(HEAD), escaped_role(F.col("role")), F.lit(TELL)).alias("_head"), escaped(F.col("text")).alias("_body"),
    )
    way = way.join(branch, "leaf").join(said, F.col("node") == F.col("_n"))
    upto = Window.partitionBy("leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("_head") + F.length("_body") + len(END)
    start = (F.coalesce(F.sum(size).over(upto), F.lit(0)) + F.length("_head")).cast("long")
    turn = F.struct(
        (-F.col("above")).alias("order"), F.concat("_head", "_body", F.lit(END)).alias("said"), "_loss",
        F.struct(F.col("_start").alias("start"), (F.col("_start") + F.length("_body")).alias("end")).alias("span"),
    )
    lines = way.withColumn("_start", start).groupBy("leaf").agg(
        F.first("tree").alias("tree"), F.first("branch_score").alias("branch_score"), F.first("branch_rank").alias("branch_rank"),
        F.sort_array(F.collect_list(turn)).alias("turns"),
    )
    return lines.select(
        "tree", "leaf", "branch_score", "branch_rank",
        F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["_loss"]), lambda t: t["span"]).alias("loss_spans"),
    )


def read_back(output: DataFrame) -> DataFrame:
    """``output`` with ``turns`` (role, text) parsed from ``formatted`` and ``loss_text``, the unescaped text under the
    spans, one after another."""
    said = F.slice(F.split("formatted", END.replace("\n", "\\n"), -1), F.lit(1), F.size(F.split("formatted", END.replace("\n", "\\n"), -1)) - 1)
    head = r"(?s)^### (.*?(?<!\\)(?:\\\\)*): "
    turns = F.transform(said, lambda s: F.struct(
        unescaped(F.regexp_extract(s, head, 1)).alias("role"), unescaped(F.regexp_replace(s, head, "")).alias("text"),
    ))
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return output.withColumn("turns", turns).withColumn("loss_text", F.array_join(masked, ""))
