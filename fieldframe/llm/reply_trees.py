"""Chat formatting over reply trees.

Messages point to their parent. Iterative self-joins double the known stretch of every leaf's path until all
roots are reached, branches are ranked by score, and each chosen path becomes one conversation string with the
spans of the text that counts for the loss. Everything is DataFrame functions.

Template of a turn: ``### role: text</turn>`` and a line end. Inside roles and texts the characters of the control
strings are escaped: backslash, ``#``, ``<`` and, in roles, ``:`` become a backslash and a letter, so a control
string can never appear inside a text and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.llm.common import staged
from fieldframe.operators.blocks import range_blocks, row_numbers

OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"
#: Character and its escape; the backslash comes first when escaping and last when reading back.
_TEXT_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
_ROLE_ESCAPES = (*_TEXT_ESCAPES, (":", "\\c"))


def _replace(value: Column, old: str, new: str) -> Column:
    return F.replace(value, F.lit(old), F.lit(new))


def escape(value: Column, escapes=_TEXT_ESCAPES) -> Column:
    for plain, coded in escapes:
        value = _replace(value, plain, coded)
    return value


def unescape(value: Column, escapes=_TEXT_ESCAPES) -> Column:
    for plain, coded in reversed(escapes):
        value = _replace(value, coded, plain)
    return value


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths of ``nodes(tree, node, parent)`` as rows (tree, leaf, node, up).

    ``up`` counts the steps from the leaf. Round k joins every known (leaf, node) with the table of jumps of 2^k
    steps, which is itself the self-join of the jumps of half the length; a path of n nodes takes log2(n) rounds.
    A parent that does not exist, or is the node itself, makes a root. A cycle has no root: it raises.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    jumps = staged(nodes.filter(~F.col("node").eqNullSafe(F.col("parent"))).join(known, ["tree", "parent"], "left_semi")
                   .select("tree", "node", F.col("parent").alias("to")), "reply-jumps")
    inner = jumps.select("tree", F.col("to").alias("node")).distinct()
    paths = staged(nodes.join(inner, ["tree", "node"], "left_anti")
                   .select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "reply-paths")
    total = nodes.count()
    step = 1
    while jumps.limit(1).count():
        if step > total:
            raise ValueError("the reply graph has a cycle")
        further = paths.join(jumps, ["tree", "node"]).select(
            "tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        paths = staged(paths.unionByName(further), "reply-paths")
        onward = jumps.select("tree", F.col("node").alias("to"), F.col("to").alias("_end"))
        jumps = staged(jumps.join(onward, ["tree", "to"]).select("tree", "node", F.col("_end").alias("to")), "reply-jumps")
        step *= 2
    return paths


def format_trees(messages: DataFrame, top: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path of ``messages(tree, node, parent, role, text, score)``.

    Result: tree, leaf, rank, score, n_turns, formatted, loss_spans (array of start and length in characters of
    ``formatted``, each covering the escaped text of one turn of ``loss_role``).

    A branch scores the mean of its nodes' scores (null counts as 0, NaN ranks before all numbers); ties go to the smaller leaf. ``top`` keeps
    that many branches of each tree, the default keeps all. Null texts and roles are empty, repeated rows of one
    (tree, node) count once (smallest parent, role, text, score), rows with a null tree form the tree null and a null node is dropped. Further
    columns are ignored. An empty table gives no rows. Paths and ranks are found eagerly, round by round.
    """
    one = F.min(F.struct("parent", "role", "text", F.col("score").cast("double").alias("score")))
    # a null tree is carried as a flag so that joins on the tree are plain equality
    nodes = staged(messages.filter(F.col("node").isNotNull())
                   .groupBy(F.struct(F.col("tree").isNull().alias("none"), F.coalesce(F.col("tree"), F.lit(0)).alias("id")).alias("tree"), "node").agg(one.alias("m"))
                   .select("tree", "node", "m.parent", F.coalesce("m.role", F.lit("")).alias("role"),
                           F.coalesce("m.text", F.lit("")).alias("text"), F.coalesce("m.score", F.lit(0.0)).alias("score")),
                   "reply-nodes")
    paths = leaf_paths(nodes.select("tree", "node", "parent"))
    if top is not None:
        ranked = _ranks(paths, nodes).filter(F.col("rank") <= top)
    else:
        ranked = _ranks(paths, nodes)
    ranked = staged(ranked, "reply-ranks")
    turns = (paths.join(ranked.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
             .join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), _ROLE_ESCAPES), F.lit(SEPARATOR))
    body = escape(F.col("text"))
    piece = F.concat(head, body, F.lit(CLOSE))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    laid = (turns.select("tree", "leaf", "up", piece.alias("piece"), F.length(head).alias("skip"),
                         F.length(body).alias("size"), (F.col("role") == loss_role).alias("counts"))
            .withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("skip")))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("o"), "piece", "counts", "at", "size")))
    joined = laid.groupBy("tree", "leaf").agg(ordered.alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["counts"]),
                        lambda x: F.struct(x["at"].alias("start"), x["size"].cast("long").alias("length")))
    text = F.array_join(F.transform("t", lambda x: x["piece"]), "")
    return (joined.select("tree", "leaf", F.size("t").cast("long").alias("n_turns"), text.alias("formatted"),
                          spans.alias("loss_spans"))
            .join(ranked, ["tree", "leaf"])
            .select(F.when(~F.col("tree.none"), F.col("tree.id")).alias("tree"), "leaf", "rank", "score", "n_turns",
                    "formatted", "loss_spans"))


def _ranks(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rank of every branch in its tree; branches are dealt by sampled ranges, so a tree of any size is no single task."""
    scored = (paths.join(nodes.select("tree", "node", "score"), ["tree", "node"])
              .groupBy("tree", "leaf").agg(F.avg("score").alias("score")))
    falling = scored.withColumns({"_number": ~F.isnan("score"), "_down": F.lit(0.0) - F.col("score")})
    best_first = ["_number", "_down", "leaf"]
    dealt = range_blocks(falling, ["tree", *best_first], "_range")
    ranked = row_numbers(dealt, ["tree"], best_first, "rank", F.col("_range"))
    return ranked.select("tree", "leaf", "score", "rank")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, SEPARATOR, 1)
        # the role has no separator in it, so the text starts right behind the first one
        text = F.substring(piece, F.length(role) + F.lit(len(SEPARATOR) + 1), F.length(piece))
        bare = F.substring(role, F.lit(len(OPEN) + 1), F.length(role))
        return F.struct(unescape(bare, _ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    pieces = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped and joined without anything between."""
    cut = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(cut, "")
