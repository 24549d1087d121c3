"""Chat formatting of reply trees.

Messages point at the message they answer. Root-to-leaf paths are followed by self-joins that double
their reach each time: with jumps of 1, 2, 4 ... ancestors, a tree of depth d takes log2(d) joins of ids.
A path's score is the sum of its messages' scores; the best branches of each tree are chosen, their paths
enumerated, and each is formatted as one conversation:

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings inside roles and texts are escaped: a run of backslashes between '<' and '|' gets one more,
so a text never holds '<|'. A newline in a role becomes the control string <|nl|>. Both are undone by
reading back. The loss mask is a list of code-point spans of the formatted string, one for each turn of
the trained role, around its escaped text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.shared import map_text, named, written

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, text = piece[: -len(END) - 1].split("\n", 1)
        turns.append((unescape(role.replace(NEWLINE, "\n")), unescape(text)))
    return turns


def climbed(messages: DataFrame) -> list[DataFrame]:
    """Tables of tree, node, score, to: the k-th has the message 2**k steps above, or null, and the score of it and all below it on the way.

    Parents that are missing count as none. The last table has the whole way's score where `to` is null. Where it is
    not, the message leads into a cycle: if a doubling ends no further way, none that ends can be so long, as all
    that is shorter would stand on it. No table has more rows than there are messages.
    """
    known = messages.select("tree", F.col("node").alias("parent"), F.col("node").alias("to")).distinct()
    at = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).join(known, ["tree", "parent"], "left")
    levels = [written(at.select("tree", "node", "score", "to"), "climbed")]
    left = levels[0].filter("to is not null").count()
    while left:
        now = levels[-1]
        ahead = now.select("tree", F.col("node").alias("to"), F.col("score").alias("more"), F.col("to").alias("far"))
        now = now.join(ahead, ["tree", "to"], "left").select("tree", "node", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"), F.col("far").alias("to"))
        levels.append(written(now, "climbed"))
        before, left = left, levels[-1].filter("to is not null").count()
        if left == before:
            break
    return levels


def paths(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree, leaf, node, up (steps from the leaf) of the paths from these leaves (tree, leaf) to their roots: each self-join doubles their reach."""
    out = written(leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")), "paths")
    for k, level in enumerate(levels[:-1]):
        further = out.join(level.filter("to is not null"), ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        out = written(out.unionByName(further), "paths")
    return out


def format_trees(messages: DataFrame, top: int = 1, trained: str = TRAINED) -> DataFrame:
    """tree, leaf, rank, score, n_turns, formatted, loss_spans of the `top` best branches of each tree.

    messages has tree, node, parent, role, text and score. Parents that are missing count as none. Messages that lead
    into a cycle are on no path. Rows with a null tree or node are left out; of rows with one tree and node the first by
    parent, role, text and score (nulls first) counts. Null roles and texts are empty, null scores 0. Ties go to the
    smaller leaf. An empty table gives none.

    Branches are scored by message, so their number may be large; only the chosen ones are written out step by step.
    """
    whole = ["parent", "role", "text", "score"]
    once = messages.filter("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(F.struct(*whole)).alias("first"))
    messages = written(once.select("tree", "node", *[F.col(f"first.{c}").alias(c) for c in whole]), "messages")
    levels = climbed(messages)
    ended = levels[-1].filter("to is null").select("tree", "node", "score")
    branches = ended.join(levels[0].filter("to is not null").select("tree", F.col("to").alias("node")), ["tree", "node"], "left_anti").withColumnRenamed("node", "leaf")
    best = branches.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).filter(F.col("rank") <= top)
    best = written(best, "best")
    chosen = paths(best, levels).join(best, ["tree", "leaf"])
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = chosen.join(messages.select("tree", "node", role.alias("role"), text.alias("text")), ["tree", "node"])
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    turn = F.struct((-F.col("up")).alias("at"), head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == trained).alias("loss"))
    whole = turns.groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    tail = F.lit(END + "\n")
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans")),
        lambda done, t: F.struct(
            (done["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END) + 1).alias("at"),
            F.when(t["loss"], F.concat(done["spans"], F.array(F.struct((done["at"] + F.length(t["head"])).alias("start"), (done["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))).otherwise(done["spans"]).alias("spans"),
        ),
        lambda done: done["spans"],
    )
    return whole.select(
        "tree", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], tail)), "").alias("formatted"), spans.alias("loss_spans"),
    )


def from_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of conversations that are rows by turn: each answers the one before it. tree_id keeps the id.

    Rows of one turn are put in order by role and text. Rows with a null id are one conversation.
    """
    tree = F.coalesce(F.concat(F.lit("="), named(id_col).cast("string")), F.lit("null"))
    rows = conversations.select(tree.alias("tree"), named(id_col).alias("tree_id"), named(turn_col).alias("turn"), named(role_col).alias("role"), named(text_col).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    return rows.select("tree", "tree_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def turn_texts(formatted: DataFrame, keep: list[str]) -> DataFrame:
    """`turns_text` (role, newline, text, newline of every turn) and `loss_text` (what is under the loss mask), read back from formatted and loss_spans."""

    def make():
        def of(wholes, masks):
            turns = ["".join(f"{role}\n{text}\n" for role, text in read_back(whole)) for whole in wholes]
            loss = ["".join(unescape(whole[s["start"] : s["end"]]) for s in mask) for whole, mask in zip(wholes, masks)]
            return [turns, loss]

        return of

    return map_text(formatted, ["formatted", "loss_spans"], make, [T.StructField("turns_text", T.StringType()), T.StructField("loss_text", T.StringType())], keep)
