"""Chat formatting of reply trees: self-joins enumerate root-to-leaf paths, branches are ranked, paths are formatted."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import discard, table, written

#: The template of a turn: HEAD, role, MIDDLE, text, TAIL. Texts and roles hold none of their marks after escaping.
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
#: Each escaped character and what stands for it. The backslash comes first when escaping and last when undoing it;
#: in escaped text every backslash begins one of these pairs.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
TRAINED = "assistant"
#: Parts in which a tree's leaves are ranked first.
RANK_PARTS = 32


def escape(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, F.coalesce(text, F.lit("")))


def unescape(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[1]), F.lit(pair[0])), reversed(ESCAPES), text)


def climbs(nodes: DataFrame) -> DataFrame:
    """(node, score, depth, is_leaf) of (node, parent, score) rows: the sum of scores from the node up to its root, and the edges between.

    Pointers double: in each round a node's pointer goes to where the node it points to points, so n levels take log2(n)
    rounds of one row a node. A parent that isn't there ends the path; null scores are 0. A row that still
    points somewhere once pointers reach further than there are nodes is on a cycle or below one and has no root: it is
    left out. Nodes that come twice are an error.
    """
    given = nodes.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    parents = given.select(F.col("parent").alias("__p")).where("__p IS NOT NULL").distinct()
    there = given.select(F.col("node").alias("__to"))
    state = given.join(there, F.col("parent") == F.col("__to"), "left").join(parents, F.col("node") == F.col("__p"), "left")
    up = F.col("__to").isNotNull().cast("long")
    state = written(state.select("node", F.col("__to").alias("to"), "score", up.alias("depth"), F.col("__p").isNull().alias("is_leaf")), "climbs")
    n, distinct = state.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
    if n > distinct:
        raise ValueError("nodes must be unique")
    reach = 1
    while reach < n and not state.where("to IS NOT NULL").isEmpty():
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("__to"), F.col("score").alias("__score"), F.col("depth").alias("__depth"))
        moved = state.where("to IS NOT NULL").join(ahead, "to").select("node", F.col("__to").alias("to"), (F.col("score") + F.col("__score")).alias("score"), (F.col("depth") + F.col("__depth")).alias("depth"), "is_leaf")
        further = written(moved.unionByName(state.where("to IS NULL")), "climbs")
        discard(state)
        state, reach = further, 2 * reach
    return state.where("to IS NULL").drop("to")


def best_leaves(nodes: DataFrame, trees: DataFrame, best: int = 1) -> DataFrame:
    """(leaf, tree, rank, score, depth): the leaves of the `best` highest-scoring root-to-leaf paths of each tree, ties to the smaller leaf.

    `trees` has (node, tree). Paths are ranked by their sums alone; none is enumerated. Of a tree only the best of each
    of some parts are ranked together.
    """
    ends = climbs(nodes).where("is_leaf").select(F.col("node").alias("leaf"), "score", "depth")
    leaves = ends.join(trees.select(F.col("node").alias("leaf"), "tree"), "leaf").withColumn("__part", F.pmod(F.xxhash64("leaf"), F.lit(RANK_PARTS)))
    order = [F.desc("score"), F.col("leaf")]
    some = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree", "__part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.select("leaf", "tree", "rank", "score", "depth")


def paths(nodes: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(leaf, node, depth, score, ...): the paths of `leaves` (best_leaves() rows; by default all leaves of (node, parent, score) rows) up to
    their roots, from depth 0 at the leaf, with the path's score and the leaf's other columns.

    Each round is a self-join that doubles the reach: every path grows by its nodes' jumps, and a jump goes on to the jump
    of its end, so n levels take log2(n) rounds. Only the chosen paths are enumerated. Rows on a cycle or below one have no root and give nothing.
    """
    if leaves is None:
        leaves = climbs(nodes).where("is_leaf").select(F.col("node").alias("leaf"), "score", "depth")
    chosen = written(leaves.withColumnRenamed("depth", "__levels"), "leaves")
    levels = chosen.agg(F.max("__levels")).first()[0] or 0
    jumps = written(nodes.select("node", F.col("parent").alias("to")).where("to IS NOT NULL").join(nodes.select(F.col("node").alias("to")), "to", "left_semi"), "jumps")
    found = chosen.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("depth"))
    reach = 1
    while reach <= levels:
        grown = found.join(jumps, "node").select("leaf", F.col("to").alias("node"), (F.col("depth") + reach).alias("depth"))
        longer = written(found.unionByName(grown), "paths")
        ahead = jumps.select(F.col("node").alias("to"), F.col("to").alias("__to"))
        further = written(jumps.join(ahead, "to").select("node", F.col("__to").alias("to")), "jumps")
        discard(jumps, *([found] if reach > 1 else []))
        found, jumps, reach = longer, further, 2 * reach
    return found.join(chosen.drop("__levels"), "leaf")


def format_paths(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, mask) of the paths() of best_leaves(): each path as one text, root first, and its loss mask.

    `messages` has (node, role, text). `mask` holds (start, length) spans, in code points, of the assistant's texts.
    """
    turns = chosen.join(messages, "node").select("tree", "leaf", "rank", "depth", "role", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    turn = F.concat(F.lit(HEAD), "r", F.lit(MIDDLE), "t", F.lit(TAIL))
    upto = Window.partitionBy("leaf").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = turns.withColumn("turn", turn).withColumn("end", F.sum(F.char_length("turn")).over(upto))
    length = F.char_length("t").cast("long")
    span = F.when(F.col("role") == TRAINED, F.struct((F.col("end") - len(TAIL) - length).alias("start"), length.alias("length")))
    whole = ends.groupBy("leaf").agg(
        F.first("tree").alias("tree"),
        F.first("rank").alias("rank"),
        F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "turn", span.alias("span")))).alias("turns"),
    )
    return whole.select(
        "tree", "leaf", "rank", F.array_join("turns.turn", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("mask")
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    parts = F.filter(F.split(formatted, TAIL), lambda x: x != "")

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(len(HEAD) + 1), F.char_length(x))
        role = F.substring_index(body, MIDDLE, 1)
        text = F.substring(body, F.char_length(role) + len(MIDDLE) + 1, F.char_length(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _spans(text: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([[t[a : a + n] for a, n in zip(at.tolist(), size.tolist())] for t, at, size in zip(text, start, length)], dtype=object)


def read_masked(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped. Cut in Python, where a span costs its own length wherever it starts."""
    return F.transform(_spans(formatted, mask["start"], mask["length"]), unescape)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of (conv_id, turn, role, text) rows, each row replying to the one before it.

    Rows go by turn (null first), then role and text, so that ties and repeated rows have a place. A null conv_id is
    one conversation of its own; a null role or text is empty. Other columns aren't read. No rows give no rows.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    placed = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("n"))
    known = placed.withColumn("node", F.struct("conv_id", "n"))
    messages = written(known.withColumn("parent", F.when(F.col("n") > 1, F.struct("conv_id", (F.col("n") - 1).alias("n")))), "messages")
    nodes = messages.select("node", "parent", F.lit(0.0).alias("score"))
    best = best_leaves(nodes, messages.select("node", F.struct("conv_id").alias("tree")))
    return format_paths(paths(nodes, best), messages.select("node", "role", "text")).select("tree.conv_id", "formatted", "mask")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = written(format_conversations(rows.unionByName(probe)), "chat")
    out = out.withColumn("masked", F.array_join(read_masked(F.col("formatted"), F.col("mask")), ""))
    turns, masked = read_turns(F.col("formatted")), F.col("masked")
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           length(coalesce(role, '')) + length(coalesce(text, '')) + 14
           + length(regexp_replace(coalesce(role, '') || coalesce(text, ''), '[^\\#<:]', '', 'g')) AS chars
    FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
