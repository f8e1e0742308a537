r"""Chat formatting of reply trees.

Messages form trees by conversation, node and parent.  Root-to-leaf paths are
enumerated by iterative self-joins with pointer doubling: step k joins every path
prefix with the ancestor 2**k above, so a path of d messages takes log2(d) joins and
its rows stay d, never d squared.  Branches are ranked by score; each of the best
``top`` leaves of a conversation becomes one formatted conversation.

Template: each turn is ``### role: text</turn>`` and a newline.  Inside texts ``\``,
``#`` and ``<`` are written ``\\ \h \l``, inside roles ``:`` and newlines also
``\c \n``; so no mark can occur inside a field, and ``read_back`` restores every
field exactly.  ``loss`` lists the spans
(start, length in code points) of the escaped assistant texts.

Defined results: null text and null role count as empty; a message whose parent is
missing or null is a root; of rows that share a conversation and node the one first
in order of parent, role and text is the parent of their children, and all keep
their place in linear tables; ties between branches go to the smaller leaf; cycles
are cut: a node on no path from a root to a leaf is not formatted; conversations with
a null id form one conversation; an empty table gives no rows; extra columns are
not read, so none can clash.  A formatted conversation is one row, as long as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

HEAD, END = "### ", "</turn>\n"
#: Characters and how they are written; the first is written first.
TEXT_ESCAPES = (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"), ("\n", "\\n"))


def escape(text: Column, codes: tuple[tuple[str, str], ...]) -> Column:
    for plain, coded in codes:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, codes: tuple[tuple[str, str], ...]) -> Column:
    def part(x: Column) -> Column:
        for plain, coded in codes[1:]:
            x = F.replace(x, F.lit(coded), F.lit(plain))
        return x

    # Pairs of backslashes are read from the left, so they never take half of another code.
    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def linear_tree(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of turns as trees: each turn answers the one before; nodes are numbered from 0."""
    m = messages.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    place = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    numbered = m.withColumn("node", (F.row_number().over(place) - 1).cast("long"))
    return numbered.select("conv", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(tree: DataFrame, top: int = 1) -> DataFrame:
    """tree: conv, node, parent, role, text, score.  Gives conv, leaf, up (messages below it on the path) and node."""
    links = tree.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    # One row per node; a parent that doesn't exist makes its child a root.
    links = links.groupBy("conv", "node").agg(F.min("parent").alias("parent"), F.min("score").alias("score"))
    nodes = links.select(F.col("conv").alias("c2"), F.col("node").alias("n2"), F.col("parent").alias("p2"))
    parents = links.where("parent IS NOT NULL").select(F.col("conv").alias("c2"), F.col("parent").alias("p2")).distinct()
    at = lambda a, b: F.col("conv").eqNullSafe(F.col("c2")) & (F.col(a) == F.col(b))
    kept = links.join(nodes.select("c2", "n2"), at("parent", "n2"), "left").withColumn("parent", F.col("n2")).drop("c2", "n2")
    kept = staged(kept, "chat-links")
    # sum: score from the node up to, not including, jump; steps: how many messages that is.
    jumps = kept.select("conv", "node", F.col("parent").alias("jump"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("steps"))
    leaves = kept.join(parents, at("node", "p2"), "left_anti").select("conv", F.col("node").alias("leaf"))
    # Only messages that haven't reached their root are joined again, so short trees
    # cost nothing in the rounds that a long one takes.
    active, finished, levels = jumps.where("jump IS NOT NULL"), [jumps.where("jump IS NULL")], []
    most = max(1, kept.count()).bit_length() + 1
    while len(levels) < most and not active.isEmpty():
        levels.append(active)
        held = reduce(DataFrame.unionByName, [*finished, active])
        above = held.select(F.col("conv").alias("c2"), F.col("node").alias("n2"), F.col("jump").alias("jump2"), F.col("sum").alias("sum2"), F.col("steps").alias("steps2"))
        stepped = active.join(above, at("jump", "n2")).select("conv", "node", F.col("jump2").alias("jump"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("steps") + F.col("steps2")).alias("steps"))
        stepped = staged(stepped, "chat-jumps")
        active = stepped.where("jump IS NOT NULL")
        finished.append(stepped.where("jump IS NULL"))
    # What is still active after the last round runs in a cycle; from such leaves no root is reached.
    full = reduce(DataFrame.unionByName, finished).select(F.col("conv").alias("c2"), F.col("node").alias("n2"), "sum", "steps")
    ranked = leaves.join(full, at("leaf", "n2")).select("conv", "leaf", (F.col("sum") / F.col("steps")).alias("mean"), "steps")
    order = Window.partitionBy("conv").orderBy(F.col("mean").desc(), "leaf")
    chosen = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("conv", "leaf")
    members = chosen.select("conv", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(levels))):
        step = levels[k].select(F.col("conv").alias("c2"), F.col("node").alias("n2"), "jump")
        higher = members.join(step, at("node", "n2")).select("conv", "leaf", F.col("jump").alias("node"), (F.col("up") + F.lit(2**k)).alias("up"))
        # Written each time, as the plan would else double with every step.
        members = staged(members.unionByName(higher), "chat-members")
    return members


def format_chats(tree: DataFrame, top: int = 1, loss_role: str = "assistant") -> DataFrame:
    """conv, leaf, formatted (string), loss (array of start and length of the escaped texts to learn)."""
    members = best_paths(tree, top)
    said = tree.select(F.col("conv").alias("c2"), F.col("node").alias("n2"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = members.join(said, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2")))
    head = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(": "))
    pieces = turns.select("conv", "leaf", F.struct((-F.col("up")).alias("at"), head.alias("head"), escape(F.col("text"), TEXT_ESCAPES).alias("body"), (F.col("role") == loss_role).alias("learn")).alias("turn"))
    chats = pieces.groupBy("conv", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = lambda t: F.concat(t.head, t.body, F.lit(END))
    empty = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        span = F.struct((acc.end + F.length(t.head)).cast("long").alias("start"), F.length(t.body).cast("long").alias("length"))
        return F.struct((acc.end + F.length(whole(t))).cast("long").alias("end"), F.when(t.learn, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

    return chats.select("conv", "leaf", F.array_join(F.transform("turns", whole), "").alias("formatted"), F.aggregate("turns", empty, add, lambda acc: acc.spans).alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``learned`` (texts under the loss mask), from formatted and loss alone."""
    # What follows the last end mark is empty.
    parts = F.split("formatted", "</turn>\n", -1)
    turn = lambda p: F.struct(unescape(F.regexp_extract(p, r"(?s)^### ([^:]*): ", 1), ROLE_ESCAPES).alias("role"), unescape(F.regexp_extract(p, r"(?s)^### [^:]*: (.*)$", 1), TEXT_ESCAPES).alias("text"))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")), TEXT_ESCAPES))
    return chats.select("*", F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn).alias("turns"), learned.alias("learned"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    chats = read_back(format_chats(staged(linear_tree(rows.unionByName(own)), "chat-tree")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return chats.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + length(regexp_replace(role, '[^\\:#<' || chr(10) || ']', '', 'g')) + 2 + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 8)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
