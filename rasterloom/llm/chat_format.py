"""Chat formatting of reply trees; built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

OPEN, TURN, TEXT, END, CLOSE = "<s>", "<|turn|>", "<|text|>", "<|end|>", "</s>"
#: What may follow an opening < or [ in a control string, of this template or of other common ones.
_REST = r"/?s>|\|(?:turn|text|end)\|>|/?INST\]"


def escape(col) -> F.Column:
    """A control string in a text gets one more ~ after its first character."""
    return F.regexp_replace(col, rf"([<\[])(~*)({_REST})", "$1~$2$3")


def unescape(col) -> F.Column:
    return F.regexp_replace(col, rf"([<\[])~(~*)({_REST})", "$1$2$3")


def _jumps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pointer doubling by self-joins: (tree, node, depth, total) of every node below a root, and the jumps of 1, 2, 4, ... replies up.

    Where replies are left that reach no root in as many jumps as there are rows, they lie on or below a
    cycle; then the least node of each cycle is made a root and the jumps are done again.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    step = materialise(
        nodes.join(known.withColumn("has", F.lit(True)), ["tree", "parent"], "left")
        .select("tree", "node", F.when(F.col("has"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"), F.col("node").alias("low"))
    )
    rows, levels, done = step.count(), [], step.where("up is null")
    open_rows = step.where("up is not null")
    while 2 ** len(levels) <= rows and not open_rows.isEmpty():
        levels.append(open_rows.select("tree", "node", "up"))
        above = done.select("tree", F.col("node").alias("up"), F.lit(None).cast("long").alias("next"), F.col("depth").alias("d"), F.col("total").alias("t"), F.col("low").alias("l"))
        above = above.unionByName(open_rows.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("d"), F.col("total").alias("t"), F.col("low").alias("l")))
        joined = materialise(
            open_rows.join(above, ["tree", "up"])
            .select("tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("t")).alias("total"), F.least("low", "l").alias("low"))
        )
        done = done.unionByName(joined.where("up is null"))
        open_rows = joined.where("up is not null")
    if not open_rows.isEmpty():
        # A node that so many jumps lead to is on a cycle, and all of that cycle is above it.
        turning = open_rows.select("tree", F.col("up").alias("node")).distinct()
        roots = open_rows.join(turning, ["tree", "node"]).select("tree", F.col("low").alias("node")).distinct().withColumn("cut", F.lit(True))
        cut = nodes.join(roots, ["tree", "node"], "left").withColumn("parent", F.when(F.col("cut").isNull(), F.col("parent"))).drop("cut")
        return _jumps(materialise(cut))
    return done.select("tree", "node", "depth", "total"), levels


def reply_paths(nodes: DataFrame, branches: int | None) -> DataFrame:
    """Root-to-leaf paths as rows (tree, leaf, node, depth), of the best `branches` leaves of each tree (all, if None).

    A path's score is the mean of its nodes'; ties go to the longer path, then to the lesser leaf.
    Jump tables are thin and halve the open replies, so a thread of n replies takes log2(n) joins
    each way, and no array of a path is ever carried.
    """
    placed, levels = _jumps(nodes)
    parents = levels[0].select("tree", F.col("up").alias("node")).distinct() if levels else None
    leaves = placed if parents is None else placed.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), F.col("depth").desc(), "node")
    if branches is not None:
        leaves = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", "depth")
    for k in reversed(range(len(levels))):
        up = paths.join(levels[k], ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        paths = materialise(paths.unionByName(up))
    return paths


def format_conversations(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """Each chosen path of reply trees as one training text.

    nodes: (tree string, node long, parent long, role, text, score double). Returns (tree, leaf,
    formatted, loss), loss the spans (start from 0, length) in code points of assistant texts.
    A null role or text is an empty one, a null score is 0; a parent that is not there makes a
    root, and so does the least node of a cycle. Of rows that repeat a (tree, node) the least by parent,
    role, text and score counts; rows without a tree or node are in no path. An empty table gives no rows; other columns
    are ignored. One path is one text, so its turns meet in one task: a path must fit in an executor's memory.
    """
    nodes = nodes.select("tree", "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")).where("tree is not null and node is not null")
    if not nodes.groupBy("tree", "node").count().where("count > 1").isEmpty():
        first = F.min(F.struct("parent", "role", "text", "score")).alias("first")
        nodes = materialise(nodes.groupBy("tree", "node").agg(first).select("tree", "node", "first.*"))
    paths = reply_paths(nodes.select("tree", "node", "parent", "score"), branches)
    body = escape(F.coalesce("text", F.lit("")))
    turns = paths.join(nodes.select("tree", "node", "role", body.alias("body")), ["tree", "node"])
    turns = turns.withColumn("head", F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT)))
    order = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("body") + len(END)
    start = F.coalesce(F.sum(size).over(order), F.lit(0)) + len(OPEN) + F.char_length("head")
    turns = turns.select("tree", "leaf", F.struct("depth", F.concat("head", "body", F.lit(END)).alias("turn"), start.alias("start"), F.char_length("body").cast("long").alias("length"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn")).alias("t"))
    whole = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select(
        "tree", "leaf",
        F.concat(F.lit(OPEN), F.array_join(F.transform("t", lambda t: t.turn), ""), F.lit(CLOSE)).alias("formatted"),
        F.transform(F.filter("t", lambda t: t.learn), lambda t: F.struct(t.start.alias("start"), t.length.alias("length"))).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and learned, the text under the loss mask, parsed from formatted and loss alone."""
    inner = F.substring("formatted", F.lit(len(OPEN) + 1), F.char_length("formatted") - len(OPEN) - len(CLOSE))
    parts = F.filter(F.split(inner, r"<\|turn\|>"), lambda x: x != "")
    turn = lambda x: F.struct(
        unescape(F.substring_index(x, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(x, END, 1), TEXT, -1)).alias("text"),
    )
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int"))))
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("learned", F.array_join(learned, ""))


def linear_threads(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees: each turn replies to the one before it.

    Turns that repeat follow each other by role and text; a null turn comes first; rows with a null
    conv_id are one conversation. A conversation's turns are numbered in one task, which sorts and can spill.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    back = read_back(format_conversations(materialise(linear_threads(rows))))
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return back.select(
        F.when(F.col("tree") != "null", F.col("tree").cast("long")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, 22 + len(regexp_replace(role || '|' || text, '([<\[])(~*)(/?s>|\|(?:turn|text|end)\|>|/?INST\])', '\1~\2\3', 'g')) AS size FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(7 + sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
