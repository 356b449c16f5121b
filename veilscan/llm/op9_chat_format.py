"""Chat formatting: a dialogue seen by each of its participants, in DataFrame functions alone.

For every participant the dialogue is rendered with that speaker as the assistant and the others as named users; only
the assistant's words (and the end mark) are learned. A rendered dialogue is rows, one for each message, with its text,
its place in the whole text and the span that the mask covers: no dialogue is gathered in one task, however long.

Perspectives differ in the heads of messages alone. So a message's place is the running size of all messages with a
user's head, less what the perspective's own messages before it save. These sums run inside blocks of turns and, over
small rows without texts, over blocks. Texts are shuffled once, by dialogue and block, before they are multiplied by
perspectives; one long dialogue is many groups.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

SYSTEM = "system"
#: Turns of one block of running sums.
BLOCK = 64


def head(kind: Column, name: Column) -> Column:
    return F.concat(F.lit("<|start|>"), kind, F.when(kind == "user", F.concat(F.lit(" name="), name)).otherwise(F.lit("")), F.lit("\n"))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each participant (``perspective``) and message: role, name, rendered, char_start, char_end, mask_start, mask_end, learn.

    Participants are the roles of a dialogue but for ``system``, whose messages stay as they are. A null role is the
    participant "unknown", a null text is empty, a null turn comes first; ties and repeated rows are ordered by role
    and text. A very long text is one row as any. Rows of a null conv_id are one dialogue. A dialogue of system messages
    alone has no perspective and gives no rows, nor does an empty table. Other columns are not read, whatever their names."""
    name, content = F.coalesce(turns[role], F.lit("unknown")), F.coalesce(turns[text], F.lit(""))
    number = turns[turn].cast("long")
    # a null dialogue is a key of its own
    key = F.coalesce(F.concat(F.lit("c"), turns[conv_id].cast("string")), F.lit("n")).alias("key")
    block = F.coalesce(F.floor(number / BLOCK), F.lit(-(1 << 62))).alias("block")
    t = turns.select(key, block, turns[conv_id].alias("conv_id"), number.alias("turn"), name.alias("name"), content.alias("content"))
    own = lambda kind: F.length(head(F.lit(kind), F.col("name"))).cast("long")
    plain = F.when(F.col("name") == SYSTEM, own("system")).otherwise(own("user")) + F.length("content") + F.length(F.lit("<|end|>\n"))
    saved = F.when(F.col("name") == SYSTEM, F.lit(0)).otherwise(own("user") - own("assistant"))

    # small rows: sizes and speakers of blocks, and from them what lies before each block for each perspective
    by_name = t.groupBy("key", "block", "name").agg(F.sum(plain).alias("size"), F.sum(saved).alias("saved"))
    before = lambda *by: Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = by_name.groupBy("key", "block").agg(F.sum("size").alias("size")).withColumn("base", F.coalesce(F.sum("size").over(before("key")), F.lit(0))).drop("size")
    who = by_name.filter(F.col("name") != SYSTEM).select("key", F.col("name").alias("perspective")).distinct()
    grid = blocks.join(who, "key").join(by_name.select("key", "block", F.col("name").alias("perspective"), "saved"), ["key", "block", "perspective"], "left")
    grid = grid.withColumn("base", F.col("base") - F.coalesce(F.sum("saved").over(before("key", "perspective")), F.lit(0))).drop("saved")

    order = [F.col("turn").asc_nulls_first(), "name", "content"]
    inner = Window.partitionBy("key", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("inner", F.coalesce(F.sum(plain).over(inner), F.lit(0)))
    seen = t.join(grid, ["key", "block"])
    mine = F.col("name") == F.col("perspective")
    spared = Window.partitionBy("key", "block", "perspective").orderBy("inner").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("spared", F.coalesce(F.sum(F.when(mine, saved).otherwise(F.lit(0))).over(spared), F.lit(0)))
    kind = F.when(F.col("name") == SYSTEM, F.lit("system")).when(mine, F.lit("assistant")).otherwise(F.lit("user"))
    rendered = F.concat(head(kind, F.col("name")), F.col("content"), F.lit("<|end|>\n"))
    start, size = F.col("base") + F.col("inner") - F.col("spared"), F.length(rendered).cast("long")
    learn = kind == "assistant"
    return seen.select(
        "conv_id",
        "perspective",
        "turn",
        kind.alias("role"),
        "name",
        rendered.alias("rendered"),
        start.alias("char_start"),
        (start + size).alias("char_end"),
        F.when(learn, start + F.length(head(kind, F.col("name")))).alias("mask_start"),
        F.when(learn, start + size - 1).alias("mask_end"),
        learn.cast("int").alias("learn"),
    )


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS content FROM conversations),
w AS (SELECT DISTINCT conv_id, name AS perspective FROM t WHERE name <> 'system'),
s AS (SELECT t.conv_id, perspective, turn, name, content,
    CASE WHEN name = 'system' THEN 'system' WHEN name = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
r AS (SELECT *, '<|start|>' || role || CASE WHEN role = 'user' THEN ' name=' || name ELSE '' END || chr(10) AS head FROM s),
f AS (SELECT *, head || content || '<|end|>' || chr(10) AS rendered FROM r),
p AS (SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, rendered
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM f)
SELECT conv_id, perspective, turn, role, name, rendered, char_start, char_start + length(rendered) AS char_end,
  CASE WHEN role = 'assistant' THEN char_start + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN char_start + length(rendered) - 1 END AS mask_end,
  CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS learn
FROM p
"""
