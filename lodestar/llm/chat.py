"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation's turns are cut into windows by prefix sums of their tokens.
What the budget leaves beside the system turn is the room for own turns; the
running total is cut into cells of half that room, and a window takes the turns
that end in one cell. A turn longer than a cell ends in a cell of its own or
first in it and is a window alone, so a window's own turns fit into the room
unless it is one turn alone.

Each window starts with the conversation's system turn and repeats the last
turns before it, as far as the budget goes; repeated turns are context only and
masked from the loss, so every target counts once. A window is over the budget
only if one of its own turns is that alone.

Ranks and prefix sums come in two levels (blocks of turn numbers, then turns
within a block), so a very long conversation is not sorted in one task; only a
window's own turns are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

BEGIN, END = "<|begin|>", "<|end|>\n"
#: Strings that chat templates use as controls, each with its escape. The escape sign comes first.
ESCAPES = (("~", "~0"), ("<|", "~1"), ("[INST]", "~3"), ("[/INST]", "~4"), ("<s>", "~5"), ("</s>", "~6"), ("<<SYS>>", "~7"), ("<</SYS>>", "~8"))
NEWLINE = ("\n", "~2")
BUDGET, HISTORY, HISTORY_TOKENS = 512, 2, 128
BLOCK = 256
CHARS_PER_TOKEN, TURN_TOKENS = 4, 4


def escaped(text: Column, line: bool = False) -> Column:
    """The text without control strings; `line`: nor line ends (for roles)."""
    for raw, code in ESCAPES + ((NEWLINE,) if line else ()):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for raw, code in reversed(ESCAPES + (NEWLINE,)):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def tokens(text: Column) -> Column:
    """A turn's estimated tokens: its characters in fours, and its markers."""
    return F.ceil(F.char_length(text) / CHARS_PER_TOKEN).cast("bigint") + TURN_TOKENS


def _ordered(df: DataFrame) -> DataFrame:
    """Turns with idx (1, 2, ... in a conversation) and total (running tokens)."""
    rows = df.select(
        F.col("conv_id").alias("conv"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({"block": F.floor(F.col("turn") / BLOCK), "tokens": tokens(F.col("text"))})
    before = Window.partitionBy("conv").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        F.col("conv").alias("b_conv"), F.col("block").alias("b_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b_n"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("b_t")
    )
    inside = Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumns({"i": F.row_number().over(inside), "run": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.join(blocks, F.col("conv").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block")))
    return rows.select("conv", (F.col("b_n") + F.col("i")).alias("idx"), "role", "text", "tokens", (F.col("b_t") + F.col("run")).alias("total"))


def windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row a window: conv_id, window, formatted, n_context, loss, tokens.

    df: conv_id, turn, role, text. window: the number of its first own turn;
    n_context: leading turns that are repeated (system turn and history); loss:
    array<struct<start, length>> in code points of `formatted`, the assistant
    turns that are new in this window; tokens: of all its turns, by tokens().

    The system turn is the first turn of that role. It is repeated where it and
    the own turns stay within the budget, or the own turn is over it alone.
    History are the last turns before the window, at most `history` turns and
    `history_tokens` tokens, and no more than the budget leaves.

    Null text or role: empty. Turns go by turn number (nulls first), then role,
    then text; repeated rows are turns of their own; null conv_ids are one
    conversation. Other columns are not read; an empty table gives no rows.
    """
    rows = checkpoint(_ordered(df))  # read for places, then for texts
    turns = rows.select("conv", "idx", "tokens", "total", (F.col("role") == "system").alias("system"))
    system = turns.filter("system").groupBy(F.col("conv").alias("s_conv")).agg(F.min(F.struct("idx", "tokens")).alias("said"))
    room = budget - F.least(F.coalesce("said.tokens", F.lit(0)), F.lit(budget // 2))
    half = F.floor((room + 1) / 2)
    turns = turns.join(system, F.col("conv").eqNullSafe(F.col("s_conv")), "left")
    # long turns come first of those that end in a cell
    turns = turns.withColumn("cell", 2 * F.floor((F.col("total") - 1) / half) + (F.col("tokens") <= half).cast("int"))
    span = Window.partitionBy("conv", "cell")
    turns = checkpoint(turns.select("conv", "idx", "tokens", "said", F.min("idx").over(span).alias("w"), F.sum("tokens").over(span).alias("own")))
    told = (F.col("said.idx") < F.col("w")) & ((F.col("said.tokens") + F.col("own") <= budget) | (F.col("own") > budget))
    spans = turns.filter(F.col("idx") == F.col("w")).withColumn("told", F.coalesce(told, F.lit(False)))
    retained = spans.filter("told").select("conv", "w", "said.idx", F.lit(True).alias("again"))
    # the turns before a window that it may repeat, nearest first, as far as what is left goes
    left = F.least(F.lit(history_tokens), budget - F.col("own") - F.when(F.col("told"), F.col("said.tokens")).otherwise(0))
    before = F.filter(F.transform(F.sequence(F.lit(1), F.lit(history)), lambda k: F.col("w") - k), lambda i: (i > 0) & ~(F.col("told") & (i == F.col("said.idx"))))
    wanted = spans.filter("w > 1").select(F.col("conv").alias("h_conv"), F.col("w").alias("h_w"), left.alias("left"), F.explode(before).alias("h_idx"))
    back = Window.partitionBy("conv", "h_w").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    near = turns.select("conv", "idx", "tokens").join(wanted, F.col("conv").eqNullSafe(F.col("h_conv")) & (F.col("idx") == F.col("h_idx")))
    near = near.withColumn("run", F.sum("tokens").over(back)).filter(F.col("run") <= F.col("left")).select("conv", F.col("h_w").alias("w"), "idx", F.lit(True).alias("again"))
    places = turns.select("conv", "w", "idx", F.lit(False).alias("again")).unionAll(retained).unionAll(near)
    places = places.select(F.col("conv").alias("p_conv"), "w", F.col("idx").alias("p_idx"), "again")
    every = rows.join(places, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("idx") == F.col("p_idx")))
    grouped = every.groupBy("conv", "w").agg(F.array_sort(F.collect_list(F.struct("idx", "again", "role", "text"))).alias("turns"), F.sum("tokens").alias("tokens"))

    def shown(t):
        return F.struct(F.concat(F.lit(BEGIN), escaped(t["role"], True), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), ((t["role"] == "assistant") & ~t["again"]).alias("target"))

    def place(acc, t):
        start = acc["at"] + F.char_length(t["head"])
        length = F.char_length(t["body"])
        made = F.struct(start.alias("start"), length.alias("length"))
        return F.struct((start + length + len(END)).alias("at"), F.when(t["target"], F.array_append(acc["out"], made)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))
    grouped = grouped.withColumn("shown", F.transform("turns", shown))
    return grouped.select(
        F.col("conv").alias("conv_id"), F.col("w").cast("bigint").alias("window"),
        F.concat_ws("", F.transform("shown", lambda t: F.concat(t["head"], t["body"], F.lit(END)))).alias("formatted"),
        F.size(F.filter("turns", lambda t: t["again"])).alias("n_context"),
        F.aggregate("shown", zero, place, lambda a: a["out"]).alias("loss"), "tokens",
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted window, as array<struct<role, text>>."""

    def one(part):
        role = F.substring_index(part, "\n", 1)
        at = F.char_length(role) + 2
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(part, at, F.char_length(part) - at + 1 - len(END))).alias("text"))

    parts = F.split(formatted, r"<\|begin\|>", -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)


def op8_chat_windows(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("bigint"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), said)
    rows = rows.unionAll(more)
    made = windows(rows).withColumn("turns", read_back(F.col("formatted")))
    fresh = F.slice("turns", F.col("n_context") + 1, F.greatest(F.size("turns") - F.col("n_context"), F.lit(0)))
    made = made.select(
        "conv_id", "window", F.size(fresh).alias("n"),
        F.concat_ws("", F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns"),
        F.concat_ws("", F.transform("loss", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))).alias("loss"),
        F.char_length("formatted").alias("chars"),
    )
    whole = made.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("all"), F.sum("chars").alias("formatted_chars")
    )
    loss = F.concat_ws("", F.transform("all", lambda w: w["loss"]))
    return whole.select(
        "conv_id", F.col("n_turns").cast("bigint").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("all", lambda w: w["turns"])), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
