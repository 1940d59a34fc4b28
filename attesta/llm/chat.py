r"""Chat formatting in budgeted windows. DataFrame operations only.

A turn is written as `[INST] role [/INST]text</s>`. Control strings inside a
role or a text lose their first character to an escape, so the template's own
are the only ones: `\` becomes `\\`, `</s>` becomes `\l/s>` and `[INST]`
becomes `\bINST]`; `unescape` reverses it exactly.

Prefix sums of turn tokens choose the windows. A window that begins at a turn
repeats the system turn and as many of the turns before it as the history
allows; where it begins with a target, the turn before is repeated wherever
both fit. Repeated targets are masked. What is left of the budget is its room,
and it takes turns for as long as their prefix sums lie within it; the next
window begins at the first that does not fit. Prefix sums are two-level, over
blocks of turns, and windows also begin anew with each segment of turns, so
that a long conversation is never one task; only numbers, no texts, are
gathered to follow the windows of a segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import materialize, salted_join

OPEN, CLOSE, END = "[INST] ", " [/INST]", "</s>"
#: Tokens of a window and of its repeated history; new turns have a quarter of a window at least, however long the system turn is.
BUDGET, HISTORY, LEAST_SHARE = 4096, 512, 4
#: Tokens that the template adds to a turn.
TURN_OVERHEAD = 8
#: Turn numbers to a block of the two-level prefix sums, and turns to a segment whose windows are followed together.
BLOCK, SEGMENT = 1024, 4096
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    t = F.regexp_replace(t, r"<(?=/?s>|</?SYS>>)", r"\\l")
    return F.regexp_replace(t, r"\[(?=/?INST\])", r"\\b")


def unescape(text: Column) -> Column:
    """The inverse of escape: `\\\\`, `\\l` and `\\b` are read from left to right."""
    # a doubled backslash is set aside as a form that escape never makes, and restored last
    t = F.replace(text, F.lit("\\\\"), F.lit("\\0"))
    t = F.replace(F.replace(t, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(t, F.lit("\\0"), F.lit("\\"))


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn: a quarter of its UTF-8 bytes, rounded up, and the template's share."""
    return (F.ceil(F.octet_length(text) / F.lit(4)) + F.lit(TURN_OVERHEAD)).cast("long")


def chat_windows(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = BUDGET, history: int = HISTORY, tokens=turn_tokens, segment: int = SEGMENT,
) -> DataFrame:
    """One row per window: conv_id, window, text, repeated, loss (array of start, length), tokens.

    Turns are ordered by turn, role and text; repeated rows are turns of their
    own, a null role or text is an empty one, and a null conv_id is a
    conversation of its own. `window` is the place of a window's first new turn
    in its conversation, from 0. The history is at most as many tokens and turns.
    `repeated` counts the leading turns of a window that stand for context only:
    its system turn (the conversation's first, of any length) and the history.
    `loss` has the code-point spans of the texts of new assistant turns. A
    window is over budget only where one turn, or the system turn with it, is
    longer than the room that is left. An empty table gives no rows; other
    columns are ignored.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("raw")
    )
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK)), F.lit(-1))).withColumn("tok", tokens(F.col("raw"))).withColumn("key", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("n")))
    # text-free sums by block first, so that a conversation's prefix sums are many tasks
    blocks = rows.groupBy("key", "block").agg(F.sum("tok").alias("tok"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("key", "block", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}0") for c in ("tok", "n")])
    within = Window.partitionBy("key", "block").orderBy("turn", "role", "raw").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.col(f"{c}0") + F.coalesce(F.sum(c).over(within), F.lit(0))
    placed = rows.join(base, ["key", "block"]).withColumn("n", F.lit(1).cast("long")).withColumn("start", so_far("tok")).withColumn("at", so_far("n"))
    placed, _ = materialize(placed.select("key", "conv", "at", "role", "raw", "tok", "start"), "turns")
    first = placed.where(F.col("role") == "system").groupBy("key").agg(F.min(F.struct("at", "conv", "role", "raw", "tok")).alias("s")).select("key", "s.*")
    windows = _windows(placed, first, budget, history, segment)
    turn = ["conv", "at", "role", "raw", "tok"]
    # a window's own turns (kind 2) and its history (1); the first system turn goes to every window after its own (0)
    places = windows.select("key", "window", "system_at", F.explode(F.sequence("context", F.col("end") - 1)).alias("at"))
    places = places.where((F.col("at") >= F.col("window")) | ~F.col("at").eqNullSafe(F.col("system_at")))
    lines = places.join(placed, ["key", "at"]).select("key", "window", F.when(F.col("at") >= F.col("window"), 2).otherwise(1).alias("kind"), *turn)
    again = salted_join(windows.where(F.col("system_at") < F.col("window")).select("key", "window"), first, ["key"], F.col("window"))
    parts = lines.unionByName(again.select("key", "window", F.lit(0).alias("kind"), *turn)).select(
        "key", "window", "kind", "conv", "at", "tok", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)).alias("head"), escape(F.col("raw")).alias("body"),
        ((F.col("kind") == 2) & (F.col("role") == TARGET_ROLE)).alias("target"),
    )
    order = Window.partitionBy("key", "window").orderBy("kind", "at").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("head") + F.length("body") + F.lit(len(END))
    parts = parts.withColumn("from", F.coalesce(F.sum(length).over(order), F.lit(0)) + F.length("head"))
    item = F.struct("kind", "at", F.concat("head", "body", F.lit(END)).alias("text"), F.struct(F.col("from").alias("start"), F.length("body").cast("long").alias("length")).alias("span"), "target")
    whole = parts.groupBy("key", "window").agg(F.first("conv").alias("conv"), F.sort_array(F.collect_list(item)).alias("items"), F.sum("tok").alias("tokens"))
    return whole.select(
        F.col("conv").alias(conv_col), "window", F.array_join(F.transform("items", lambda x: x["text"]), "").alias("text"),
        F.size(F.filter("items", lambda x: x["kind"] < 2)).alias("repeated"), F.transform(F.filter("items", lambda x: x["target"]), lambda x: x["span"]).alias("loss"), "tokens",
    )


def _windows(placed: DataFrame, first: DataFrame, budget: int, history: int, segment: int) -> DataFrame:
    """(key, window, context, end, system_at): first new turn, first repeated turn and the turn behind the last, of each window.

    A segment's numbers come with those of the turns that its first window may
    repeat, and one fold follows its windows: a turn within the limit of the
    window joins it, another begins the next, whose limit follows from its context.
    """
    at, room_least = F.col("at"), F.lit(budget // LEAST_SHARE)
    own = F.floor(at / F.lit(segment)).cast("long")
    both = F.when(F.pmod(at, F.lit(segment)) >= segment - history, F.array(own, own + 1)).otherwise(F.array(own))
    numbers = placed.select("key", F.explode(both).alias("segment"), F.struct(at, "start", "tok", (F.col("role") == TARGET_ROLE).alias("target")).alias("t"))
    turns = numbers.groupBy("key", "segment").agg(F.sort_array(F.collect_list("t")).alias("t"), F.max("t.at").alias("last"))
    turns = turns.where(F.col("last") >= F.col("segment") * segment)  # else only the history of a segment that has no turns
    held = first.select("key", F.col("at").alias("system_at"), F.col("tok").alias("system_tok"))
    turns = salted_join(turns, held, ["key"], F.col("segment"), how="left")

    def begun(windows: Column, x: Column) -> Column:
        """The state after a window begins at x."""
        room = F.lit(budget) - F.when(F.col("system_at") < x["at"], F.col("system_tok")).otherwise(F.lit(0))
        spare = room - x["tok"]
        index = (x["at"] - F.element_at("t", 1)["at"]).cast("int")
        before = F.slice("t", F.greatest(F.lit(1), index + 1 - history), F.least(index, F.lit(history)))
        prompt = lambda c: x["target"] & (c["at"] == x["at"] - 1) & (c["tok"] <= spare)
        repeated = F.filter(before, lambda c: (x["start"] - c["start"] <= F.least(F.lit(history), spare)) | prompt(c))
        context = F.array_min(F.concat(repeated, F.array(x)))
        new = F.transform(F.array(context), lambda c: F.struct(
            F.concat(windows, F.array(F.struct(x["at"].alias("window"), c["at"].alias("context")))).alias("windows"), (c["start"] + F.greatest(room, room_least)).alias("limit")
        ))
        return new[0]

    none = F.from_json(F.lit("[]"), "array<struct<window: long, context: long>>")
    start = F.struct(none.alias("windows"), F.lit(-1).cast("long").alias("limit"))
    lead = F.col("segment") * segment
    step = lambda s, x: F.when((x["at"] < lead) | (x["start"] + x["tok"] <= s["limit"]), s).otherwise(begun(s["windows"], x))
    chain = turns.select("key", "system_at", F.aggregate("t", start, step)["windows"].alias("w"), F.col("last"))
    ended = F.transform("w", lambda x, i: F.struct(x["window"].alias("window"), x["context"].alias("context"), F.coalesce(F.get("w", i + 1)["window"], F.col("last") + 1).alias("end")))
    return chain.select("key", "system_at", F.inline(ended))


def read_windows(windows: DataFrame) -> DataFrame:
    """Add to chat_windows rows what they say: turns (array of role, text), without the repeated, and loss_texts (array).

    Every window has turns, of which any may be empty; a window without targets
    has no loss texts. No windows give no rows.
    """
    parts = F.slice(F.split("text", F.lit(END)), F.col("repeated") + 1, F.greatest(F.size(F.split("text", F.lit(END))) - 1 - F.col("repeated"), F.lit(0)))
    turns = F.transform(parts, lambda p: F.struct(
        unescape(F.substring(p, F.lit(len(OPEN) + 1), F.instr(p, CLOSE) - F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.substring(p, F.instr(p, CLOSE) + F.lit(len(CLOSE)), F.length(p))).alias("text"),
    ))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.withColumn("turns", turns).withColumn("loss_texts", loss)


def conversation_digests(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    A digest needs the whole conversation as one string, so this row is as
    large as its conversation; the windows themselves are bounded. A null
    conv_id is a conversation; no windows give no rows.
    """
    read = read_windows(windows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = read.select(conv_col, "window", F.size("turns").alias("n"), said.alias("said"), F.array_join("loss_texts", "").alias("loss"), F.length("text").alias("chars"))
    joined = per.groupBy(conv_col).agg(
        F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows")
    )
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return joined.select(
        conv_col, "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
