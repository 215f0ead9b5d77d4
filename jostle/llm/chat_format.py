"""Conversations as one training text each, with a loss mask, by column expressions alone.

The turns of a conversation are collected as structs and sorted; neighbours of one role are merged into a message;
a message is written as

    <|turn|>role<|text|>first text<|part|>second text<|end|>

In roles and texts ``\\`` becomes ``\\\\`` and ``|`` becomes ``\\|``. No text then holds a control string, whatever it
says, and :func:`read_back` gives every turn as it was.

The mask is a list of runs (loss, length in code points) that cover the whole text: control strings and roles, then
a text, and so on. The texts of the role ``assistant`` are the ones with loss.

All steps cost time linear in the conversation: arrays are mapped and joined, never grown turn by turn. A
conversation is one row, so it must fit into 2 GB like any string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescaped(text: Column) -> Column:
    """The inverse: pairs of backslashes are cut out first, so what follows one cannot be misread."""
    pieces = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\|"), F.lit("|"))), "\\")


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = LEARNED,
) -> DataFrame:
    """(``conv_id``, messages, formatted, mask) of every conversation of ``rows``.

    Turns are sorted by turn number (null first), then role and text, so ties have one order; repeated rows are turns of
    their own. A null role or text is empty. Rows without a conversation id are one conversation with a null id.
    Other columns are ignored; no rows give no rows.
    """
    turns = rows.select(
        F.col(conv_id).alias("conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"),
    )
    sorted_ = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns")).withColumn("n", F.size("turns"))
    # Places at which a message begins: the role differs from that of the turn before.
    role_at = lambda i: F.get("turns", i)["role"]
    begins = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    runs_of = lambda at, k: F.slice("turns", at + 1, F.coalesce(F.get("begins", k + 1), F.col("n")) - at)
    messages = F.transform("begins", lambda at, k: F.struct(
        role_at(at).alias("role"), escaped(role_at(at)).alias("shown"), F.transform(runs_of(at, k), lambda t: escaped(t["text"])).alias("texts"),
    ))
    merged = sorted_.withColumn("begins", begins).select("conv", messages.alias("messages"))
    body = F.transform("messages", lambda m: F.concat(
        F.lit(TURN), m["shown"], F.lit(TEXT), F.array_join(m["texts"], PART), F.lit(END)
    ))
    run = lambda loss, length: F.struct(loss.alias("loss"), length.cast("long").alias("length"))
    no, head = F.lit(False), len(TURN) + len(TEXT)
    mask = F.flatten(F.transform("messages", lambda m, k: F.flatten(F.transform(m["texts"], lambda t, j: F.array(
        run(no, F.when(j > 0, F.lit(len(PART))).otherwise(F.length(m["shown"]) + F.when(k > 0, head + len(END)).otherwise(head))),
        run(m["role"] == learned, F.length(t)),
    )))))
    return merged.select(
        F.col("conv").alias(conv_id), F.size("messages").alias("messages"), F.array_join(body, "").alias("formatted"),
        F.concat(mask, F.array(run(no, F.lit(len(END))))).alias("mask"),
    )


def read_back(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(``conv_id``, turns, formatted_chars) from the texts and masks alone; ``turns`` are structs (role, text, loss).

    A mask whose runs do not fit the text fails the job.
    """
    literal = lambda s: f"\\Q{s}\\E"
    blocks = F.slice(F.split("formatted", literal(TURN), -1), 2, F.length("formatted"))
    halves = F.transform("blocks", lambda b: F.split(F.left(b, F.length(b) - len(END)), literal(TEXT), 2))
    parts = F.transform("halves", lambda h: F.transform(
        F.split(F.get(h, F.lit(1)), literal(PART), -1), lambda p: F.struct(F.get(h, F.lit(0)).alias("role"), p.alias("text"))
    ))
    found = formatted.withColumn("blocks", blocks).withColumn("halves", halves).withColumn("parts", F.flatten(parts))
    over = lambda i: F.get("mask", 2 * i + 1)
    fits = F.forall(F.zip_with("parts", F.sequence(F.lit(0), F.size("parts") - 1), lambda p, i: F.length(p["text"]) == over(i)["length"]), lambda ok: F.coalesce(ok, F.lit(False)))
    whole = F.aggregate("mask", F.lit(0).cast("long"), lambda total, r: total + r["length"]) == F.length("formatted")
    turns = F.transform("parts", lambda p, i: F.struct(
        unescaped(p["role"]).alias("role"), unescaped(p["text"]).alias("text"), over(i)["loss"].alias("loss")
    ))
    checked = F.when(fits & whole, turns).otherwise(F.raise_error(F.lit("the mask does not fit the text")))
    return found.select(conv_id, checked.alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Counts and digests of what :func:`read_back` finds, per conversation: its turns, and all text with loss."""
    back = read_back(formatted.select(conv_id, "formatted", "mask"), conv_id)
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("turns", lambda t: F.when(t["loss"], t["text"]).otherwise("")), "")
    read = back.select(
        F.col(conv_id).alias("conv"), F.size("turns").cast("long").alias("n_turns"), written.alias("written"), learned.alias("learned"), "formatted_chars"
    )
    return read.select(
        F.col("conv").alias(conv_id), "n_turns", F.sha2("written", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )
