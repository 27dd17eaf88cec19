"""Chat formatting: every assistant turn becomes an example of its own, with all turns before
it as context and that reply alone to be learnt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.session import stage

# Control strings of the template. An example is BEGIN and, per turn,
# OPEN role CLOSE text END.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_BLOCK_BITS = 6
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    r"""A backslash goes behind the first character of what reads as a control string, and of
    what reads as an escaped one: <s> becomes <\s>, <\s> becomes <\\s>."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _blank(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def examples(conversations: DataFrame, learner: str = "assistant") -> DataFrame:
    """conversations (conv_id, turn, role, text) -> one row per example: conv_id, last_turn (the
    number of turns it holds), whole (it holds all), trainable, formatted, loss_start, loss_end
    (the trainable reply in code points of `formatted`, end exclusive; equal if there is none).

    A conversation that does not end with the learner has one more example, of all its turns and
    with nothing to learn, so that no turn is lost; so has one without any learner. Turns are
    ordered by number, null first, equal numbers by role and text. Null role or text reads as
    empty. Rows without conv_id are one conversation. Repeated rows are repeated turns. Empty
    table: no rows. Other columns, whatever their names, are not looked at.

    Each turn is escaped and marked once and gets its place by a range shuffle, so that one
    conversation may fill many tasks. Up to 64 neighbouring turns make a block, joined to one
    text. A block is handed to each later block of its conversation, and what meets there is
    the context of that block's examples: a task holds one example's text at a time, not a
    conversation's examples, and what is moved is a 64th of the turns' texts that the examples hold.
    """
    marked = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE), escape(F.col("text")), F.lit(END))
    given = conversations.select(
        "conv_id", "turn", _blank(F.col("role")).alias("role"), _blank(F.col("text")).alias("text")
    )
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role"]
    begins = F.substring("text", 1, 32)  # the same order as the text's, for the range alone
    placed = (
        given.repartitionByRange(*order, begins)
        .sortWithinPartitions(*order, "text")
        .select(
            "conv_id", F.monotonically_increasing_id().alias("place"),
            "role", marked.alias("marked"), F.char_length(escape(F.col("text"))).alias("chars"),
        )
    )
    blocks = stage(
        placed.groupBy("conv_id", F.shiftright("place", _BLOCK_BITS).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "role", "marked", "chars"))).alias("turns"))
        .withColumn("size", F.size("turns").cast("long")),
        "chat-blocks",
    )
    one, so_far = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("block")
    numbered = blocks.select("conv_id", "block", "size").select(
        F.col("conv_id").alias("of"), "block", F.row_number().over(so_far).alias("nth"),
        F.count("*").over(one).cast("int").alias("blocks"),
        (F.sum("size").over(so_far) - F.col("size")).alias("before"),
    )
    places = stage(numbered.withColumnRenamed("block", "_block"), "chat-places")
    known = blocks.join(places, (F.col("block") == F.col("_block")) & F.col("conv_id").eqNullSafe(F.col("of")))
    text = F.array_join(F.col("turns.marked"), "")
    later = known.filter("nth < blocks").select(
        "conv_id", F.explode(F.sequence(F.col("nth") + 1, F.col("blocks"))).alias("at"),
        F.struct("nth", text.alias("text")).alias("earlier"),
        F.lit(None).cast(known.schema["turns"].dataType).alias("turns"),
        F.lit(None).cast("long").alias("before"), F.lit(None).cast("boolean").alias("last"),
    )
    own = known.select(
        "conv_id", F.col("nth").alias("at"),
        F.lit(None).cast(later.schema["earlier"].dataType).alias("earlier"),
        "turns", "before", (F.col("nth") == F.col("blocks")).alias("last"),
    )
    met = (
        own.unionByName(later)
        .groupBy("conv_id", "at")
        .agg(
            F.sort_array(F.collect_list("earlier")).alias("earlier"),
            *[F.any_value(c, ignoreNulls=True).alias(c) for c in ("turns", "before", "last")],
        )
    )
    # the numbers of the learner's turns in the block, and of the conversation's last turn whoever has it
    ends = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (F.get(F.col("turns.role"), i - 1) == learner) | (F.col("last") & (i == F.size("turns"))),
    )
    ended = met.select(
        "conv_id", "before", "last", "turns",
        F.array_join(F.col("earlier.text"), "").alias("context"), F.explode(ends).alias("i"),
    )
    trainable = F.get(F.col("turns.role"), F.col("i") - 1) == learner
    made = ended.select(
        "conv_id", (F.col("before") + F.col("i")).cast("int").alias("last_turn"),
        (F.col("last") & (F.col("i") == F.size("turns"))).alias("whole"), trainable.alias("trainable"),
        F.concat(
            F.lit(BEGIN), "context", F.array_join(F.slice(F.col("turns.marked"), 1, F.col("i")), "")
        ).alias("formatted"),
        F.when(trainable, F.get(F.col("turns.chars"), F.col("i") - 1)).otherwise(0).alias("reply"),
    )
    end = F.char_length("formatted") - len(END)
    return made.withColumn("loss_end", end).select(
        "conv_id", "last_turn", "whole", "trainable", "formatted",
        (F.col("loss_end") - F.col("reply")).alias("loss_start"), "loss_end",
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example, array<struct<role, text>>."""
    pieces = F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), END)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, CLOSE, 1)
        body = F.substr(piece, F.char_length(head) + len(CLOSE) + 1)
        return F.struct(
            unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescape(body).alias("text")
        )

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask."""
    return unescape(F.substr(formatted, start + 1, end - start))


def summaries(made: DataFrame) -> DataFrame:
    """Read back from the examples, one row per conversation."""
    said = F.transform(
        F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    read = made.select(
        "conv_id", "last_turn",
        F.when(F.col("whole"), read_turns(F.col("formatted"))).alias("turns"),
        F.char_length("formatted").cast("long").alias("chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("reply"),
    ).select(
        "conv_id", F.struct("last_turn", "reply").alias("reply"), "chars",
        F.size("turns").cast("long").alias("n"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("sha"),
    )
    return (
        read.groupBy("conv_id")
        .agg(
            F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"),
            F.sort_array(F.collect_list("reply")).alias("replies"), F.sum("chars").alias("formatted_chars"),
        )
        .withColumn("loss", F.array_join(F.col("replies.reply"), ""))
        .select(
            "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
        )
    )
