"""Chat formatting from an event log: partition by conversation, sort by sequence, fold, render.

An event is (conv_id, seq, msg, role, kind, text): `delta` adds text to message msg, `edit` puts text in place of it and
drops every later message that stood before, `regenerate` empties it and drops later ones likewise. Deltas after an edit
or a regeneration build on it. A message is there if something survived. Deltas fold per message before messages
meet in their conversation, so a long stream is not one task; a conversation itself is one value, as it must be.

Nulls: null text is empty, a null role is the empty role, a null conv_id is a conversation; null seq sorts first. Equal seq
are ordered by kind, then text. Repeated rows are events of their own. An empty log gives an empty result.

The template writes each message as `<s>[INST] role [/INST]text</s>`. Inside roles and texts a backslash is doubled and
every control string gets a backslash after its first character, so none is left whole; unescaping takes them away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, HEADER, TURN_END = "<s>[INST] ", " [/INST]", "</s>"
_CONTROL = r"(<)(?=/?s>)|(\[)(?=/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, role, text."""
    conv = W.partitionBy("conv_id")
    resets = (
        events.filter(F.col("kind") != "delta").groupBy("conv_id", "msg").agg(F.max("seq").alias("at"))
        .withColumn("cut", F.max("at").over(conv.orderBy("msg").rowsBetween(W.unboundedPreceding, W.currentRow)))
    )
    # the last reset of this message or of an earlier one; messages without a reset of their own take the nearest earlier one
    spans = resets.select(F.col("conv_id").alias("c"), F.col("msg").alias("from_msg"), F.lead("msg").over(conv.orderBy("msg")).alias("to_msg"), "cut")
    live = events.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg") >= F.col("from_msg")) & (F.col("to_msg").isNull() | (F.col("msg") < F.col("to_msg"))), "left")
    survives = F.col("cut").isNull() | (F.col("seq") > F.col("cut")) | ((F.col("seq") == F.col("cut")) & (F.col("kind") == "edit") & (F.col("msg") == F.col("from_msg")))
    piece = F.struct("seq", F.when(F.col("kind") == "edit", 0).otherwise(1).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        live.filter(survives & (F.col("kind") != "regenerate")).groupBy("conv_id", "msg")
        .agg(F.max("role").alias("role"), F.array_sort(F.collect_list(piece)).alias("pieces"))
        .select("conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.col("pieces.text"), "").alias("text"))
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, turns: (start, length, in_loss) of every text in formatted, in code points, in order."""
    shaped = messages.select(
        "conv_id", "msg", F.col("role").isin(*loss_roles).alias("in_loss"), escaped(F.col("text")).alias("body"),
        F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(HEADER)).alias("head"),
    ).withColumn("chars", F.char_length("head") + F.char_length("body") + len(TURN_END))
    before = W.partitionBy("conv_id").orderBy("msg").rowsBetween(W.unboundedPreceding, -1)
    placed = shaped.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0)) + F.char_length("head"))
    turn = F.struct("msg", F.concat("head", "body", F.lit(TURN_END)).alias("part"), F.col("start").cast("long").alias("start"), F.char_length("body").cast("long").alias("length"), "in_loss")
    return (
        placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
        .select("conv_id", F.array_join(F.col("t.part"), "").alias("formatted"), F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["in_loss"].alias("in_loss"))).alias("turns"))
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Read rendered conversations back: conv_id, formatted, messages (role, text, in_loss), in_loss from the mask."""
    pieces = F.split("formatted", TURN_END)
    bodies = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    cut = formatted.select("conv_id", "formatted", F.arrays_zip(bodies.alias("piece"), F.col("turns").alias("span")).alias("z"))

    def message(z: Column) -> Column:
        head = F.substring_index(z["piece"], HEADER, 1)
        body = F.substr(z["piece"], F.char_length(head) + len(HEADER) + 1)
        return F.struct(unescaped(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescaped(body).alias("text"), (z["span"]["in_loss"] & (z["span"]["length"] == F.char_length(body))).alias("in_loss"))

    return cut.select("conv_id", "formatted", F.transform("z", message).alias("messages"))


def turn_events(conversations: DataFrame) -> DataFrame:
    """Stored turns as an event log: each turn streamed as two deltas of one message; rows of equal turn stay apart."""
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", number.cast("long").alias("msg"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    deltas = F.array(
        F.struct((F.col("msg") * 2).alias("seq"), F.substr("text", F.lit(1), half).alias("text")),
        F.struct((F.col("msg") * 2 + 1).alias("seq"), F.substr("text", half + 1).alias("text")),
    )
    return rows.select("conv_id", "msg", "role", F.lit("delta").alias("kind"), F.inline(deltas))
