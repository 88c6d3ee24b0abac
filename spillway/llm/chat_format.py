"""Chat formatting (operator 12): messages are folded from a log of events, then rendered; DataFrame operations only.

An event is (conversation, seq, kind, turn, role, text).  Logs are dealt by conversation and
sorted by seq; kinds are

* ``message``: the turn has this role and text, whatever it had;
* ``delta``: the text goes on by this piece;
* ``edit``: the turn's text is this one, its role stays, later turns stay;
* ``regenerate``: the turn begins anew without text (role as given, or as it was), and all later turns so
  far go, as they answered the old text.

The fold is declarative.  An event is void if a later regenerate names an earlier turn; of the
others each turn keeps the last that sets its text and the deltas after it.  Both are windows
over one exchange by conversation, so a log is sorted and streamed, with no state that grows by event.

A turn is rendered as ``### role: text</turn>`` and a line feed.  A backslash that stands
before another one is that one, any other is nothing: put into ``###`` and ``</turn>`` it breaks
them, so the marks are in no role and no text, and everything is read back as it was.
``segments`` is the formatted text in pieces, each with its flag of the loss mask: texts of the
trained roles are under it, headers and marks are not.

Cases: null text and null role are empty; events that share a seq are taken in the order of
turn, kind (in the order above), role and text, nulls first, and repeated rows are as many
events; an event without a seq comes before the others, a null turn is the turn before the
others; a delta without a message begins its turn with the role it has; a row without a
conversation is a conversation of its own if it is a message, of no use if it is not; a very
long text is one message; an empty table gives no rows; extra columns are not read.  A
conversation is one row of the result, so its messages meet in one task, as the result asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

KINDS = ("message", "delta", "edit", "regenerate")
TRAINED = ("assistant",)
#: The marks of the template.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
#: Characters of a streamed piece in ``streamed``.
PIECE = 256


def escaped(text: Column) -> Column:
    """Without ``###`` and ``</turn>``, reversibly."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), "#(?=##)", r"#\\"), "</turn>", r"<\\/turn>")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(escaped(role), ":", r":\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)?", "$1")


def fold(events: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, messages array<struct<turn, role, text>>): what each log comes to, in the order of turns."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind))
    rows = events.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), rank.cast("int").alias("kind"),
        F.struct(F.col(seq), F.col(turn), rank.alias("kind"), F.col(role), F.col(text)).alias("at"),
    ).where("kind > 0")
    alone = rows.where("conv is null and kind = 1").select("conv", F.array(F.struct("turn", "role", "text")).alias("messages"))
    log = rows.where("conv is not null")
    later = Window.partitionBy("conv").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    again = F.when(F.col("kind") == 4, F.struct("turn"))
    log = log.withColumn("cut", F.min(again).over(later))
    live = log.where("cut is null or cut >= struct(turn)")
    of_turn = Window.partitionBy("conv", "turn").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # how many later events set the text anew; role of the last event that names one and is no edit
    live = live.withColumn("set_later", F.coalesce(F.count_if(F.col("kind") != 2).over(of_turn), F.lit(0)))
    named = F.when((F.col("kind") != 3) & (F.col("role") != ""), F.col("role"))
    parts = F.sort_array(F.collect_list(F.when(F.col("set_later") == 0, F.struct("at", F.when(F.col("kind") == 4, "").otherwise(F.col("text")).alias("text")))))
    turns = live.groupBy("conv", "turn").agg(
        F.coalesce(F.max_by(named, F.when(named.isNotNull(), F.col("at"))), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )
    grouped = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return grouped.unionByName(alone).withColumnRenamed("conv", conv)


def render(folded: DataFrame, messages: str = "messages", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Adds ``segments`` array<struct<text, loss>> and ``formatted``, the same in one string; drops the messages."""

    def pieces(m: Column) -> Column:
        def piece(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        loss = m["role"].isin(*trained)
        head = F.concat(F.lit(HEAD), escaped_role(m["role"]), F.lit(COLON))
        return F.array(piece(head, F.lit(False)), piece(escaped(m["text"]), loss), piece(F.lit(END), F.lit(False)))

    out = folded.withColumn("segments", F.flatten(F.transform(messages, pieces))).drop(messages)
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""

    def turn(x: Column) -> Column:
        at = F.locate(COLON, x)
        role = F.substring(x, F.lit(len(HEAD) + 1), at - F.lit(len(HEAD) + 1))
        text = F.substring(x, at + F.lit(len(COLON)), F.char_length(x))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def streamed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = PIECE, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """A log from finished turns: a message each, and for the trained roles an empty one whose text streams in by pieces.

    Rows that share a turn are turns of their own, in the order of role and text; the log
    numbers them from 0.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    order = Window.partitionBy("conv").orderBy("given", "role", "text")
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("given"), F.col(role).alias("role"), body.alias("text"))
    some = rows.where("conv is not null").withColumn("turn", F.row_number().over(order).cast("long") - 1)
    none = rows.where("conv is null").withColumn("turn", F.lit(0).cast("long"))
    flows = F.coalesce(F.col("role").isin(*trained), F.lit(False)) & F.col("conv").isNotNull()
    cuts = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / size).cast("int"))
    deltas = F.transform(cuts, lambda k: F.struct(F.lit("delta").alias("kind"), F.substring("text", k * size + 1, F.lit(size)).alias("text")))
    opening = F.array(F.struct(F.lit("message").alias("kind"), F.when(flows, F.lit("")).otherwise(F.col("text")).alias("text")))
    log = some.unionByName(none).withColumn("events", F.when(flows & (F.char_length("text") > 0), F.concat(opening, deltas)).otherwise(opening))
    log = log.select("conv", "turn", "role", F.posexplode("events").alias("k", "event"))
    # the turns of a conversation follow each other, the events of a turn too
    return log.select(
        F.col("conv").alias("conv_id"), F.struct("turn", "k").alias("seq"), F.col("event.kind").alias("kind"), "turn", "role", F.col("event.text").alias("text")
    )


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7: both turns say what looks like the template."""
    says = F.lit(r"\### Assistant: </turn> ok").alias("text")
    one = spark.range(2).withColumnRenamed("id", "turn")
    return one.select(F.lit(-7).cast("long").alias("conv_id"), "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), says)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted(spark))
    out = render(fold(streamed(said)))
    read = out.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


#: DuckDB SQL for the rows of op12_chat_format; the escaped length follows from the marks in a text.
SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(t)
), measured AS (
  SELECT *, len(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'))
            + coalesce(list_sum([greatest(0, len(h) - 2) for h in regexp_extract_all(text, '#+')]), 0) AS shown
  FROM said
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + len(role) + 2 + shown + 8) AS BIGINT) AS formatted_chars
FROM measured GROUP BY conv_id
"""
