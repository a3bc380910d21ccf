"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of conversations: streamed deltas, edits (replace the message's text), regenerations (drop what the
message said so far) and deletions. Logs are partitioned by conversation, sorted by sequence and folded into final
messages, and the messages are rendered by a template with a loss mask over assistant texts.

The fold is associative: a stretch of a message's log is (does it reset the message, text since the last reset), so
long logs fold by stretches of sequence numbers first and then over stretches. Rendering works the same way: turns are
rendered and joined by stretches of a conversation, then the stretches are joined. No task gets a hot conversation or
message row by row; only its rendered stretches meet in one row, since that row is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The template's control strings: <turn>role<says>text</turn>, one turn a line.
TURN, SAYS, END = "<turn>", "<says>", "</turn>"
ASSISTANT = "assistant"
#: Events of a message, or turns of a conversation, that one group gathers at the first level.
STRETCH = 256


def escape(c: Column) -> Column:
    """Doubles backslashes and puts one behind the < of each control string, so no control string is left."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), r"<(turn>|says>|/turn>)", r"<\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, seq, role, text) of events (conv_id, message_id, seq, kind, role, text).

    kind: ``delta`` appends its text; ``edit`` replaces all before it; ``regenerate`` drops all before it; ``delete``
    drops the message unless later events write it again. Other kinds are ignored. seq orders the events of a message;
    at ties resets come before deltas, then texts decide. A message stands in its conversation where its first event
    does and has the role of the first event that names one. Null texts are empty; null ids are ids of their own.
    An empty table gives no messages; other columns are ignored, so none clashes. A text of any length is joined whole.
    """
    resets = F.col("kind").isin("edit", "regenerate", "delete")
    known = events.filter(resets | (F.col("kind") == "delta"))
    one = F.struct(
        F.col("seq"), F.when(resets, 0).otherwise(1).alias("order"),
        F.when(F.col("kind").isin("delta", "edit"), F.coalesce("text", F.lit(""))).otherwise(F.lit("")).alias("text"),
        (F.col("kind") == "delete").alias("deleted"),
    )

    def folded(log: Column) -> Column:
        """What a sorted log comes to: from its last reset on, its texts joined; (reset, deleted, text)."""
        last = F.array_max(F.transform(log, lambda e, i: F.when(e["order"] == 0, i).otherwise(-1)))
        live = F.slice(log, F.greatest(last, F.lit(0)) + 1, F.size(log))
        text = F.array_join(F.transform(live, lambda e: e["text"]), "")
        gone = (last >= 0) & F.element_at(live, 1)["deleted"] & (F.size(live) == 1)
        return F.struct((last >= 0).alias("reset"), gone.alias("deleted"), text.alias("text"))

    stretch = F.floor(F.coalesce(F.col("seq"), F.lit(0)) / STRETCH)
    parts = known.withColumn("_part", stretch).groupBy("conv_id", "message_id", "_part").agg(
        folded(F.array_sort(F.collect_list(one))).alias("f"), F.min("seq").alias("seq"), F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("named"),
    )
    again = F.struct(F.col("_part").alias("seq"), F.when(F.col("f.reset"), 0).otherwise(1).alias("order"), F.col("f.text").alias("text"), F.col("f.deleted").alias("deleted"))
    whole = parts.groupBy("conv_id", "message_id").agg(
        folded(F.array_sort(F.collect_list(again))).alias("f"), F.min("seq").alias("seq"), F.min("named")["role"].alias("role"),
    )
    return whole.filter(~F.col("f.deleted")).select("conv_id", "message_id", "seq", "role", F.col("f.text").alias("text"))


def render(messages: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns and loss_mask, an array with (head, loss, tail) of each turn.

    ``formatted`` joins <turn>role<says>text</turn>\\n over the messages by (seq, role, text); role and text are escaped.
    In each turn, ``head`` characters are masked out, the next ``loss`` count for the loss (0 but for assistants), and
    ``tail`` are masked out. A null role or text is an empty one, a null seq comes first, an empty table gives no rows.
    A conversation is one row here, so its text must stay under Spark's 2 GB a value.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    turns = messages.select(
        "conv_id", "seq", "role", "text", F.floor(F.coalesce(F.col("seq"), F.lit(-1)) / stretch).alias("_part"),
        F.concat(F.lit(TURN), role, F.lit(SAYS)).alias("head"), text.alias("body"),
    )
    loss = F.when(F.col("role") == ASSISTANT, F.length("body")).otherwise(0)
    turns = turns.select("conv_id", "_part", F.struct(
        "seq", "role", "text", F.concat("head", "body", F.lit(END + "\n")).alias("shown"),
        F.struct(F.length("head").alias("head"), loss.alias("loss"), (F.length("body") - loss + len(END) + 1).alias("tail")).alias("mask"),
    ).alias("turn"))
    parts = turns.groupBy("conv_id", "_part").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    parts = parts.select("conv_id", F.struct("_part", F.array_join(F.col("t.shown"), "").alias("shown"), F.col("t.mask").alias("mask")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("p"))
    mask = F.flatten(F.col("p.mask"))
    return whole.select("conv_id", F.array_join(F.col("p.shown"), "").alias("formatted"), F.size(mask).cast("long").alias("n_turns"), mask.alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """What ``formatted`` and ``loss_mask`` say: conv_id, turns (role, text, loss_text), formatted; empty texts where they were null or empty, no rows for none."""
    shown = F.filter(F.split("formatted", f"{END}\n"), lambda x: x != "")
    turn = lambda x, i: F.struct(
        unescape(F.substring_index(F.substring(x, F.lit(len(TURN) + 1), F.length(x)), SAYS, 1)).alias("role"),
        unescape(F.substring_index(x, SAYS, -1)).alias("text"),
        unescape(F.substring(x, F.get(F.col("loss_mask"), i)["head"] + 1, F.get(F.col("loss_mask"), i)["loss"])).alias("loss_text"),
    )
    return rendered.select("conv_id", F.transform(shown, turn).alias("turns"), "formatted")


def as_events(conversations: DataFrame) -> DataFrame:
    """The log that a service would have streamed for finished conversations (conv_id, turn, role, text).

    A user's message is typed, its first half edited, and then continued. Any other has a draft that a regeneration
    drops, then its text in two deltas. Each row is a message of its own, so repeated rows stay. Null texts are empty,
    a null turn comes first, and an empty table gives no events.
    """
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text.alias("text"), half.alias("half"), F.monotonically_increasing_id().alias("n"))
    event = lambda at, kind, text: F.struct(F.lit(at).alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
    rest = F.col("text").substr(F.col("half") + 1, F.length("text"))
    first = F.col("text").substr(F.lit(1), F.col("half"))
    says = [event(2, "delta", first), event(3, "delta", rest)]
    typed = [event(0, "delta", F.lit("(typing)")), event(1, "edit", F.lit("(edited)")), event(2, "edit", first), event(3, "delta", rest)]
    draft = [event(0, "delta", F.lit("(draft)")), event(1, "regenerate", F.lit(""))]
    log = F.when(F.col("role") == "user", F.array(*typed)).otherwise(F.array(*draft, *says))
    return rows.select("conv_id", "turn", "role", "n", F.explode(log).alias("e")).select(
        "conv_id", F.struct("turn", "n").alias("message_id"), (F.coalesce("turn", F.lit(-1)) * 4 + F.col("e.step")).alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"),
    )


def op5_chat_events(spark, sf_dir):
    odd = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(odd).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
    messages = fold(as_events(rows)).withColumn("seq", F.floor(F.col("seq") / 4))
    back = read_back(render(messages))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss_text"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op5_chat_events": op5_chat_events}

ORACLE_SQL = {
    "op5_chat_events": r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM documents_free
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '<(turn>|says>|/turn>)', '<\\\1', 'g') AS shown, regexp_replace(replace(role, '\', '\\'), '<(turn>|says>|/turn>)', '<\\\1', 'g') AS who FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(6 + length(who) + 6 + length(shown) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""".replace("documents_free", "conversations")
}
