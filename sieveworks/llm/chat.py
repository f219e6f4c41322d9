"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events (conv_id, turn, seq, kind, role, text). Kinds:

* `message` opens a message in its turn,
* `delta` appends text to the message that its turn holds by then,
* `edit` replaces that message's text,
* `regenerate` discards that message's text; later deltas build the new one.

Events are partitioned by (conversation, turn), sorted by (seq, kind, role, text) and folded; the
folded messages are then gathered per conversation in order of turn and rendered. A turn whose first
event is a delta or an edit opens a message by it. A null kind is a `message`, null text and null
role are empty, null seq sorts first. Each `message` row is a message of its own, so repeated rows
repeat. Roles are kept as they stand. A null conv_id is a conversation of its own. One conversation's
rendering is one string by definition and so one row; every earlier step works below that grain.

Template: `<|role|>text<|end|>` and a line break per message. Inside roles and texts, `~` and the
control strings of CONTROLS are written as two-character escapes, so that none of them occurs there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An escape for the escape character, then the control strings, longest first where one holds another.
CONTROLS = (("~", "~0"), ("<|", "~1"), ("</s>", "~2"), ("<s>", "~3"), ("[/INST]", "~4"), ("[INST]", "~5"), ("|>", "~6"))
END = "<|end|>\n"
EVENT_COLUMNS = ("conv_id", "turn", "seq", "kind", "role", "text")


def escape(text: Column) -> Column:
    for plain, coded in CONTROLS:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(CONTROLS):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log: conv_id, turn, part (order inside a turn), role, text."""
    e = events.select(
        "conv_id", "turn", "seq",
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["seq", "kind", "role", "text"]
    turn = Window.partitionBy("conv_id", "turn").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("kind") == "message").cast("int")
    e = e.withColumn("part", F.greatest(F.sum(opens).over(turn), F.lit(1)))
    e = e.withColumn("reset", F.sum((F.col("kind") != "delta").cast("int")).over(turn))
    body = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text"))
    piece = F.struct(*order, body.alias("body"))
    by_reset = e.groupBy("conv_id", "turn", "part", "reset").agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"), F.min(F.struct(*order)).alias("first"), F.max("role").alias("any_role")
    )
    text = F.array_join(F.transform("pieces", lambda p: p["body"]), "")
    role = F.coalesce(F.nullif(F.col("pieces")[0]["role"], F.lit("")), F.col("any_role"))
    by_reset = by_reset.select("conv_id", "turn", "part", "reset", role.alias("role"), text.alias("text"))
    return by_reset.groupBy("conv_id", "turn", "part").agg(
        F.max_by("text", "reset").alias("text"),
        F.coalesce(F.min_by(F.nullif("role", F.lit("")), F.when(F.col("role") != "", F.col("reset"))), F.lit("")).alias("role"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    loss_spans has (at, start, length) of every message in order, in code points from 0: where it begins, and the part
    under the loss mask, which is the escaped text of an assistant message and has length 0 in any other. Places are
    running sums, so that a conversation of any number of turns costs time in proportion.
    """
    m = messages.select("conv_id", "turn", "part", F.col("role"), escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    m = m.withColumn("head", F.concat(F.lit("<|"), F.col("r"), F.lit("|>")))
    m = m.select("conv_id", "turn", "part", F.concat("head", "t", F.lit(END)).alias("shown"), F.length("head").alias("before"), F.length("t").alias("size"), (F.col("role") == "assistant").alias("learned"))
    so_far = Window.partitionBy("conv_id").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = (F.col("before") + F.col("size") + F.lit(len(END))).cast("long")
    m = m.withColumn("at", F.sum(own).over(so_far) - own)
    span = F.struct("at", (F.col("at") + F.col("before")).alias("start"), F.when(F.col("learned"), F.col("size")).otherwise(0).cast("long").alias("length"))
    c = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "part", "shown", span.alias("span")))).alias("entries"))
    return c.select("conv_id", F.array_join(F.transform("entries", lambda x: x["shown"]), "").alias("formatted"), F.transform("entries", lambda x: x["span"]).alias("loss_spans"))


def _shown(formatted: Column) -> Column:
    """The rendered messages without their ends. No text holds an end, as its control strings are escaped."""
    parts = F.split(formatted, r"<\|end\|>\n", -1)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def parse(formatted: Column) -> Column:
    """The messages read back from a rendering: array of (role, text)."""
    return F.transform(
        _shown(formatted),
        lambda x: F.struct(
            unescape(F.substring_index(F.substring(x, 3, 1 << 30), "|>", 1)).alias("role"),
            unescape(F.substring(x, F.instr(x, "|>") + 2, F.lit(1 << 30))).alias("text"),
        ),
    )


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order; each span is cut out of its own message."""
    inside = lambda x, s: unescape(F.substring(x, (s["start"] - s["at"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.zip_with(_shown(formatted), spans, inside), "")


def events_of(rows: DataFrame) -> DataFrame:
    """An event log that folds back to rows (conv_id, turn, role, text), as a chat service would have written it.

    An assistant row is a draft, a regeneration and three deltas; another row in an odd turn is a draft that an edit
    replaces, in an even turn (or none) a message and a delta. Rows of one turn follow each other by role, then text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    n = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(role, text))
    r = rows.select("conv_id", "turn", "role", text.alias("text"), (n * 8).cast("long").alias("n"))
    third = F.floor(F.length("text") / 3).cast("int")
    piece = lambda a, b: F.substring("text", a + 1, b - a)
    end = F.length("text")
    event = lambda i, kind, said: F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), F.when(F.lit(kind == "message"), F.col("role")).alias("role"), said.alias("text"))
    none, zero = F.lit(None).cast("string"), F.lit(0)
    answer = F.array(
        event(0, "message", piece(third, 2 * third)), event(1, "regenerate", none), event(2, "delta", piece(zero, third)), event(3, "delta", piece(third, 2 * third)), event(4, "delta", piece(2 * third, end))
    )
    edited = F.array(event(0, "message", piece(zero, third)), event(1, "edit", F.col("text")))
    typed = F.array(event(0, "message", piece(zero, third)), event(1, "delta", piece(third, end)))
    log = F.when(F.col("role") == "assistant", answer).when(F.col("turn") % 2 == 1, edited).otherwise(typed)
    return r.select("conv_id", "turn", "n", F.explode(log).alias("e")).select("conv_id", "turn", (F.col("n") + F.col("e.i")).alias("seq"), "e.kind", "e.role", "e.text")


def format_chats(events: DataFrame) -> DataFrame:
    """Fold an event log and render every conversation."""
    return render(fold(events))
