"""Chat formatting with a grammar round trip, in DataFrame operations only.

A conversation is written turn by turn, a turn that holds a control string escaped. The written text is parsed
again by a deterministic grammar and the recovered turns are compared with the source; where they differ, every
turn is escaped, and the comparison holds. So no control string stands in a written text but where the grammar
puts it. The loss mask covers the texts of the assistant's turns.

Grammar (``role`` and ``text`` stand for a turn's content)::

    conversation = turn*
    turn         = "[INST]" role mark text "[/INST]"      not trained on
                 | "<s>"    role mark text "</s>"         trained on
    mark         = "[:]" raw content | "[=]" escaped content

In escaped content ``&``, ``<`` and ``[`` are written ``&amp;``, ``&lt;`` and ``&lb;``, so that none of the control
strings, which all begin with ``<`` or ``[``, can occur in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, LOSS_OPEN, LOSS_CLOSE, RAW, ESCAPED = "[INST]", "[/INST]", "<s>", "</s>", "[:]", "[=]"
CONTROLS = (OPEN, CLOSE, LOSS_OPEN, LOSS_CLOSE, RAW, ESCAPED)
#: One turn of either kind, closed by the end of its kind; the nearest marks and ends count. Groups: opening, role, mark, text, twice.
TURN = r"(?s)(\[INST\])(.*?)(\[[:=]\])(.*?)\[/INST\]|(<s>)(.*?)(\[[:=]\])(.*?)</s>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lb;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lb;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def conflicts(c: Column) -> Column:
    """Whether the content holds a control string, so that raw writing could be misread."""
    found = F.lit(False)
    for s in CONTROLS:
        found = found | F.contains(c, F.lit(s))
    return found


def write_turn(role: Column, text: Column, escaped: Column, loss: Column) -> Column:
    body = F.when(escaped, F.concat(escape(role), F.lit(ESCAPED), escape(text))).otherwise(F.concat(role, F.lit(RAW), text))
    return F.when(loss, F.concat(F.lit(LOSS_OPEN), body, F.lit(LOSS_CLOSE))).otherwise(F.concat(F.lit(OPEN), body, F.lit(CLOSE)))


def parse(formatted: Column) -> Column:
    """The turns of a written conversation: an array of (loss, role, text, written), ``written`` being the text as it stands."""
    found = lambda i: F.regexp_extract_all(formatted, F.lit(TURN), F.lit(i))
    part = lambda i: F.zip_with(found(i), found(i + 4), lambda a, b: F.concat(a, b))  # noqa: E731  (one of the two is empty)
    zipped = F.arrays_zip(part(1).alias("open"), part(2).alias("role"), part(3).alias("mark"), part(4).alias("text"))

    def turn(t: Column) -> Column:
        esc = t["mark"] == ESCAPED
        plain = lambda c: F.when(esc, unescape(c)).otherwise(c)
        return F.struct((t["open"] == LOSS_OPEN).alias("loss"), plain(t["role"]).alias("role"), plain(t["text"]).alias("text"), t["role"].alias("written_role"), t["text"].alias("written"))

    return F.transform(zipped, turn)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, turns, loss_spans, escaped``: one row a conversation, its turns in order.

    ``formatted`` is the written conversation, ``turns`` what the parser reads from it, ``loss_spans`` the
    (start, length) in code points, from 1, of what is trained on, and ``escaped`` the number of
    escaped turns. Turns with control strings are escaped; where the parser does not give the source back
    all the same, all turns are. Escaped content has no control string, so the last writing always reads back.

    A conversation is one record and is put together in one place; conversations are spread by their
    key. Null roles and texts count as empty; a null turn number comes first, equal numbers are
    ordered by role and text, repeated rows are turns of their own; rows with a null ``conv_id`` make
    one conversation. Other columns are not read. An empty table gives an empty result.
    """
    src = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    chats = src.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("source"))

    def written(escaped) -> Column:  # noqa: ANN001
        return F.array_join(F.transform("source", lambda t: write_turn(t["role"], t["text"], escaped(t), t["role"] == loss_role)), "")

    plain = lambda turns: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["role"] == loss_role).alias("loss")))
    read = lambda turns: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["loss"].alias("loss")))
    clash = lambda t: conflicts(t["role"]) | conflicts(t["text"])
    same = lambda formatted: F.to_json(plain(F.col("source"))) == F.to_json(read(parse(formatted)))
    # the second writing is only computed where the first does not read back
    step = chats.withColumn("some", written(clash)).withColumn("some_ok", same(F.col("some")))
    formatted = F.when(F.col("some_ok"), F.col("some")).otherwise(written(lambda t: F.lit(True)))
    n_escaped = F.when(F.col("some_ok"), F.size(F.filter("source", clash))).otherwise(F.size("source"))
    out = step.select("conv_id", formatted.alias("formatted"), n_escaped.alias("escaped")).withColumn("turns", parse(F.col("formatted")))

    def advance(state: Column, t: Column) -> Column:
        head = F.when(t["loss"], F.lit(len(LOSS_OPEN))).otherwise(F.lit(len(OPEN))) + F.length(t["written_role"]) + F.lit(len(RAW))
        start, size = state["at"] + head, F.length(t["written"])
        span = F.struct(start.alias("start"), size.alias("length"))
        return F.struct(
            (start + size + F.when(t["loss"], F.lit(len(LOSS_CLOSE))).otherwise(F.lit(len(CLOSE)))).alias("at"),
            F.when(t["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return out.withColumn("loss_spans", F.aggregate("turns", begin, advance, lambda s: s["spans"])).select("conv_id", "formatted", "turns", "loss_spans", "escaped")


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, cut out of the formatted text by its spans; escaped turns are read back."""
    cut = F.transform(spans, lambda s: F.struct(F.substring(formatted, s["start"] - len(RAW), F.lit(len(RAW))).alias("mark"), F.substring(formatted, s["start"], s["length"]).alias("text")))
    return F.array_join(F.transform(cut, lambda t: F.when(t["mark"] == ESCAPED, unescape(t["text"])).otherwise(t["text"])), "")
