"""Chat formatting with a grammar that can be read back.

Grammar: conversation = turn*, turn = ``[INST]`` role ``[/INST]`` text ``</s>``.  A turn is rendered as it
is, parsed again, and only if the parse differs rendered with escapes: a backslash doubles, and each
control string gets a backslash after its first character.  The parser always removes one backslash
before any character, so both forms read back to the source.  Everything is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (OPEN, MIDDLE, CLOSE):
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Turns (role, text, mask length, raw) of a formatted conversation, in order."""
    closed = F.split(formatted, CLOSE.replace("/", "\\/"))
    pieces = F.slice(closed, 1, F.greatest(F.size(closed) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, MIDDLE)
        role = piece.substr(F.lit(len(OPEN) + 1), at - (len(OPEN) + 1))
        body = piece.substr(at + len(MIDDLE), F.length(piece))
        good = piece.startswith(F.lit(OPEN)) & (at > 0)
        return F.when(good, F.struct(unescape(role).alias("role"), unescape(body).alias("text"), F.length(body).alias("body"), F.length(piece).alias("piece")))

    return F.transform(pieces, turn)


def safe_turn(role: Column, text: Column) -> Column:
    """The plain rendering if it reads back as exactly this turn, else the escaped one."""
    plain = render(role, text)
    back = parse(plain)
    first = F.element_at(back, 1)
    same = (F.size(back) == 1) & plain.endswith(F.lit(CLOSE)) & first.role.eqNullSafe(role) & first.text.eqNullSafe(text)
    return F.when(same, plain).otherwise(render(escape(role), escape(text)))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, mask, turns (read back) and round_trip.

    ``mask`` is the run-length form of the loss mask over ``formatted``: (characters, learned) in order.
    Null role and text count as empty; rows are ordered by turn (null first), then role and text, so
    ties and repeated rows have one result; a null conversation id is a conversation of its own.
    Other columns are ignored.  A conversation is one string, so its rows meet in one place; rows are
    rendered before that, one by one.
    """
    clean = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = clean.select("conv_id", F.struct("turn", "role", "text", safe_turn(F.col("role"), F.col("text")).alias("shown")).alias("row"))
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows")).select(
        "conv_id", F.array_join(F.col("rows.shown"), "").alias("formatted"), F.transform("rows", lambda r: F.struct(r.role.alias("role"), r.text.alias("text"))).alias("source"),
    )
    read = joined.withColumn("parsed", parse(F.col("formatted")))
    head = lambda t: t.piece - t.body
    runs = F.flatten(F.transform("parsed", lambda t: F.array(
        F.struct(head(t).alias("chars"), F.lit(False).alias("learned")), F.struct(t.body.alias("chars"), (t.role == learn).alias("learned")),
        F.struct(F.lit(len(CLOSE)).alias("chars"), F.lit(False).alias("learned")))))
    back = F.transform("parsed", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    return read.select("conv_id", "formatted", runs.alias("mask"), back.alias("turns"), back.eqNullSafe(F.col("source")).alias("round_trip"))
