"""Chat formatting with Spark expressions only.

Template: ``<s>``, then blocks. A block is one or more turns in a row of the same role: a mark that names the role, the turns' texts
with ``[NEXT]`` between them, and the role's closing mark (``MARKS``; a role that has no marks of its own is written as
``[ROLE]name[AS]...[/ROLE]``). A control string inside a text or a role gets a backslash after its first character, and one that
already has backslashes there one more, so escaping is reversible and no control string is left in a text.

A conversation is formatted in two steps: turns of a stretch of ``STRETCH`` turn numbers are collected, sorted and folded into
blocks by an array aggregate; a conversation's stretches are then joined, a block going on where two stretches meet in one role. So
a conversation that holds a large share of all rows is spread over tasks until only its stretches' strings are left. The formatted
conversation is one string, which Spark bounds at 2 GB.

Null texts and null roles count as empty. Rows of a conversation are ordered by turn (null first), then role, then text; repeated
rows are turns of their own. A null conv_id is a conversation. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRETCH = 64
START, NEXT = "<s>", "[NEXT]"
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
OTHER, NAMED, OTHER_END = "[ROLE]", "[AS]", "[/ROLE]"
#: The role whose texts are trained on.
TRAINED = "assistant"
#: What a control string may go on with after its first character.
_REST = r"/?s>|/?(?:SYS|INST|ROLE)\]|(?:OUT|AS|NEXT)\]"
ESCAPED, UNESCAPED = rf"([<\[])(\\*)({_REST})", rf"([<\[])\\(\\*)({_REST})"
_OPENS = r"(?=\[(?:SYS|INST|OUT|ROLE)\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPED, "$1$2$3")


def _by_role(role: Column, k: int, other: Column) -> Column:
    out = F
    for name, marks in MARKS.items():
        out = out.when(role == name, F.lit(marks[k]))
    return out.otherwise(other)


def _open(role: Column) -> Column:
    return _by_role(role, 0, F.concat(F.lit(OTHER), escape(role), F.lit(NAMED)))


def _close(role: Column) -> Column:
    return _by_role(role, 1, F.lit(OTHER_END))


def _merge(blocks: Column, turn: Column) -> Column:
    """Adds a turn to the last block if that has its role, else as a block of its own."""
    last = F.try_element_at(blocks, F.lit(-1))
    longer = F.struct(turn.role.alias("role"), F.array_append(last.texts, turn.text).alias("texts"))
    fresh = F.struct(turn.role.alias("role"), F.array(turn.text).alias("texts"))
    return F.when(last.role == turn.role, F.array_append(F.slice(blocks, F.lit(1), F.size(blocks) - 1), longer)).otherwise(F.array_append(blocks, fresh))


def _joined(parts: Column, first, last, inner) -> Column:
    """The parts' inner strings with the marks that belong between two neighbours."""

    def one(part: Column, k: Column) -> Column:
        before = last(F.get(parts, k - 1))
        between = F.when(k == 0, "").when(before == first(part), NEXT).otherwise(F.concat(_close(before), _open(first(part))))
        return F.concat(between, inner(part))

    return F.array_join(F.transform(parts, one), "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns``: conv_id, turn, role, text. Returns conv_id and formatted."""
    rows = turns.select(
        "conv_id", "turn", F.floor(F.col("turn") / STRETCH).alias("stretch"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    collected = rows.groupBy("conv_id", "stretch").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    written = collected.withColumn("turns", F.transform("turns", lambda t: F.struct(t.role.alias("role"), escape(t.text).alias("text"))))
    nothing = F.array().cast("array<struct<role:string,texts:array<string>>>")
    blocks = written.select("conv_id", "stretch", F.aggregate("turns", nothing, _merge).alias("blocks"))
    role = lambda b: b.role
    parts = blocks.select(
        "conv_id", "stretch", F.col("blocks")[0].role.alias("first"), F.element_at("blocks", -1).role.alias("last"),
        _joined(F.col("blocks"), role, role, lambda b: F.array_join(b.texts, NEXT)).alias("inner"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("stretch", "first", "last", "inner"))).alias("parts"))
    body = _joined(F.col("parts"), lambda p: p["first"], lambda p: p["last"], lambda p: p["inner"])
    return whole.select(
        "conv_id", F.concat(F.lit(START), _open(F.col("parts")[0]["first"]), body, _close(F.element_at("parts", -1)["last"])).alias("formatted")
    )


def _blocks(formatted: Column) -> Column:
    """The blocks of a formatted conversation: opening mark, role, texts as written."""
    pieces = F.filter(F.split(F.substr(formatted, F.lit(len(START) + 1)), _OPENS, -1), lambda b: b != "")
    opened = F.transform(pieces, lambda b: F.struct(b.alias("block"), F.regexp_extract(b, r"^(\[(?:SYS|INST|OUT)\]|\[ROLE\][\s\S]*?\[AS\])", 1).alias("open")))

    def named(b: Column) -> Column:
        role = F
        for name, marks in MARKS.items():
            role = role.when(b.open == marks[0], F.lit(name))
        name = F.substr(b.open, F.lit(len(OTHER) + 1), F.length(b.open) - len(OTHER) - len(NAMED))
        return F.struct(b.block.alias("block"), b.open.alias("open"), role.otherwise(unescape(name)).alias("role"))

    def split(b: Column) -> Column:
        body = F.substr(b.block, F.length(b.open) + 1, F.length(b.block) - F.length(b.open) - F.length(_close(b.role)))
        return F.struct(b.open.alias("open"), b.role.alias("role"), F.split(body, r"\[NEXT\]", -1).alias("texts"))

    return F.transform(F.transform(opened, named), split)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text, loss), texts unescaped; ``loss`` marks what is trained on."""

    def turns(b: Column) -> Column:
        return F.transform(b.texts, lambda t: F.struct(b.role.alias("role"), unescape(t).alias("text"), (b.role == TRAINED).alias("loss")))

    return F.flatten(F.transform(_blocks(formatted), turns))


def loss_spans(formatted: Column) -> Column:
    """Where in a formatted conversation the texts that are trained on stand: array of (start, end) in code points, end exclusive,
    a span for each turn."""
    long = lambda c: c.cast("long")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def turn(acc: Column, text: Column) -> Column:
        end = acc.at + F.length(text)
        return F.struct(long(end + len(NEXT)).alias("at"), F.array_append(acc.spans, F.struct(long(acc.at).alias("start"), long(end).alias("end"))).alias("spans"))

    def block(acc: Column, b: Column) -> Column:
        first = F.struct(long(acc.at + F.length(b.open)).alias("at"), none.alias("spans"))
        done = F.aggregate(b.texts, first, turn)
        return F.struct(
            long(done.at - len(NEXT) + F.length(_close(b.role))).alias("at"),
            F.when(b.role == TRAINED, F.concat(acc.spans, done.spans)).otherwise(acc.spans).alias("spans"),
        )

    return F.aggregate(_blocks(formatted), F.struct(F.lit(len(START)).cast("long").alias("at"), none.alias("spans")), block).spans


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    told = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"))
    trained = F.array_join(F.transform(F.filter("turns", lambda t: t.loss), lambda t: t.text), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return told.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), trained.alias("trained"), "formatted_chars").select(
        "conv_id", "n_turns", "turns_sha256", F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars"
    )
