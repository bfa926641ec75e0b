"""Chat formatting with typed content parts.

A turn's content is an ordered list of parts: text, image, audio or document.  A
visitor renders each part by its kind: text is escaped, every other kind becomes a
placeholder, and the attachment it stands for is recorded with the number of tokens
the placeholder expands to.

    <|turn|>role
    content<|end|>

Control strings inside a text get a backslash after their first character (and lose
it again on reading), so no text can open or close a turn, and every text comes back
as it was.  Neighbouring texts of a turn are joined before they are escaped, so that they cannot make a control
string together.  Loss spans are zero-based, end-exclusive code points of the content of
trained roles.

Null texts, roles and part lists are empty.  Turns come in the order of turn, role
and content; repeated rows stay repeated.  A null conv_id is a conversation of its
own.  An unknown kind of part is kept as a placeholder of that name with no tokens.
Texts of any length are formatted whole.  Other columns, whatever their names, are not read.
An empty table gives no rows.  A conversation is one result row, so its turns meet in
one group; nothing else is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END, BREAK = "<|turn|>", "<|end|>\n", "<|nl|>"
#: What follows the first character of a control string: ours and those of common templates.
_REST = r"(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

IMAGE_PATCH, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 28, 25, 600


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_REST}", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_REST}", "$1$2")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.named_struct(
        F.lit("kind"), F.lit("text"), F.lit("text"), text, F.lit("ref"), F.lit(None).cast("string"),
        F.lit("width"), F.lit(None).cast("int"), F.lit("height"), F.lit(None).cast("int"),
        F.lit("seconds"), F.lit(None).cast("double"), F.lit("pages"), F.lit(None).cast("int"),
    ))


def _number(value: Column) -> Column:
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))


def _kind(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text"))


def _rendered(parts: Column) -> Column:
    """The parts inside the formatted text: runs of neighbouring texts are joined, then escaped; others are placeholders."""

    def visit(state: Column, part: Column) -> Column:
        name = F.regexp_replace(_kind(part), "[^A-Za-z0-9_]", "_")
        text = F.struct(state["done"].alias("done"), F.concat(state["open"], F.coalesce(part["text"], F.lit(""))).alias("open"))
        other = F.struct(F.concat(state["done"], escape(state["open"]), F.lit("<|"), name, F.lit("|>")).alias("done"), F.lit("").alias("open"))
        return F.when(_kind(part) == "text", text).otherwise(other)

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))
    return F.aggregate(parts, start, visit, lambda state: F.concat(state["done"], escape(state["open"])))


def _tokens(part: Column) -> Column:
    """Tokens a part stands for: words of a text, patches of an image, steps of audio, pages of a document."""
    kind = _kind(part)
    patches = lambda side: F.ceil(_number(part[side]) / IMAGE_PATCH)
    return (
        F.when(kind == "text", F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
        .when(kind == "image", patches("width") * patches("height"))
        .when(kind == "audio", F.ceil(_number(part["seconds"]) * AUDIO_TOKENS_A_SECOND))
        .when(kind == "document", _number(part["pages"]).cast("long") * TOKENS_A_PAGE)
        .otherwise(F.lit(0).cast("long"))
    )


def format_chat(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, turn, role, parts`` to one row per conversation.

    Returns ``conv_id, n_turns, formatted, loss_spans`` (array of start, end),
    ``attachments`` (array of turn, part, kind, ref, tokens in order) and ``n_tokens``.
    """
    role = F.coalesce("role", F.lit(""))
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    shown = turns.select(
        "conv_id", "turn", role.alias("role"),
        _rendered(parts).alias("content"),
        F.filter(
            F.transform(parts, lambda p, i: F.struct(i.alias("part"), _kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))),
            lambda a: a["kind"] != "text",
        ).alias("files"),
        F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + _tokens(p)).alias("tokens"),
    ).select(
        "*", F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(BREAK)), F.lit("\n")).alias("head")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.concat("head", "content", F.lit(END))
    placed = shown.select(
        "*", whole.alias("whole"),
        F.coalesce(F.sum(F.char_length(whole).cast("long")).over(order), F.lit(0).cast("long")).alias("at"),
    )
    rows = F.array_sort(F.collect_list(F.struct("at", "turn", "role", "head", "content", "whole", "files", "tokens")))
    grouped = placed.groupBy("conv_id").agg(rows.alias("rows"))
    start = lambda r: r["at"] + F.char_length(r["head"])
    return grouped.select(
        "conv_id",
        F.size("rows").cast("long").alias("n_turns"),
        F.array_join(F.transform("rows", lambda r: r["whole"]), "").alias("formatted"),
        F.transform(
            F.filter("rows", lambda r: r["role"].isin(*trained)),
            lambda r: F.struct(start(r).alias("start"), (start(r) + F.char_length(r["content"])).alias("end")),
        ).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: F.transform(r["files"], lambda f: F.struct(
            r["turn"].alias("turn"), f["part"].alias("part"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + r["tokens"]).alias("n_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text (placeholders stay)."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p, i: i > 0)
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.replace(head(p), F.lit(BREAK), F.lit("\n"))).alias("role"),
        unescape(F.substr(p, F.char_length(head(p)) + 2, F.char_length(p) - F.char_length(head(p)) - 1 - len(END))).alias("text"),
    ))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def digests(chats: DataFrame) -> DataFrame:
    """What a formatted conversation says when it is read back, as digests."""
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "")
    return chats.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"), "n_tokens",
    )
