"""Chat formatting with typed content parts. DataFrame functions only.

A conversation's turns come as rows, each with a list of parts ``struct<kind, text, ref, units>``. A visitor per
kind flattens them in order: text is escaped, and image, audio, document and other parts become numbered placeholders ``<|KIND_N|>`` whose references,
places and expanded token counts are recorded. Turns are joined by the template

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

Inside text a backslash is doubled and ``<|`` becomes ``<\\|``; a kind's ``<`` and ``|`` are written as letters after a backslash; texts that
follow each other are kept apart by ``<|+|>``. So no text, role or kind can make a control string, and :func:`read_back` gives back every
role, text and part exactly. The loss mask is a list of (start, length) spans, in code points, of the contents of assistant turns.

The conversation is the unit of output, hence of grouping: one exchange on conv_id, of which one row is one string. Ordinals, places and lengths
are running sums over its sorted rows, so work grows in proportion to turns and parts.

Defined results: null text is an empty text, and empty texts aren't read back as parts; null role is the empty role; null parts are no parts; a null kind, or a
null part, is a part without a kind, which has a placeholder and an attachment like others and expands to no tokens; kinds of no known unit
expand to none either; turns tied on ``turn`` are ordered by role, then content; repeated rows are turns of their own; null turn numbers
come first; a null conv_id is a conversation; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, APART = "<|im_start|>", "<|im_end|>", "<|+|>"
PART = "struct<kind: string, text: string, ref: string, units: bigint>"
#: Tokens that one unit of a part expands to: an image tile, a second of audio, a document page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role(c: Column) -> Column:
    # a line feed would end the role
    return F.replace(escape(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit("\\n"))


def _unrole(c: Column) -> Column:
    # a single backslash before n is a line feed, a doubled one a backslash
    parts = F.transform(F.split(c, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.replace(F.array_join(parts, "\\"), F.lit("<\\|"), F.lit("<|"))


def _kind(c: Column) -> Column:
    escaped = c
    for plain, written in (("\\", "\\\\"), ("|", "\\p"), ("<", "\\l"), ("\n", "\\n")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(written))
    return F.coalesce(escaped, F.lit("\\0"))


def _unkind(c: Column) -> Column:
    def one(x: Column) -> Column:
        for plain, written in (("|", "\\p"), ("<", "\\l"), ("\n", "\\n")):
            x = F.replace(x, F.lit(written), F.lit(plain))
        return x

    return F.when(c != "\\0", F.array_join(F.transform(F.split(c, r"\\\\", -1), one), "\\"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, n_attachment_tokens), a row per conversation.

    attachments: (turn_no, ordinal, kind, ref, n_tokens) in the order of their placeholders, numbered over the conversation.
    """
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"))
    t = t.withColumn("turn_no", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "parts")) - 1)
    p = t.select("conv_id", "turn_no", "role", F.posexplode_outer("parts").alias("at", "part"))
    there = F.col("at").isNotNull()
    other = there & F.coalesce(F.col("part.kind") != "text", F.lit(True))
    words = F.coalesce("part.text", F.lit(""))
    # whether a part is text; null for what leaves no trace
    p = p.withColumns({"other": other, "words": words, "texty": F.when(other, F.lit(False)).when(there & (words != ""), F.lit(True))})
    own = Window.partitionBy("conv_id", "turn_no").orderBy("at")
    along = Window.partitionBy("conv_id").orderBy("turn_no", "at").rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("texty", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumns({"after_text": F.coalesce(before, F.lit(False)), "ordinal": F.sum(F.col("other").cast("long")).over(along)})
    piece = F.when(F.col("other"), F.concat(F.lit("<|"), _kind(F.col("part.kind")), F.lit("_"), F.col("ordinal").cast("string"), F.lit("|>"))).when(F.col("texty"), F.concat(F.when(F.col("after_text"), APART).otherwise(""), escape(F.col("words")))).otherwise("")
    attachment = F.when(F.col("other"), F.struct("ordinal", F.col("turn_no").cast("long").alias("turn_no"), F.col("part.kind").alias("kind"), F.col("part.ref").alias("ref"), _expanded(F.col("part")).alias("n_tokens")))
    g = p.groupBy("conv_id", "turn_no", "role").agg(F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))).alias("pieces"), F.array_sort(F.collect_list(attachment)).alias("own"))
    return _joined(g.select("conv_id", "turn_no", "role", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("body"), "own"), True)


def format_texts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """:func:`format_chats` for plain texts, a part each."""
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.withColumn("turn_no", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1)
    return _joined(t.select("conv_id", "turn_no", "role", escape(F.col("text")).alias("body")), False)


ATTACHMENT = "struct<ordinal: bigint, turn_no: bigint, kind: string, ref: string, n_tokens: bigint>"


def _joined(t: DataFrame, attached: bool) -> DataFrame:
    """Conversations of turns (conv_id, turn_no, role, body[, own attachments])."""
    t = t.withColumn("piece", F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"), F.col("body"), F.lit(END + "\n")))
    t = t.withColumn("size", F.length("body").cast("long"))
    ahead = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, 0)
    # a body ends so far before the end of its turn
    t = t.withColumn("start", F.sum(F.length("piece").cast("long")).over(ahead) - F.col("size") - len(END) - 1)
    own = F.col("own") if attached else F.array().cast(f"array<{ATTACHMENT}>")
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "role", "piece", "start", "size", own.alias("own")))).alias("ts"))
    spans = F.transform(F.filter("ts", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["size"].alias("length")))
    found = F.flatten(F.transform("ts", lambda x: x["own"]))
    shown = F.transform(found, lambda x: F.struct(x["turn_no"].alias("turn_no"), x["ordinal"].alias("ordinal"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["n_tokens"].alias("n_tokens")))
    return g.select("conv_id", F.array_join(F.transform("ts", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"), shown.alias("attachments"), F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("n_attachment_tokens"))


def _expanded(p: Column) -> Column:
    per = F.lit(0)
    for kind, n in UNIT_TOKENS.items():
        per = F.when(p["kind"] == kind, F.lit(n)).otherwise(per)
    return (per * F.coalesce(p["units"], F.lit(1))).cast("long")


def _bodies(formatted: Column, turn) -> Column:
    segs = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x, i: i > 0)

    def one(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        at = F.length(role) + 1
        return turn(_unrole(role), F.substring(x, at + 1, F.length(x) - at - (len(END) + 1)))

    return F.transform(segs, one)


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped; the text is that of all text parts, without placeholders."""
    # text holds no "<|" of its own
    plain = lambda body: F.when(body.contains("<|"), F.regexp_replace(body, r"<\|[^|]*\|>", "")).otherwise(body)
    return _bodies(formatted, lambda role, body: F.struct(role.alias("role"), unescape(plain(body)).alias("text")))


def read_parts(formatted: Column) -> Column:
    """array<struct<role, parts: array<struct<kind, text, ordinal>>>> of a formatted conversation: texts, and placeholders with the number of their attachment."""
    part = lambda kind, text, n: F.struct(kind.cast("string").alias("kind"), text.cast("string").alias("text"), n.cast("long").alias("ordinal"))
    words = lambda x: F.when(x != "", F.array(part(F.lit("text"), unescape(x), F.lit(None)))).otherwise(F.array().cast("array<struct<kind: string, text: string, ordinal: bigint>>"))

    def pieces(x: Column, i: Column) -> Column:
        head = F.substring_index(x, "|>", 1)
        rest = words(F.substring(x, F.length(head) + 3, F.length(x)))
        mark = part(_unkind(F.regexp_extract(head, r"(?s)\A(.*)_\d+\z", 1)), F.lit(None), F.substring_index(head, "_", -1))
        return F.when(i == 0, words(x)).when(head == "+", rest).otherwise(F.concat(F.array(mark), rest))

    return _bodies(formatted, lambda role, body: F.struct(role.alias("role"), F.flatten(F.transform(F.split(body, r"<\|", -1), pieces)).alias("parts")))


def digest(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted strings."""
    turns = read_back(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    return (
        chats.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.encode(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), "UTF-8"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
