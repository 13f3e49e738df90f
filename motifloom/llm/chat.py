"""Chat formatting with typed content parts, in DataFrame functions only.

A message has a role and an array of parts ``struct<kind, text, ref, width,
height, seconds, pages>``. A visitor turns each part, in order, into template
text: text is escaped, any other kind becomes a numbered placeholder whose
reference and expanded token count are recorded.

Turns read ``<|turn|>role<|body|>text<|end|>``. Control strings inside roles
and texts are broken up reversibly: each backslash is doubled, and ``\\-`` is
put behind the first character of each control string, at every place one
starts. No control string then occurs in escaped text, so the marks can be
found by plain splitting.

Nulls: a null role or text is empty, null parts are left out, rows without a
conversation id form one conversation, null turns come first. Ties in ``turn``
are ordered by role and content. An unknown kind is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"

#: Kinds of parts that become placeholders.
PLACED = ("image", "audio", "document")

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Control strings of this and of other common templates.
CONTROL = (
    TURN, BODY, END, "<|image:", "<|audio:", "<|document:",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
)


@dataclass(frozen=True)
class Template:
    control: tuple[str, ...] = CONTROL
    learn: tuple[str, ...] = ("assistant",)
    patch: int = 14
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 512

    def __post_init__(self):
        bad = [s for s in self.control if len(s) < 2 or "\\" in s]
        if bad or not {TURN, BODY, END} <= set(self.control):
            raise ValueError(f"control strings need two characters, no backslash, and the turn marks: {bad}")

    def escape(self, text: Column) -> Column:
        starts = "|".join(f"{re.escape(s[0])}(?={re.escape(s[1:])})" for s in self.control)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), starts, r"$0\\-")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\\-|\\(\\)", "$1")


def text_parts(text: Column) -> Column:
    """The parts of a message that is plain text."""
    names = ("ref", "width", "height", "seconds", "pages")
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).alias(n) for n in names])
    return F.array(part.cast(PART))


def _expanded(part: Column, t: Template) -> Column:
    """Tokens that a placeholder stands for: image patches, audio frames, pages; at least one."""
    side = lambda c: F.ceil(F.coalesce(part[c], F.lit(0)) / t.patch)
    image = side("width") * side("height")
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * t.audio_tokens_per_second)
    document = F.coalesce(part["pages"], F.lit(0)) * t.tokens_per_page
    n = F.when(part["kind"] == "image", image).when(part["kind"] == "audio", audio).otherwise(document)
    return F.greatest(n.cast("long"), F.lit(1).cast("long"))


def visit(messages: DataFrame, t: Template) -> DataFrame:
    """Add ``body`` and ``files`` (attachments in order) to ``messages(conv_id, turn, role, parts)``.

    Placeholders are written without a number first; the pieces between them
    then tell the numbers, so that the work grows with the message.
    """
    known = F.filter("parts", lambda p: p.isNotNull())
    other = F.filter(known, lambda p: p["kind"] != "text")

    def placed(p: Column) -> Column:
        fine = p["kind"].isin(*PLACED)
        wrong = F.raise_error(F.concat(F.lit("unknown kind of part: "), F.coalesce(p["kind"], F.lit("null"))))
        return F.when(p["kind"] == "text", t.escape(F.coalesce(p["text"], F.lit("")))).when(fine, F.concat(F.lit("<|"), p["kind"], F.lit(":|>"))).otherwise(wrong)

    def numbered(piece: Column, i: Column) -> Column:
        kind = F.substring_index(piece, ":", 1)
        rest = F.substring(piece, F.length(kind) + 2, F.length(piece))
        return F.when(i == 0, F.substring(piece, F.lit(2), F.length(piece))).otherwise(F.concat(kind, F.lit(":"), (i - 1).cast("string"), rest))

    # The space in front keeps the first piece free of a placeholder.
    joined = F.concat(F.lit(" "), F.coalesce(F.array_join(F.transform(known, placed), ""), F.lit("")))
    pieces = F.split(joined, "(?=" + "|".join(re.escape(f"<|{k}:|>") for k in PLACED) + ")")
    body = F.array_join(F.transform(pieces, numbered), "")
    files = F.transform(other, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p, t).alias("tokens")))
    return messages.withColumns({"body": body, "files": F.coalesce(files, F.array().cast("array<struct<kind:string,ref:string,tokens:bigint>>"))})


def format_chat(messages: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation of ``messages(conv_id, turn, role, parts)``.

    ``formatted`` is the whole conversation, ``loss`` the spans ``(begin, end)``
    of it, in code points, that a model learns from: the bodies of the roles in
    ``template.learn``; ``spans`` has the body of each turn and whether it is one of
    them. ``files`` lists attachments ``(turn_no, place, kind, ref,
    tokens)`` in order, and ``placeholder_tokens`` the tokens they stand for. A
    conversation is one row of the result, so its turns meet in one group.
    """
    t = template or Template()
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), "parts")
    seen = visit(rows, t).select(
        "conv_id", "turn", "role",
        F.concat(F.lit(TURN), t.escape(F.col("role")), F.lit(BODY)).alias("head"), "body", "files",
    )
    # Where each turn ends: a running sum, over the same exchange as the collection.
    order = ["turn", "role", "body", "files"]
    along = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("head") + F.length("body") + len(END)
    ended = seen.withColumn("end", F.sum(size.cast("long")).over(along) - len(END))
    turns = F.sort_array(F.collect_list(F.struct(*order, "end", "head")))
    whole = ended.groupBy("conv_id").agg(turns.alias("turns"))
    files = F.flatten(
        F.transform(
            "turns",
            lambda x, i: F.transform(x["files"], lambda f, k: F.struct(i.alias("turn_no"), k.alias("place"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))),
        )
    )
    spans = F.transform("turns", lambda x: F.struct((x["end"] - F.length(x["body"])).alias("begin"), x["end"].alias("end"), x["role"].isin(*t.learn).alias("learn")))
    out = whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("spans"),
        files.alias("files"),
    )
    loss = F.transform(F.filter("spans", lambda s: s["learn"]), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end")))
    tokens = F.aggregate("files", F.lit(0).cast("long"), lambda acc, f: acc + f["tokens"])
    return out.select("conv_id", "formatted", loss.alias("loss"), "spans", "files", tokens.alias("placeholder_tokens"))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns ``(role, text)`` of a formatted conversation, unescaped."""
    t = template or Template()
    pieces = F.slice(F.split(formatted, re.escape(TURN)), 2, F.size(F.split(formatted, re.escape(TURN))))

    def turn(piece: Column) -> Column:
        sides = F.split(piece, re.escape(BODY), 2)
        return F.struct(t.unescape(sides[0]).alias("role"), t.unescape(F.regexp_replace(sides[1], re.escape(END) + r"\z", "")).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped.

    Turn marks part the text into turns, in the order of ``spans``; a span's
    length is then read in front of its turn's end.
    """
    t = template or Template()

    def learned(piece: Column, s: Column) -> Column:
        size = (s["end"] - s["begin"]).cast("int")
        return F.when(s["learn"], t.unescape(F.substring(piece, F.length(piece) - len(END) - size + 1, size))).otherwise("")

    pieces = F.split(formatted, f"(?<=.)(?={re.escape(TURN)})")
    return F.array_join(F.zip_with(pieces, spans, learned), "")
