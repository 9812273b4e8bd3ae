"""Chat formatting: typed content parts of turns become one text with ordered placeholders and a loss mask.

DataFrame functions only. A turn holds parts (or one text). A visitor goes through the parts in
order, a document's own parts after it: text is escaped and written, an image, a piece of sound, a
document or a part of any other type is written as a placeholder, and its reference and the number
of tokens that the placeholder stands for are recorded. The template puts marks around a turn by its
role; only what assistants say is under the loss mask.

Escaping: a control string is a mark, a placeholder or the boundary of two text parts. In texts and
roles a backslash is put behind the first sign of a control string, and one more where there are
backslashes already, so reading takes one away and gets back what was there. Written texts hold no
control string, so marks are read without doubt.

Edge cases: a null text or role is written as an empty one, null parts are left out, a turn without
parts has no text; parts of a null type count as other, with 0 tokens; sizes that are null or below 1 count as 1,
a null or negative duration as 0; turns of one conversation with the same number, and null numbers
(first), are ordered by role, then text, then parts; repeated rows are repeated turns; a null conv_id
is a conversation; an empty table gives no rows; other columns of the input are ignored.

Scale: segments() moves no rows. conversations() deals rows by conversation once; a formatted
conversation is one string, so it can be no larger than one (2 GB), and so is the work of one key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a part. Those of a document may hold parts of their own, one level deep, as children.
FIELDS = {"type": "string", "text": "string", "uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
LEAF = f"struct<{','.join(f'{k}:{t}' for k, t in FIELDS.items())}>"
PARTS = f"array<{LEAF[:-1]},children:array<{LEAF}>>>"
BOUNDARY = "<|part|>"
#: First sign, backslashes, rest of every control string: marks of turns, placeholders and the boundary.
CONTROL = r"([<\[])(\\*)(/?s>|/?(?:INST|ROLE|TEXT)\]|\|(?:image|audio|document|other|part)\|>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?(?:INST|ROLE|TEXT)\]|\|(?:image|audio|document|other|part)\|>)"
PLACEHOLDER = r"<\|(?:image|audio|document|other|part)\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


@dataclass(frozen=True)
class Visitor:
    """How many tokens a placeholder stands for, one method for each type of part. Subclass it to change a rule or to add a type."""

    patch: int = 28
    tokens_a_second: float = 12.5
    tokens_a_page: int = 256
    types: tuple[str, ...] = ("image", "audio", "document")

    def image(self, part: Column) -> Column:
        """Patches that cover the image."""
        across, down = (F.ceil(F.greatest(F.coalesce(part[c], F.lit(1)), F.lit(1)) / F.lit(self.patch)) for c in ("width", "height"))
        return (across * down).cast("long")

    def audio(self, part: Column) -> Column:
        return F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * F.lit(self.tokens_a_second)).cast("long")

    def document(self, part: Column) -> Column:
        return (F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * F.lit(self.tokens_a_page)).cast("long")

    def other(self, part: Column) -> Column:
        return F.lit(0).cast("long")

    def visit(self, part: Column, before: Column) -> Column:
        """written, kind (null for text), uri and tokens of a part; before is the part ahead of it, null for the first."""
        is_text = F.coalesce(part["type"] == "text", F.lit(False))
        kind, tokens = F.lit("other"), self.other(part)
        for t in self.types:
            here = part["type"] == t
            kind, tokens = F.when(here, F.lit(t)).otherwise(kind), F.when(here, getattr(self, t)(part)).otherwise(tokens)
        boundary = F.when(F.coalesce(before["type"] == "text", F.lit(False)), F.lit(BOUNDARY)).otherwise(F.lit(""))
        written = F.when(is_text, F.concat(boundary, escape(part["text"]))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))
        nothing = F.lit(None).cast("string")
        return F.struct(written.alias("written"), F.when(is_text, nothing).otherwise(kind).alias("kind"), F.when(is_text, nothing).otherwise(part["uri"]).alias("uri"), F.when(is_text, F.lit(0)).otherwise(tokens).cast("long").alias("tokens"))


@dataclass(frozen=True)
class Template:
    """Marks before and after a turn. Roles without marks of their own are named between [ROLE] and [TEXT]. All marks are control strings."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")})
    trained: tuple[str, ...] = ("assistant",)

    def opening(self, role: Column) -> Column:
        out = F.concat(F.lit("[ROLE]"), escape(role), F.lit("[TEXT]"))
        for name, (before, _) in self.marks.items():
            out = F.when(role == name, F.lit(before)).otherwise(out)
        return out

    def closing(self, role: Column) -> Column:
        out = F.lit("[/ROLE]")
        for name, (_, after) in self.marks.items():
            out = F.when(role == name, F.lit(after)).otherwise(out)
        return out

    def pattern(self) -> str:
        """Of one whole turn. Bodies hold no mark, so the shortest match is the turn."""
        quoted = lambda s: "".join("\\" + c if c in "[]|" else c for c in s)
        return "(?s)" + "|".join(f"{quoted(a)}.*?{quoted(b)}" for a, b in [*self.marks.values(), ("[ROLE]", "[/ROLE]")])

    def read(self, turn: Column) -> tuple[Column, Column]:
        """Role and body of a turn as it was written; the body is still escaped."""
        role = unescape(F.regexp_extract(turn, r"(?s)^\[ROLE\](.*?)\[TEXT\]", 1))
        body = F.regexp_extract(turn, r"(?s)\[TEXT\](.*)\[/ROLE\]$", 1)
        for name, (a, b) in self.marks.items():
            here = turn.startswith(a)
            role, body = F.when(here, F.lit(name)).otherwise(role), F.when(here, F.substring(turn, F.lit(len(a) + 1), F.char_length(turn) - len(a) - len(b))).otherwise(body)
        return role, body


def parts_of_text(text: Column) -> Column:
    """One text part."""
    given = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    fields = [given.get(k, F.lit(None).cast(t)).alias(k) for k, t in FIELDS.items()]
    return F.array(F.struct(*fields, F.lit(None).cast(f"array<{LEAF}>").alias("children")))


def parts_of_json(content: Column) -> Column:
    """Parts of a JSON array of objects with the fields of a part; any other content is one text part."""
    found = F.when(F.ltrim(content).startswith("["), F.from_json(content, PARTS))
    return F.coalesce(found, parts_of_text(content))


def leaves(parts: Column) -> Column:
    """Parts in order, each document's own parts after it; null ones are left out."""
    leaf = lambda p: F.struct(*[p[k].alias(k) for k in FIELDS])
    none = F.array().cast(f"array<{LEAF}>")
    within = F.transform(parts, lambda p: F.when(p.isNull(), none).otherwise(F.concat(F.array(leaf(p)), F.coalesce(p["children"], none))))
    return F.coalesce(F.filter(F.flatten(within), lambda p: p.isNotNull()), none)


def segments(rows: DataFrame, parts: Column | None = None, template: Template | None = None, visitor: Visitor | None = None) -> DataFrame:
    """One row per turn, rows where they are: conv_id, turn, role, segment (the turn as written), at and length (of its body under the loss mask; null where it is not), attachments (kind, uri, place among the turn's placeholders, tokens) and tokens (what all its placeholders stand for)."""
    template, visitor = template or Template(), visitor or Visitor()
    role = F.coalesce(F.col("role"), F.lit(""))
    out = rows.select("conv_id", "turn", role.alias("role"), leaves(parts_of_text(F.col("text")) if parts is None else parts).alias("leaves"))
    before = F.slice(F.concat(F.array(F.lit(None).cast(LEAF)), F.col("leaves")), F.lit(1), F.size("leaves"))
    out = out.select("conv_id", "turn", "role", F.zip_with("leaves", before, visitor.visit).alias("seen"))
    placed = F.filter("seen", lambda x: x["kind"].isNotNull())
    out = out.select(
        "conv_id", "turn", "role", F.array_join(F.transform("seen", lambda x: x["written"]), "").alias("body"),
        F.transform(placed, lambda x, k: F.struct(x["kind"].alias("kind"), x["uri"].alias("uri"), k.alias("place"), x["tokens"].alias("tokens"))).alias("attachments"),
    )
    opening, trained = template.opening(F.col("role")), F.col("role").isin(list(template.trained))
    return out.select(
        "conv_id", "turn", "role", F.concat(opening, "body", template.closing(F.col("role"))).alias("segment"),
        F.when(trained, F.char_length(opening)).alias("at"), F.when(trained, F.char_length("body")).alias("length"),
        "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("tokens"),
    )


def conversations(rows: DataFrame, parts: Column | None = None, template: Template | None = None, visitor: Visitor | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (for each turn null, or where its body starts in formatted, where in the turn, and its length, in code points), attachments (in order, with the number of their turn) and tokens."""
    turns = segments(rows, parts, template, visitor)
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "segment", F.to_json("attachments"))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select("*", F.row_number().over(in_order).alias("place"), F.coalesce(F.sum(F.char_length("segment")).over(before), F.lit(0)).alias("start"))
    loss = F.when(F.col("at").isNotNull(), F.struct((F.col("start") + F.col("at")).alias("start"), F.col("at").alias("at"), F.col("length").cast("long").alias("length")))
    held = F.struct("place", "segment", loss.alias("loss"), "attachments", "tokens")
    out = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(held)).alias("turns"))
    attached = F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: F.struct((t["place"] - 1).alias("turn"), *[a[k].alias(k) for k in ("kind", "uri", "place", "tokens")])))
    return out.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"), F.transform("turns", lambda t: t["loss"]).alias("loss"),
        F.flatten(attached).alias("attachments"), F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("tokens"),
    )


def plain(body: Column) -> Column:
    """The text of a body: what its text parts say, one after the other."""
    return F.array_join(F.transform(F.split(body, PLACEHOLDER, -1), unescape), "")


def placeholders(formatted: Column) -> Column:
    """The kinds of the placeholders of a formatted text, in order: they go with its attachments one by one."""
    return F.regexp_extract_all(formatted, F.lit(r"<\|(image|audio|document|other)\|>"), F.lit(1))


def read(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads conversations() back: conv_id, n_chars (of formatted), turns (role, text) and learned (what the mask cuts out of each turn under it, unescaped), found in formatted and loss alone."""
    template = template or Template()
    out = formatted.select("conv_id", "loss", F.char_length("formatted").alias("n_chars"), F.regexp_extract_all("formatted", F.lit(template.pattern()), F.lit(0)).alias("segments"))

    def turn(s: Column) -> Column:
        role, body = template.read(s)
        return F.struct(role.alias("role"), plain(body).alias("text"))

    cut_out = F.zip_with("segments", "loss", lambda s, m: F.when(m.isNotNull(), plain(F.substring(s, m["at"] + 1, m["length"].cast("int")))))
    return out.select("conv_id", "n_chars", F.transform("segments", turn).alias("turns"), F.filter(cut_out, lambda x: x.isNotNull()).alias("learned"))
