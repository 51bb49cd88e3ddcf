"""Chat formatting over typed content parts.

A turn is a role and an array of parts ``struct<kind, text, ref, tokens>``.  A
visitor walks the parts in order: text is escaped and copied, every other kind
leaves the placeholder ``<|kind|>`` and an attachment record (position, kind,
reference, tokens it expands to).  The template marks turns:

    <|im_start|>role NEWLINE body <|im_end|> NEWLINE

Control strings cannot arise from content: ``\\`` becomes ``\\\\`` and ``<|``
becomes ``<\\|`` (a line break in a role becomes ``\\n``); a part after the first that begins
with ``|`` begins with ``\\|``, so no control string arises where parts meet. ``unescape`` undoes it.
Rendering is column expressions, one row per turn; a conversation is the
concatenation of its pieces by turn.  Reading back streams the pieces of each
conversation in order with a few numbers and two digests as state, so the size
of a conversation does not matter.

Defined results: null role, text or kind count as empty (a part without kind
is text); an unknown kind is a document; null parts or no parts give an empty
body.  Rows with a null conversation id form one conversation.  Turns that tie
are ordered by role, then text; repeated rows are separate turns.  An empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# Tokens that an attachment expands to when its part does not say.
EXPANDED = {"image": 256, "audio": 128, "document": 512}
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
_PLACEHOLDER = re.compile(r"<\|(?:" + "|".join(EXPANDED) + r")\|>")


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def text_parts(text: Column) -> Column:
    """A plain text as the one part of its turn."""
    nothing = F.lit(None).cast("string")
    part = F.struct(
        F.lit("text").alias("kind"), text.alias("text"), nothing.alias("ref"), F.lit(None).cast("bigint").alias("tokens")
    )
    return F.array(part).cast(f"array<{PART}>")


def _kind(part: Column) -> Column:
    kind = F.coalesce(part["kind"], F.lit("text"))
    return F.when(kind.isin("text", *EXPANDED), kind).otherwise("document")


def _visit(part: Column, place: Column) -> Column:
    kind = _kind(part)
    text = escape(F.coalesce(part["text"], F.lit("")))
    # The part in front may end with "<"; a line break or a placeholder cannot.
    text = F.when((place > 0) & F.startswith(text, F.lit("|")), F.concat(F.lit("\\"), text)).otherwise(text)
    return F.when(kind == "text", text).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))


def _attachment(part: Column) -> Column:
    kind = _kind(part)
    tokens = part["tokens"]
    for name, n in EXPANDED.items():
        tokens = F.coalesce(tokens, F.when(kind == name, F.lit(n).cast("bigint")))
    return F.struct(kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
           learn: tuple = ("assistant",)) -> DataFrame:
    """One row per turn: (conv, turn, role, piece, loss_start, loss_end, attachments, expanded_tokens).

    ``loss_start`` and ``loss_end`` are code points within the piece; both are
    null where the turn is not to be learnt.
    """
    parts_ = F.filter(F.coalesce(F.col(f"`{parts}`"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), parts_.alias("parts"),
    )
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    rows = rows.select(
        "conv_id", "turn", "role",
        head.alias("head"),
        F.array_join(F.transform("parts", lambda p, i: _visit(p, i)), "").alias("body"),
        F.transform(F.filter("parts", lambda p: _kind(p) != "text"), _attachment).alias("attachments"),
    )
    learnt = F.col("role").isin(*learn)
    return rows.select(
        "conv_id", "turn", "role",
        F.concat("head", "body", F.lit(END + "\n")).alias("piece"),
        F.when(learnt, F.length("head")).alias("loss_start"),
        F.when(learnt, F.length("head") + F.length("body")).alias("loss_end"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; placeholders are taken out."""
    return [(unescape(r), unescape(_PLACEHOLDER.sub("", b))) for r, b in _TURN.findall(formatted)]


class _Reader:
    """State of one conversation while its pieces stream by."""

    def __init__(self, conv):
        self.conv, self.turns, self.learnt, self.chars = conv, 0, 0, 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, piece: str, start: int | None, end: int | None) -> None:
        for role, text in parse(piece):
            self.turns += 1
            self.text.update(f"{role}\n{text}\n".encode())
        if start is not None:
            masked = unescape(_PLACEHOLDER.sub("", piece[start:end]))
            self.learnt += len(masked)
            self.loss.update(masked.encode())
        self.chars += len(piece)

    def row(self) -> tuple:
        return (self.conv, self.turns, self.text.hexdigest(), self.learnt, self.loss.hexdigest(), self.chars)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted pieces and loss mask."""
    ordered = (
        rendered.select("conv_id", "turn", "role", "piece", "loss_start", "loss_end")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "piece")
        .select("conv_id", "piece", "loss_start", "loss_end")
    )
    conv_type = rendered.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {conv_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            done = []
            for conv, piece, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv)
                reader.take(piece, start, end)
            if done:
                yield _batch(done, batch.schema.field(0).type)
        if reader is not None:
            yield _batch([reader.row()], batch.schema.field(0).type)

    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
