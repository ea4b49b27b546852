"""Chat formatting: conversations rendered by a compiled template, and read back from the output.

Turns are sorted by conversation within partitions and rendered as they pass, so a task holds one turn at a time,
however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from aerogrid.llm.chat_template import CompiledTemplate, unescape

TURN, TEXT, END = "<|turn|>", "<|text|>", "</s>"
#: Marks each turn, escapes control strings in roles and texts, and masks the assistant's texts.
TEMPLATE = (
    f"{{% for message in messages %}}{TURN}{{{{ message.role | escape }}}}{TEXT}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    f"{END}{{% if not loop.last %}}{{{{ '\\n' }}}}{{% endif %}}{{% endfor %}}"
)


class Reader:
    """Reads turns and masked text back from the pieces of one formatted conversation."""

    def __init__(self):
        self.turns = self.chars = self.loss_chars = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self._held: list[str] = []

    def feed(self, piece: str, masked: bool) -> None:
        """Pieces may end anywhere but inside a control string."""
        self.chars += len(piece)
        if masked:
            text = unescape(piece)
            self.loss_chars += len(text)
            self.loss_hash.update(text.encode("utf-8", "surrogatepass"))
        while END in piece:
            before, _, piece = piece.partition(END)
            self._held.append(before)
            self._turn("".join(self._held))
            self._held = []
        self._held.append(piece)

    def _turn(self, formatted: str) -> None:
        role, _, text = formatted.partition(TURN)[2].partition(TEXT)
        self.turns += 1
        self.turns_hash.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))


def _sorted_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = conversations.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict[str, str]]]:
    for batch in batches:
        for conv, role, text in zip(batch["conv"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            yield conv, {"role": role, "text": text}


def format_pieces(
    conversations: DataFrame,
    template: CompiledTemplate,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Rows (conv, start, piece, masked): the output of each conversation, cut where the template puts pieces together.

    `start` is the place of the piece in its conversation, in code points.  Turns are ordered by turn,
    role and text, null turns first; null roles and texts count as empty; rows of a null conversation
    form one; repeated rows are repeated turns; an empty table gives an empty result.
    """
    rows = _sorted_turns(conversations, conv_col, turn_col, role_col, text_col)
    conv_type = rows.schema["conv"].dataType.simpleString()
    arrow_type = to_arrow_type(rows.schema["conv"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [arrow_type, pa.int64(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv", "start", "piece", "masked"])

        held = 0
        for conv, turns in groupby(_messages(batches), key=lambda x: x[0]):
            at = 0
            for piece, masked in template.pieces(m for _, m in turns):
                out.append((conv, at, piece, masked))
                at, held = at + len(piece), held + len(piece) + 50
                if held > 4_000_000:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    return rows.mapInArrow(run, f"conv {conv_type}, start long, piece string, masked boolean")


def format_report(conversations: DataFrame, template: CompiledTemplate, **columns: str) -> DataFrame:
    """One row per conversation, read back from the formatted output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Nulls, ties, repeated rows and empty tables as in `format_pieces`; the output is read as it is made.
    """
    rows = _sorted_turns(
        conversations,
        columns.get("conv_col", "conv_id"),
        columns.get("turn_col", "turn"),
        columns.get("role_col", "role"),
        columns.get("text_col", "text"),
    )
    conv_type = rows.schema["conv"].dataType.simpleString()
    arrow_type = to_arrow_type(rows.schema["conv"].dataType)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [arrow_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for conv, turns in groupby(_messages(batches), key=lambda x: x[0]):
            reader = Reader()
            for piece, masked in template.pieces(m for _, m in turns):
                reader.feed(piece, masked)
            out.append((conv, reader.turns, reader.turns_hash.hexdigest(), reader.loss_chars, reader.loss_hash.hexdigest(), reader.chars))
            if len(out) == 10_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return rows.mapInArrow(run, f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
