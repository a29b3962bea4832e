"""Chat formatting at the level of tokens.

Every segment of a conversation (a reserved control token or the text of a turn) is encoded on its own, so
no text can turn into a control token: control tokens have reserved ids beyond the vocabulary.
Control strings that occur in a text are also escaped, reversibly, so the formatted text alone can be
read back. The loss mask is the prefix sum of +1 and -1 at the borders of assistant texts.

A conversation is a run of rows, one for each turn, with its place in tokens and characters. Rows are
encoded where they lie; only then are they brought together by conversation, in order, and read as a
stream: no conversation is held in memory as a whole, however long it is.

Template, without any white space of its own:
``<s>`` first; ``[SYS]text[/SYS]``, ``[INST]text[/INST]``, ``text</s>`` for system, user, assistant; any other
role is ``[ROLE]role[SEP]text[/ROLE]``.

Escaping: after the first character of a control string a backslash is put in, and one more where
backslashes already follow it (``[INST]`` -> ``[\\INST]``, ``[\\INST]`` -> ``[\\\\INST]``).

Defined cases: null text or role counts as empty; a null conv_id is one conversation; turns that repeat are
kept and follow each other by role, then text; null turns come first; extra columns are left alone; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import tokenizer_path

CHAT_TOKENIZER = "byte_bpe_50k.json"
CONTROLS = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[SEP]", "[/ROLE]")
OPEN = {"system": "[SYS]", "user": "[INST]"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
#: The first reserved id; the vocabulary ends below it.
RESERVED = 50_257
IDS = {c: RESERVED + i for i, c in enumerate(CONTROLS)}
_RESTS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_ESCAPE, _UNESCAPE = re.compile(rf"([<\[])(\\*)(?={_RESTS})"), re.compile(rf"([<\[])\\(\\*)(?={_RESTS})")

_tokenizers: dict[str, object] = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def load(name: str = CHAT_TOKENIZER):
    """The byte-level tokenizer of that name, for which its special tokens' strings are ordinary text."""
    if name not in _tokenizers:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(tokenizer_path(name))
        made.encode_special_tokens = True
        if made.get_vocab_size() > RESERVED:
            raise ValueError(f"{name} has ids from {RESERVED} on, which are reserved")
        _tokenizers[name] = made
    return _tokenizers[name]


def segments(role: str, text: str) -> list[tuple[str, bool, bool]]:
    """(string, is a control, bears loss) of a turn in order, texts escaped."""
    if role == "assistant":
        return [(escape(text), False, True), ("</s>", True, False)]
    if role in OPEN:
        return [(OPEN[role], True, False), (escape(text), False, False), (CLOSE[role], True, False)]
    return [("[ROLE]", True, False), (escape(role), False, False), ("[SEP]", True, False), (escape(text), False, False), ("[/ROLE]", True, False)]


TURN = "conv_id long, turn long, role string, text string, formatted string, ids array<int>, mask array<tinyint>, n_tokens long, n_chars long, first boolean"


def _encoder(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer)
        for b in batches:
            conv, turn, role, text, first = (c.to_pylist() for c in b.columns)
            parts = [[("<s>", True, False)] * f + segments(r, t) for r, t, f in zip(role, text, first, strict=True)]
            coded = iter(tok.encode_batch([s for p in parts for s, control, _ in p if not control], add_special_tokens=False))
            ids, masks, strings = [], [], []
            for p in parts:
                lists = [[IDS[s]] if control else next(coded).ids for s, control, _ in p]
                ends = np.cumsum([len(x) for x in lists])
                edges = np.zeros(ends[-1] + 1, np.int8)
                for end, x, (_, _, loss) in zip(ends, lists, p, strict=True):
                    edges[end - len(x)] += loss
                    edges[end] -= loss
                ids.append(np.concatenate([np.array(x, np.int32) for x in lists]))
                masks.append(np.cumsum(edges[:-1], dtype=np.int8))
                strings.append("".join(s for s, _, _ in p))
            columns = [conv, turn, role, text, strings, ids, masks, [len(x) for x in ids], [len(s) for s in strings], first]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in TURN.split(", ")])

    return run


def format_conversations(conversations: DataFrame, tokenizer: str = CHAT_TOKENIZER) -> DataFrame:
    """One row per turn: its formatted text, ids and loss mask, and where they begin in the conversation.

    Columns: conv_id, place (from 0), turn, role, formatted, ids, mask, token_start, char_start.
    """
    small_batches(conversations.sparkSession)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")], *text)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumn("place", F.row_number().over(order) - 1)
    # encoded where the turns lie in order, so the running sums need no further exchange
    coded = numbered.select("conv_id", "turn", "role", "text", (F.col("place") == 0).alias("first")).mapInArrow(_encoder(tokenizer), TURN)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", F.col("first").desc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return coded.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("place"),
        "turn",
        "role",
        "formatted",
        "ids",
        "mask",
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_start"),
        F.coalesce(F.sum("n_chars").over(before), F.lit(0)).alias("char_start"),
    )


class _Reader:
    """Reads one conversation back from its tokens, piece by piece, and keeps digests of what it has read."""

    def __init__(self, tok):
        self.tok, self.turns, self.loss = tok, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.role: str | None = None
        self.text = ""

    def feed(self, formatted: str, ids: np.ndarray, mask: np.ndarray) -> None:
        self.chars += len(formatted)
        borders = np.flatnonzero((ids[1:] >= RESERVED) | (ids[:-1] >= RESERVED) | (mask[1:] != mask[:-1])) + 1
        for part, loss in zip(np.split(ids, borders), mask[np.r_[0, borders]], strict=True):
            if part[0] >= RESERVED:
                self._control(CONTROLS[part[0] - RESERVED])
            else:
                plain = unescape(self.tok.decode(part.tolist(), skip_special_tokens=False))
                self.text += plain
                if loss:
                    self.loss.update(plain.encode())
                    self.loss_chars += len(plain)

    def _control(self, control: str) -> None:
        if control == "[SEP]":
            self.role, self.text = self.text, ""
        elif control in ("</s>", "[/SYS]", "[/INST]", "[/ROLE]"):
            role = {c: r for r, c in CLOSE.items()}.get(control, self.role)
            self.turns.update(f"{role}\n{self.text}\n".encode())
            self.n_turns += 1
            self.role, self.text = None, ""

    def result(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, tokenizer: str = CHAT_TOKENIZER) -> DataFrame:
    """What the ids, masks and texts of ``format_conversations`` say: one row per conversation."""
    small_batches(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        reader, current, rows = None, None, []
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            conv, place, text = (b.column(k).to_pylist() for k in range(3))
            for i, c in enumerate(conv):
                if reader is None or place[i] == 0:
                    if reader is not None:
                        rows.append((current, *reader.result()))
                    reader, current = _Reader(load(tokenizer)), c
                ids, mask = (b.column(k)[i].values.to_numpy() for k in (3, 4))
                reader.feed(text[i], ids, mask)
            if rows:
                yield emit()
                rows = []
        if reader is not None:
            rows.append((current, *reader.result()))
            yield emit()

    ordered = formatted.select("conv_id", "place", "formatted", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
