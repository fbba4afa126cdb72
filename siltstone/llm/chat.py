"""Chat formatting by columnar byte assembly.

Spark gathers the turns of each conversation into one row (a conversation is the unit of the output, so its turns
have to meet). From there a task works on columns: the lengths of all segments of a batch, their cumulative
offsets, and scatter indices are numpy arrays; headers, contents and ends are copied into one preallocated buffer
that becomes the Arrow string column itself. The loss mask comes out of the same offsets.

Template, per turn: ``<|im_start|>`` role newline content ``<|im_end|>`` newline. Inside a content every ``<``,
any number of backslashes, ``|`` gets one more backslash, so no text can make a control string, and taking one
backslash out again gives the text back. Roles are escaped the same way, with backslash and newline as well.

A batch is cut where its turns pass ``CHUNK`` bytes, so a task holds one chunk and its indices, or one conversation
where that is longer; inside a conversation segments are copied by chunk too, and a segment longer than a chunk goes in
one piece. A conversation is one value of the output, so its bytes have to fit a task, and Arrow's strings (2 GB).

Defined cases: a null text or role is empty; turns are ordered by turn (null first), then role and text; repeated
rows are repeated turns; a null conv_id is one conversation; a very long text is copied whole; an empty table gives no
rows; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are laid out at once, about; their scatter indices take eight times as many.
CHUNK = 4_000_000
START, END, ASSISTANT = "<|im_start|>", "<|im_end|>", "assistant"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def conversations_by_id(turns: DataFrame) -> DataFrame:
    """One row per conversation with its turns in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.select(F.col("conv_id").cast("long"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def bounded(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to no more than the limit; a larger item is a range of its own."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def assemble(turn_counts: np.ndarray, roles: list[str], texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted conversations as one Arrow column, and per turn the byte span of its content in its conversation."""
    heads = [f"{START}{escape_role(r)}\n".encode("utf-8", "surrogatepass") for r in roles]
    bodies = [escape(t).encode("utf-8", "surrogatepass") for t in texts]
    tail = f"{END}\n".encode()
    n = len(roles)
    lens = np.empty((n, 3), np.int64)
    lens[:, 0] = np.fromiter(map(len, heads), np.int64, n)
    lens[:, 1] = np.fromiter(map(len, bodies), np.int64, n)
    lens[:, 2] = len(tail)
    at = np.concatenate([[0], np.cumsum(lens.reshape(-1))])
    out = np.empty(at[-1], np.uint8)
    for column, pieces in ((0, heads), (1, bodies), (2, [tail] * n)):
        size, start = lens[:, column], at[:-1].reshape(-1, 3)[:, column]
        for a, b in bounded(size, CHUNK):
            if b == a + 1:
                out[start[a] : start[a] + size[a]] = np.frombuffer(pieces[a], np.uint8)
            else:
                before = np.cumsum(size[a:b]) - size[a:b]
                out[np.repeat(start[a:b] - before, size[a:b]) + np.arange(size[a:b].sum())] = np.frombuffer(b"".join(pieces[a:b]), np.uint8)
    ends = np.concatenate([[0], np.cumsum(turn_counts)])
    offsets = at[3 * ends]
    column = pa.Array.from_buffers(pa.large_string(), len(turn_counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    own = np.repeat(offsets[:-1], turn_counts)
    return column, at[1:-1:3] - own, at[2::3] - own


def conversation_bytes(lists: pa.ListArray) -> np.ndarray:
    """Bytes of the texts of each conversation, and some for each turn."""
    turns = np.asarray(lists.value_lengths(), np.int64)
    texts = np.asarray(pc.binary_length(lists.flatten().field("text")), np.int64) + 64
    ends = np.concatenate([[0], np.cumsum(texts)])[np.concatenate([[0], np.cumsum(turns)])]
    return np.diff(ends)


FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation: the formatted text and the spans under the loss mask, in UTF-8 bytes of that text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, last in bounded(conversation_bytes(whole.column(1)), CHUNK):
                batch = whole.slice(first, last - first)
                lists = batch.column(1)
                items = lists.flatten()
                roles, texts = items.field("role").to_pylist(), items.field("text").to_pylist()
                counts = np.asarray(lists.value_lengths(), np.int64)
                formatted, start, end = assemble(counts, roles, texts)
                own = np.concatenate([[0], np.cumsum(counts)])
                spans = [[{"start": int(start[i]), "end": int(end[i])} for i in range(a, b) if roles[i] == ASSISTANT] for a, b in zip(own[:-1], own[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), formatted.cast(pa.string()), pa.array(spans, _SPANS)], names=["conv_id", "formatted", "loss_spans"])

    return conversations_by_id(turns).mapInArrow(run, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, _, rest = turn.partition("\n")
        out.append((unescape_role(role), unescape(rest[: -len(END) - 1])))
    return out


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted texts and their masks say, for a check against the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()) for i in range(batch.num_rows)):
                turns = hashlib.sha256()
                n = 0
                for role, content in parse(text):
                    turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                raw = text.encode("utf-8", "surrogatepass")
                loss = "".join(unescape(raw[s["start"] : s["end"]].decode("utf-8", "surrogatepass")) for s in spans)
                rows.append((conv, n, turns.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, READ)
