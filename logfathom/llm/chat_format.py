"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered, ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn, and encoded once. The
three marks are added to the tokenizer as single tokens, so no token crosses a text's edge. Each token carries the
code points it covers; binary search over the sorted turn spans tells which turn it lies in, and tokens wholly inside
an assistant's text form the loss mask.

Turns are sorted by conversation on the cluster and read one after the other, so no conversation is held in memory. One of more
than ``STRETCH`` characters comes in several rows, stretches of whole turns in order, whose tokens are those of the whole.

Control strings inside roles and texts are escaped by one backslash after ``<`` (``<|`` to ``<\\|``, ``<\\|`` to
``<\\\\|``), which ``unescape`` takes back exactly.

Defined results: turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of their own.
Null roles and texts count as empty. Rows with a null conversation id form one conversation. Only the named columns
are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer
from tokenizers.processors import ByteLevel

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
START, MID, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)
STRETCH = 1 << 18  # characters of a conversation in a row, or one turn
BATCH = 1 << 20  # characters of all rows handed on together
FORMATTED = "conv_id bigint, part int, formatted string, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


@lru_cache(4)
def _tokenizer(path: str) -> Tokenizer:
    made = Tokenizer.from_file(path)
    made.post_processor = ByteLevel(trim_offsets=False)
    made.add_special_tokens([AddedToken(mark, special=True, normalized=False) for mark in (START, MID, END)])
    return made


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MID}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at = spans[-1][1] + len(END)
    return "".join(parts), spans


def loss_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie wholly inside one of the sorted, disjoint spans."""
    if not spans:
        return np.zeros(len(starts), bool)
    edge = np.array(spans)
    own = np.searchsorted(edge[:, 0], starts, side="right") - 1
    return (own >= 0) & (ends <= edge[np.maximum(own, 0), 1]) & (ends > starts)


def stretches(turns: Iterator[tuple], most: int = STRETCH) -> Iterator[tuple[int | None, int, list[tuple[str, str]]]]:
    """Sorted (conv_id, role, text) turns as (conv_id, part, turns): one part, or several of about ``most`` characters."""
    own, part, pairs, size = None, 0, [], 0
    for conv_id, role, text in turns:
        pair = role or "", text or ""
        if pairs and (conv_id != own or size >= most):
            yield own, part, pairs
            part, pairs, size = part + 1 if conv_id == own else 0, [], 0
        own = conv_id
        pairs.append(pair)
        size += len(pair[0]) + len(pair[1])
    if pairs:
        yield own, part, pairs


def format_conversations(rows: DataFrame, tokenizer: str = TOKENIZER, train_on: str = "assistant", most: int = STRETCH) -> DataFrame:
    """One row per conversation: formatted text, token ids, code point offsets and loss mask of each token.

    A conversation of more than ``most`` characters has several rows, parts 0, 1 and so on of whole turns, which follow one
    another in their partition; offsets count from the start of the row's text.
    """
    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer).encode
        kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
        names = ["conv_id", "part", "formatted", "input_ids", "token_start", "token_end", "loss_mask"]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

        out, size = [], 0
        read = (turn for batch in batches for turn in zip(*(column.to_pylist() for column in batch.columns), strict=True))
        for conv_id, part, pairs in stretches(read, most):
            formatted, spans = render(pairs)
            got = encode(formatted, add_special_tokens=False)
            starts, ends = np.array(got.offsets, np.int32).reshape(-1, 2).T
            mask = loss_tokens(starts, ends, [s for s, (role, _) in zip(spans, pairs, strict=True) if role == train_on])
            out.append((conv_id, part, formatted, np.array(got.ids, np.int32), starts.copy(), ends.copy(), mask))
            size += len(formatted)
            if size >= BATCH:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    return ordered.mapInArrow(run, FORMATTED)


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of text under the loss mask, unescaped; tokens that share a code point count it once."""
    out, begun, reach = [], None, -1
    for a, b in zip(starts[mask], ends[mask], strict=True):
        if begun is None or a > reach:
            if begun is not None:
                out.append(formatted[begun:reach])
            begun, reach = a, b
        else:
            reach = max(reach, b)
    if begun is not None:
        out.append(formatted[begun:reach])
    return [unescape(x) for x in out]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold: turns, text under the loss mask, sizes.

    The rows of a conversation follow one another, as ``format_conversations`` gives them.
    """
    kept = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    kept += ", n_tokens bigint, loss_tokens bigint"
    names = [column.split()[0] for column in kept.split(", ")]
    kinds = [pa.string() if name.endswith("sha256") else pa.int64() for name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, parts, counts, shas, out = None, 0, np.zeros(5, np.int64), [], []

        def end() -> None:
            if parts:
                n_turns, loss_chars, chars, n_tokens, in_loss = counts.tolist()
                out.append((conv_id, n_turns, shas[0].hexdigest(), loss_chars, shas[1].hexdigest(), chars, n_tokens, in_loss))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                conv, part, text = (batch.column(name)[i].as_py() for name in ("conv_id", "part", "formatted"))
                starts, ends, mask = (batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in ("token_start", "token_end", "loss_mask"))
                if part == 0:
                    end()
                    conv_id, parts, counts, shas = conv, 0, np.zeros(5, np.int64), [hashlib.sha256(), hashlib.sha256()]
                if part != parts or conv != conv_id:
                    raise ValueError(f"part {part} of conversation {conv} does not follow the one before it")
                parts += 1
                turns = _TURN.findall(text)
                loss = "".join(masked_texts(text, starts, ends, mask))
                shas[0].update("".join(f"{unescape(role)}\n{unescape(said)}\n" for role, said in turns).encode("utf-8", "surrogatepass"))
                shas[1].update(loss.encode("utf-8", "surrogatepass"))
                counts += np.array([len(turns), len(loss), len(text), len(mask), int(mask.sum())])
            if out:
                yield batch_of(out)
                out = []
        end()
        if out:
            yield batch_of(out)

    columns = ["conv_id", "part", "formatted", "token_start", "token_end", "loss_mask"]
    return formatted.select(*columns).mapInArrow(run, kept)
