"""Byte-level BPE encoding and decoding over padded numpy matrices.

Texts are cut by the vocabulary's pattern. Distinct matches that are no token themselves are bucketed by length and
become rows of a padded matrix of byte tokens. Every round merges the leftmost pair of minimum rank in each row: ranks of
pairs come from an open-addressed hash table, the merged pair's right half is squeezed out, its two neighbours are looked
up again, and finished rows leave. All rows lose one token a round, so the matrix loses a column.

A match of more than ``LONG`` bytes is a matrix of one row, in which one merge a round would take quadratic time. There a
round merges all occurrences of the minimum pair from the left, up to and including the first whose merge makes a pair of
lower rank beside it; that is the same sequence of merges.

Defined results: a null text is empty and has no tokens. Tokens of a text equal those of the rank file's reference
encoder without special tokens; characters that the pattern does not match would be dropped, and with the given pattern
there are none. All other columns stay, but for ones named as the output.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logfathom.llm.common import mix64

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG = 256  # bytes of a match from which on it is merged by itself
CELLS = 1 << 20  # of one matrix
CACHED = 1 << 17  # matches whose tokens a task remembers, of 64 bytes at most each
MATCHES = 1 << 15  # that are looked at together
ROWS = 256  # of a batch that are worked on together
NONE = np.int32(np.iinfo(np.int32).max)
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a line each, base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Open-addressed hash table from pairs of tokens to the token that they merge to."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [
            (left << 32 | right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        pairs, merged = np.array([p for p, _ in found], np.uint64), np.array([r for _, r in found], np.int32)
        size = 1 << (2 * len(found) + 1).bit_length()
        self.mask = np.uint64(size - 1)
        self.pairs, self.merged = np.full(size, _FREE, np.uint64), np.full(size, NONE, np.int32)
        slot = mix64(pairs) & self.mask
        while len(pairs):
            free = np.flatnonzero(self.pairs[slot] == _FREE)
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.pairs[slot[placed]], self.merged[slot[placed]] = pairs[placed], merged[placed]
            left = np.ones(len(pairs), bool)
            left[placed] = False
            pairs, merged, slot = pairs[left], merged[left], (slot[left] + np.uint64(1)) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` where they don't merge; negative tokens are padding."""
        pair = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out = np.full(pair.shape, NONE, np.int32)
        flat, keys = out.reshape(-1), pair.reshape(-1)
        todo = np.flatnonzero((left.reshape(-1) >= 0) & (right.reshape(-1) >= 0))
        slot = mix64(keys[todo]) & self.mask
        while len(todo):
            seen = self.pairs[slot]
            hit = seen == keys[todo]
            flat[todo[hit]] = self.merged[slot[hit]]
            on = ~hit & (seen != _FREE)
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & self.mask
        return out


def merge_rows(tokens: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merged tokens of the rows of a padded matrix (padding is -1), one row's after another, and their numbers."""
    done, left = np.full(tokens.shape, -1, np.int32), np.array(lengths)
    rows = np.arange(len(tokens))
    ranks = table.rank(tokens[:, :-1], tokens[:, 1:])
    while ranks.shape[1]:
        each = np.arange(len(rows))
        at = ranks.argmin(axis=1)
        best = ranks[each, at]
        live = best < NONE
        if not live.all():
            done[rows[~live], : tokens.shape[1]] = tokens[~live]
            rows, tokens, ranks, at, best = rows[live], tokens[live], ranks[live], at[live], best[live]
            each = np.arange(len(rows))
        if not len(rows):
            break
        left[rows] -= 1
        width = tokens.shape[1] - 1
        tokens[each, at] = best
        stay = np.ones(tokens.shape, bool)
        stay[each, at + 1] = False
        tokens = tokens[stay].reshape(len(rows), width)
        stay = stay[:, 1:]  # the merged pair's own rank goes
        ranks = ranks[stay].reshape(len(rows), width - 1)
        before, after = at > 0, at < width - 1
        ranks[each[before], at[before] - 1] = table.rank(tokens[each[before], at[before] - 1], best[before])
        ranks[each[after], at[after]] = table.rank(best[after], tokens[each[after], at[after] + 1])
    done[rows, : tokens.shape[1]] = tokens
    return done[done >= 0], left


def merge_long(tokens: np.ndarray, table: PairTable) -> np.ndarray:
    """Merged tokens of one long row."""
    ranks = table.rank(tokens[:-1], tokens[1:])
    while len(ranks) and (best := ranks.min()) < NONE:
        at = np.flatnonzero(ranks == best)
        begins = np.r_[True, np.diff(at) > 1]
        at = at[(at - at[begins][np.cumsum(begins) - 1]) % 2 == 0]  # pairs don't overlap
        behind = np.r_[False, np.diff(at) == 2]
        merged = np.full(len(at), best, np.int32)
        left = np.where(at > 0, np.where(behind, best, tokens[np.maximum(at - 1, 0)]), -1)
        right = np.where(at + 2 < len(tokens), tokens[np.minimum(at + 2, len(tokens) - 1)], -1)
        lower = np.flatnonzero(np.minimum(table.rank(left, merged), table.rank(merged, right)) < best)
        if len(lower):
            at = at[: lower[0] + 1]
        tokens[at] = best
        stay = np.ones(len(tokens), bool)
        stay[at + 1] = False
        place = at - np.arange(len(at))
        tokens, ranks = tokens[stay], ranks[stay[1:]]
        anew = np.unique(np.r_[place - 1, place])
        anew = anew[(anew >= 0) & (anew < len(ranks))]
        ranks[anew] = table.rank(tokens[anew], tokens[anew + 1])
    return tokens


class Encoder:
    """Tokens of texts under one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], table: PairTable, pattern: str):
        self.ranks, self.table, self.pattern = ranks, table, regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}

    def _merge(self, matches: list[bytes]) -> list[bytes]:
        """Packed tokens of matches that are no tokens themselves, bucketed by length."""
        out = [b""] * len(matches)
        if not matches:
            return out
        sizes = np.array([len(m) for m in matches])
        order = np.argsort(sizes, kind="stable")
        ends = np.r_[0, np.flatnonzero(np.diff(np.ceil(2 * np.log2(sizes[order])))) + 1, len(order)]
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            width = int(sizes[order[high - 1]])
            rows = max(1, CELLS // width) if width <= LONG else 1
            for begin in range(low, high, rows):
                own = order[begin : min(begin + rows, high)]
                if width > LONG:
                    out[own[0]] = merge_long(self.of_byte[np.frombuffer(matches[own[0]], np.uint8)], self.table).astype("<u4").tobytes()
                    continue
                joined = self.of_byte[np.frombuffer(b"".join([matches[i] for i in own]), np.uint8)]
                tokens = np.full((len(own), width), -1, np.int32)
                tokens[np.arange(width)[None, :] < sizes[own][:, None]] = joined
                flat, numbers = merge_rows(tokens, sizes[own], self.table)
                packed, cuts = flat.astype("<u4").tobytes(), np.cumsum([0, *(4 * numbers)]).tolist()
                for i, begun, ended in zip(own.tolist(), cuts[:-1], cuts[1:], strict=True):
                    out[i] = packed[begun:ended]
        return out

    def _learn(self, matches: set[str]) -> dict[str, bytes]:
        """Packed tokens of the matches that are new, remembered if short."""
        if len(self.known) > CACHED:
            self.known.clear()
        unseen = list(matches.difference(self.known))
        raws = [match.encode("utf-8", "surrogatepass") for match in unseen]
        whole = [self.ranks.get(raw) for raw in raws]
        merged = iter(self._merge([raw for raw, rank in zip(raws, whole, strict=True) if rank is None]))
        new = {match: next(merged) if rank is None else rank.to_bytes(4, "little") for match, rank in zip(unseen, whole, strict=True)}
        self.known.update(new if max(map(len, unseen), default=0) <= 64 else {m: t for m, t in new.items() if len(m) <= 64})
        return new

    def _pack(self, groups: list[list[str]]) -> list[bytes]:
        new = self._learn(set().union(*groups))
        known = self.known
        if all(len(m) <= 64 for m in new):
            return [b"".join([known[m] for m in found]) for found in groups]
        return [b"".join([known.get(m) or new[m] for m in found]) for found in groups]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text; short texts share matrices, a long one is read in runs of ``MATCHES`` matches."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        waiting, size = [], 0

        def flush():
            for (i, _), packed in zip(waiting, self._pack([found for _, found in waiting]), strict=True):
                out[i] = np.frombuffer(packed, "<u4").astype(np.int32)

        for i, text in enumerate(texts):
            if len(text or "") > MATCHES:
                cut = self.pattern.finditer(text)
                runs = []
                while found := [m.group() for m in islice(cut, MATCHES)]:
                    runs += self._pack([found])
                out[i] = np.frombuffer(b"".join(runs), "<u4").astype(np.int32)
            elif text:
                waiting.append((i, self.pattern.findall(text)))
                size += len(waiting[-1][1])
                if size > MATCHES:
                    flush()
                    waiting, size = [], 0
        if waiting:
            flush()
        return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a worker holds little beside the batch it was given."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _carried(df: DataFrame, keep: Sequence[str] | None, *made: T.StructField) -> tuple[list[str], T.StructType]:
    names = [c for c in (df.columns if keep is None else keep) if c not in {f.name for f in made}]
    return names, T.StructType([*(df.schema[c] for c in names), *made])


def _lists(part: pa.RecordBatch, ids: str) -> Iterator[np.ndarray]:
    """The token ids of each row; a null row has none."""
    for row in part.column(ids):
        yield row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.empty(0, np.int32)


def encode(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", out: str = "ids", keep: Sequence[str] | None = None
) -> DataFrame:
    """Adds the token ids (array<int>) of each whole text to the kept columns, all by default. The vocabulary is read by the
    driver and broadcast: its size is the rank file's, never the data's."""
    ranks = load_ranks(path or public_tokenizers.path(VOCABULARY))
    shared = docs.sparkSession.sparkContext.broadcast((ranks, PairTable(ranks), pattern or public_tokenizers.PATTERN))
    names, schema = _carried(docs, keep, T.StructField(out, T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for part in _parts(batches):
            got = encoder.encode(part.column(text).to_pylist())
            ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), ids], names=[*names, out])

    return docs.mapInArrow(run, schema)


def _token_bytes(spark, path: str | None):
    ranks = load_ranks(path or public_tokenizers.path(VOCABULARY))
    return spark.sparkContext.broadcast({rank: token for token, rank in ranks.items()})


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded", keep: Sequence[str] | None = None) -> DataFrame:
    """Adds the bytes (binary) that the token ids stand for to the kept columns; null ids give no bytes."""
    shared = _token_bytes(encoded.sparkSession, path)
    names, schema = _carried(encoded, keep, T.StructField(out, T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for part in _parts(batches):
            raw = pa.array([b"".join([of[i] for i in own.tolist()]) for own in _lists(part, ids)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), raw], names=[*names, out])

    return encoded.mapInArrow(run, schema)


def read_back(encoded: DataFrame, path: str | None = None, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """What the encoded rows hold: number of tokens, digest of the ids as little-endian unsigned 32-bit integers, and of the
    bytes that they decode to."""
    shared = _token_bytes(encoded.sparkSession, path)
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    names, schema = _carried(encoded, keep, *made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for part in _parts(batches):
            rows = [
                (len(own), sha256(own.astype("<u4").tobytes()).hexdigest(), sha256(b"".join([of[i] for i in own.tolist()])).hexdigest())
                for own in _lists(part, ids)
            ]
            found = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *found], names=schema.names)

    return encoded.mapInArrow(run, schema)
