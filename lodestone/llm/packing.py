"""Packing: best-fit decreasing into windows of a fixed number of tokens.

Documents are tokenised and closed with an end id. Overlong ones are first cut
into full windows, each a sequence of its own. What is left of each document is
placed, longest first, into the open sequence with the least room that still
suffices; a segment tree indexed by remaining capacity finds it in O(log window).
A sequence that is still emptier than `repair` at the end is dissolved into
sequences whose lengths are powers of two, which need no padding.

A partition of the input is packed where it is read, at most `MAX_OPEN_IDS` ids at
a time: there is no shuffle, memory is bounded, and a lost task is redone alone. A
sequence's number joins its partition's number and a count within it.

Defined results: null and empty texts are one end id. Each row is a document of its
own, so repeated rows and null keys are packed like others. Texts are tokenised
whole. An empty table gives no sequences.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory, ship_by_value

ship_by_value(__name__)

#: A flush happens at the latest when so many ids wait in a partition.
MAX_OPEN_IDS = 8_000_000
PARTITION_BITS = 40


def _below_256(text: str) -> bool:
    """Whether all characters are below U+0100: their lower case is one character each, and composed already."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Tokens:
    """Token ids by a vocabulary file of `tokenizers`, remembered for strings between spaces.

    The file's rules drop white space and never join tokens across it, nor across the
    place where letters end and other signs begin. So a text's ids are those of its
    strings between spaces and line ends, one after another, and a string of letters
    with signs behind it has those of the letters, then those of the signs. A text that
    has the name of one of the vocabulary's added tokens goes to the tokenizer whole.
    """

    SIGNS = ".,;:!?*$%&#|\")"

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.exact = [t.content for t in added if not t.normalized]
        self.folded = [t.content.lower() for t in added if t.normalized]
        self.most, self.known = most, {}

    @classmethod
    def of_process(cls, path: str) -> Tokens:
        """One for all tasks of a Python worker."""
        kept = sys.modules.setdefault("_lodestone_tokens", types.ModuleType("_lodestone_tokens"))
        if path not in kept.__dict__:
            kept.__dict__[path] = cls(path)
        return kept.__dict__[path]

    def learn(self, strings: set[str]) -> None:
        known, split, plain = self.known, [], set()
        for s in strings:
            core = s.rstrip(self.SIGNS)
            if core != s and core.isalpha():
                split.append((s, core))
                plain |= {core, s[len(core) :]}
            else:
                plain.add(s)
        listed = [s for s in plain if s not in known]
        for s, e in zip(listed, self.tokenizer.encode_batch_fast(listed, add_special_tokens=False), strict=True):
            known[s] = np.array(e.ids, "<u4").tobytes()
        for s, core in split:
            known[s] = known[core] + known[s[len(core) :]]

    def ids(self, text: str) -> np.ndarray:
        known = self.known
        if any([name in text for name in self.exact]) or any([name in text.lower() for name in self.folded]):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if _below_256(text):
            text = text.lower()
        strings = text.replace("\n", " ").split(" ")
        new = {s for s in strings if s not in known}
        if new:
            if len(known) + len(new) > self.most:
                known.clear()
                new = set(strings)
            self.learn(new)
        return np.frombuffer(b"".join([known[s] for s in strings]), "<u4")


class CapacityTree:
    """Counts of open sequences by remaining capacity, 1 to `window`."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.counts = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        if capacity:
            self.open[capacity].append(sequence)
            i = capacity + self.size
            while i:
                self.counts[i] += 1
                i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes the tightest open sequence with room for `need`; its capacity and number."""
        i = need + self.size
        if not self.counts[i]:
            while i > 1 and (i & 1 or not self.counts[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.counts[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            self.counts[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """For each length (1 to window) its sequence, and the fill of each sequence."""
    tree, fills, chosen = CapacityTree(window), [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        need = lengths[i]
        found = tree.take(need)
        if found is None:
            capacity, at = window, len(fills)
            fills.append(0)
        else:
            capacity, at = found
        fills[at] += need
        chosen[i] = at
        tree.add(capacity - need, at)
    return chosen, fills


def plan(lengths: list[int], window: int, repair: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover documents of these lengths."""
    pieces, sequence = [], 0
    rest, owner = [], []
    for d, n in enumerate(lengths):
        full = n // window
        for k in range(full):
            pieces.append((d, k * window, window, sequence, 0))
            sequence += 1
        if n % window:
            rest.append(n % window)
            owner.append((d, full * window))
    chosen, fills = best_fit_decreasing(rest, window)
    numbers, offsets = {}, {}
    loose: dict[int, list[int]] = {}
    for i, at in enumerate(chosen):
        if fills[at] < repair * window:
            loose.setdefault(at, []).append(i)
            continue
        if at not in numbers:
            numbers[at], offsets[at] = sequence, 0
            sequence += 1
        d, start = owner[i]
        pieces.append((d, start, rest[i], numbers[at], offsets[at]))
        offsets[at] += rest[i]
    for at, members in loose.items():
        left = fills[at]
        room, offset = 1 << (left.bit_length() - 1), 0
        for i in members:
            (d, start), n = owner[i], rest[i]
            while n:
                put = min(n, room - offset)
                pieces.append((d, start, put, sequence, offset))
                start, n, offset, left = start + put, n - put, offset + put, left - put
                if offset == room:
                    sequence += 1
                    offset, room = 0, 1 << (left.bit_length() - 1) if left else 1
    return pieces


PIECES = pa.schema([
    ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
PIECES_DDL = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _copied(values: pa.Array, at: int, to: int) -> pa.Array:
    """A part of a column with memory of its own; a slice keeps all columns of its batch, which came as one buffer."""
    return values.take(pa.array(np.arange(at, to)))


def pack(docs: DataFrame, key: str, tokenizer_path: str, window: int = 2048, end_id: int = 1, repair: float = 0.9, with_ids: bool = False) -> DataFrame:
    """Rows for pieces: `key` of the document and PIECES, with the ids themselves if asked for.

    `key` is any column of `docs`; texts are in `text`.
    """
    kind = docs.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, {PIECES_DDL}" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of_process(tokenizer_path)
        first = TaskContext.get().partitionId() << PARTITION_BITS
        keys, ids, waiting = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, keys, ids, waiting
            pieces = plan([len(x) for x in ids], window, repair)
            held = pa.concat_arrays(keys)
            for at in range(0, len(pieces), 10_000):
                part = pieces[at : at + 10_000]
                d, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*part, strict=True))
                cuts = [ids[i][a : a + n] for i, a, n, _, _ in part]
                columns = [
                    held.take(pa.array(d)), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(c.tobytes()) for c in cuts], pa.int64()),
                    pa.array([len(ids[i]) for i in d.tolist()], pa.int64()),
                    pa.array(sequence + first), pa.array(offset),
                ]
                names = [key, *PIECES.names]
                if with_ids:
                    columns.append(pa.array([c.astype(np.int64) for c in cuts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
            first += max((p[3] for p in pieces), default=-1) + 1
            keys, ids, waiting = [], [], 0

        end = np.array([end_id], "<u4")
        for batch in batches:
            texts, at = batch.column(1), 0
            for i, text in enumerate(texts):
                found = np.concatenate([tokens.ids(text.as_py() or ""), end])
                ids.append(found)
                waiting += len(found)
                if waiting >= MAX_OPEN_IDS:
                    keys.append(_copied(batch.column(0), at, i + 1))
                    at = i + 1
                    yield from flush()
            if at < len(texts):
                keys.append(_copied(batch.column(0), at, len(texts)))
        if ids:
            yield from flush()
        free_memory()

    return docs.select(F.col(key), F.col("text")).mapInArrow(run, ddl)
