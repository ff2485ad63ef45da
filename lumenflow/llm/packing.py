"""Pack documents into training sequences, balancing estimated attention cost.

A document's full stretches of ``capacity`` tokens are sequences by themselves. The tails are
assigned in descending order, each to the sequence of lowest cost (linear plus quadratic in the
lengths of its pieces) that still has room. What fits nowhere whole is cut into the gaps, and tokens
beyond a multiple of the capacity go to sequences of power-of-two length, which need no padding.
Packing groups hold a bounded number of tokens inside a partition: no shuffle, bounded memory.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lumenflow.llm.words import Block, Prefix, Words, blocks, spans, words

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class PackConfig:
    """``vocabulary``: tokenizer file. ``group_tokens``: tail tokens packed together.

    ``linear`` and ``quadratic``: cost of a piece of n tokens is ``linear * n + quadratic * n**2``.
    ``cache_words``: distinct words a worker remembers before it starts over.
    """

    vocabulary: str
    capacity: int = 2048
    end_id: int = 1
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    group_tokens: int = 1 << 21
    cache_words: int = 1 << 19


LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
MARK = np.zeros(256, bool)
MARK[list(b".,;:!?*&%$#")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ONE, THREE = np.uint64(1), np.uint64(3)


def pretokens(block: Block) -> Words:
    """Words, with the marks that end a word cut off behind an ASCII letter, keyed without case.

    The vocabulary lower-cases and never merges across white space or from letters to marks, so ids
    of these parts laid end to end are the ids of the text. Words with ``|`` keep their case: special
    tokens are spelled with it.
    """
    data = block.data
    start, end = spans(block)
    if not len(start):
        return words(block)
    solid = np.maximum.accumulate(np.where(MARK[data], -1, np.arange(len(data))))[end - 1]
    cut = np.flatnonzero((solid >= start) & (solid < end - 1) & LETTER[data[np.maximum(solid, 0)]])
    middle = solid[cut] + 1
    start, end = np.concatenate((start, middle)), np.concatenate((end, end[cut]))
    end[cut] = middle
    order = np.argsort(start)
    start, end = start[order], end[order]
    folded = LOWER[data]
    bar = data == 0x7C
    if bar.any():
        bars = np.concatenate(([0], np.cumsum(bar)))
        exact = within(len(data), start, end, bars[end] > bars[start])
        folded[exact] = data[exact]
    return Words(start, end, np.searchsorted(block.offsets, start, "right") - 1, keys(folded, start, end))


def within(n: int, start: np.ndarray, end: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes lie in the chosen words."""
    step = np.zeros(n + 1, np.int8)
    step[start[which]] = 1
    step[end[which]] -= 1
    return np.cumsum(step[:n], dtype=np.int8).view(bool)


def keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of words: up to 7 bytes the bytes and their number, longer ones a hash with top bit set."""
    size = end - start
    eight = np.ndarray(len(data), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    long = size > 7
    short = np.where(long, 0, size).astype(np.uint64)
    key = (eight[start] & ((ONE << (short << THREE)) - ONE)) | short << np.uint64(56)
    if long.any():
        bound = np.concatenate(([0], np.cumsum(size[long])))
        hashed = Prefix(data[within(len(data), start, end, long)]).of(bound[:-1], bound[1:])
        key[long] = hashed >> ONE | ONE << np.uint64(63)
    return key


class WordTokens:
    """Token ids of pre-tokens, each distinct one tokenised once."""

    def __init__(self, path: str, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of known words, ascending
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        encode = self.tokenizer.encode_batch_fast
        some = (texts[k : k + 2048] for k in range(0, len(texts), 2048))
        parts = [e.ids for part in some for e in encode(part, add_special_tokens=False)]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, len(self.ids) + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        flat = np.fromiter(chain.from_iterable(parts), np.int32, int(count.sum()))
        self.ids = np.concatenate((self.ids, flat))

    def encode(self, block: Block, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by ``end_id``, and where the rows begin."""
        found = pretokens(block)
        rows = len(block.offsets) - 1
        distinct, sample, which = np.unique(found.hash, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.limit:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            content = block.data.tobytes()
            new = sample[~known]
            bounds = zip(found.start[new].tolist(), found.end[new].tolist(), strict=True)
            self.learn(distinct[~known], [content[a:b].decode("utf-8", "replace") for a, b in bounds])
            at = np.searchsorted(self.keys, distinct)
        slots = at[which]
        count = self.count[slots]
        before = np.cumsum(count) - count
        total = int(count.sum())
        source = np.arange(total) + np.repeat(self.first[slots] - before, count)
        out = np.full(total + rows, end_id, np.int32)
        out[np.arange(total) + np.repeat(found.row, count)] = self.ids[source]
        per_row = np.bincount(found.row, weights=count, minlength=rows).astype(np.int64) + 1
        return out, np.concatenate(([0], np.cumsum(per_row)))


_workers: dict[tuple[str, int], WordTokens] = {}


def loaded(path: str, limit: int) -> WordTokens:
    """One tokenizer per Python worker, which later tasks find again."""
    if (path, limit) not in _workers:
        _workers[path, limit] = WordTokens(path, limit)
    return _workers[path, limit]


def assign(lengths: list[int], config: PackConfig) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece, start in the piece, length); every sequence is exactly full."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    full, rest = divmod(sum(lengths), config.capacity)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(full)]
    room = [config.capacity] * full
    cheap = [(0.0, b) for b in range(full)]
    narrow: list[tuple[int, float, int]] = []  # sequences without room for the piece at hand, widest first
    left = []
    for k in order:
        n = lengths[k]
        while narrow and -narrow[0][0] >= n:
            _, cost, b = heapq.heappop(narrow)
            heapq.heappush(cheap, (cost, b))
        while cheap and room[cheap[0][1]] < n:
            cost, b = heapq.heappop(cheap)
            heapq.heappush(narrow, (-room[b], cost, b))
        if not cheap:
            left.append(k)
            continue
        cost, b = heapq.heappop(cheap)
        held[b].append((k, 0, n))
        room[b] -= n
        if room[b]:
            heapq.heappush(cheap, (cost + config.linear * n + config.quadratic * n * n, b))
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            held.append([])
            room.append(1 << bit)
    gaps = sorted((b for b in range(len(room)) if room[b]), key=lambda b: -room[b])
    at = 0
    for k in left:
        start = 0
        while start < lengths[k]:
            b = gaps[at]
            n = min(room[b], lengths[k] - start)
            held[b].append((k, start, n))
            start += n
            room[b] -= n
            at += not room[b]
    return held


def packed(docs: DataFrame, config: PackConfig) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian 32 bit), doc_tokens, sequence_id, offset.

    Null text is empty and gives the end id alone. Every row is a document of its own, also repeated
    rows and rows whose doc_id is null. An empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(config.vocabulary, config.cache_words)
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        tails: list[tuple] = []
        waiting = 0
        capacity = config.capacity

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(column, t) for column, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        def settle() -> None:
            nonlocal sequence
            for held in assign([len(t[2]) for t in tails], config):
                offset = 0
                for k, start, n in held:
                    doc, first, ids, total = tails[k]
                    out.append((doc, first + start, n, ids[start : start + n].tobytes(), total, sequence, offset))
                    offset += n
                sequence += 1
            tails.clear()

        for batch in batches:
            names_of = batch.schema.names
            docs_of = batch.column(names_of.index("doc_id")).to_pylist()
            for block in blocks(batch.column(names_of.index("text"))):
                ids, begin = tokens.encode(block, config.end_id)
                for r in range(len(begin) - 1):
                    own = ids[begin[r] : begin[r + 1]]
                    doc, total = docs_of[block.first + r], len(own)
                    whole = total // capacity * capacity
                    for start in range(0, whole, capacity):
                        out.append((doc, start, capacity, own[start : start + capacity].tobytes(), total, sequence, 0))
                        sequence += 1
                    if whole < total:
                        tails.append((doc, whole, own[whole:].copy(), total))
                        waiting += total - whole
                if waiting >= config.group_tokens:
                    settle()
                    waiting = 0
                if len(out) >= 1000:
                    yield flush()
        settle()
        if out:
            yield flush()

    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
