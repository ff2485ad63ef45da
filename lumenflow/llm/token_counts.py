"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens go into a trie. The best score of a trie node is the best over pieces that end
there of the piece's score plus the best score of the node where the piece starts, so a prefix shared
by many pre-tokens is computed once. Terminal nodes keep the number of pieces on the best path; a
document's count is the sum over its pre-tokens. Long pre-tokens share little: for them the pieces
that begin at each byte are looked up first, and the best path runs over those.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenflow.llm.words import Block, Prefix, blocks, spans

SCHEMA = "doc_id long, n_bytes long, n_pretokens long, n_tokens long"


@dataclass(frozen=True)
class CountConfig:
    """``vocabulary``: ranked byte pieces, one "base64 rank" a line, all single bytes among them.

    A piece of rank r scores ``-log(r + shift)`` (Zipf's law). Pre-tokens are scored whole. Those of
    more than ``shared`` bytes stay out of the trie, with the same result, and are worked on
    ``stretch`` bytes at a time. ``cache_words``: pre-tokens a worker remembers.
    """

    vocabulary: str
    shift: float = 2.7
    shared: int = 64
    stretch: int = 1 << 16
    cache_words: int = 1 << 20


class Pieces:
    """Hashes and scores of a vocabulary."""

    def __init__(self, config: CountConfig):
        with open(config.vocabulary, "rb") as lines:
            table = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]
        data = np.frombuffer(b"".join(p for p, _ in table), np.uint8)
        length = np.fromiter((len(p) for p, _ in table), np.int64, len(table))
        end = np.cumsum(length)
        prefix = Prefix(data)
        key = prefix.of(end - length, end)
        order = np.argsort(key)
        self.key = key[order]
        self.score = -np.log(np.array([r for _, r in table])[order] + config.shift)
        self.lengths = np.unique(length)[::-1]  # longest first: it wins ties
        start = end - length
        begins = [prefix.of(start[length >= k], start[length >= k] + k) for k in range(1, self.lengths[0] + 1)]
        self.begin = np.unique(np.concatenate(begins))  # what a piece can begin with, whole pieces among it
        self.begin_score = self.of(self.begin)

    def of(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.score[at], -np.inf)

    def starting(self, prefix: Prefix, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that begin at each of ``at`` and end by ``stop``: index into ``at``, length, score; by index and length."""
        live = np.arange(len(at))
        found = []
        for size in range(1, int(self.lengths[0]) + 1):
            live = live[at[live] + size <= stop[live]]
            key = prefix.of(at[live], at[live] + size)
            place = np.minimum(np.searchsorted(self.begin, key), len(self.begin) - 1)
            on = self.begin[place] == key
            live, score = live[on], self.begin_score[place[on]]
            if not len(live):
                break
            whole = score > -np.inf
            found.append((live[whole], np.full(int(whole.sum()), size), score[whole]))
        which, size, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(which, kind="stable")
        return which[order], size[order], score[order]


def pretokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of pre-tokens: a word with the one 0x20 before it, else a white-space byte."""
    start, end = spans(block)
    row = np.searchsorted(block.offsets, start, "right") - 1
    before = np.maximum(start - 1, 0)
    start = start - ((start > block.offsets[row]) & (block.data[before] == 0x20))
    covered = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(covered, start, 1)
    np.add.at(covered, end, -1)
    lone = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    start, end = np.concatenate((start, lone)), np.concatenate((end, lone + 1))
    return start, end, np.searchsorted(block.offsets, start, "right") - 1


def best_counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Pieces on the best path of each of some distinct pre-tokens."""
    order = np.argsort(start - end, kind="stable")  # longest first: those that reach a depth come first
    start, length = start[order], (end - start)[order]
    prefix = Prefix(data)
    reach = np.searchsorted(-length, -np.arange(length.max(initial=0) + 1), "right")
    result = np.zeros(len(start), np.int64)
    node = [np.zeros(len(start), np.int64)]
    best, count = [np.zeros(1)], [np.zeros(1, np.int64)]
    for depth in range(1, len(reach)):
        n = reach[depth]
        _, first, which = np.unique(
            prefix.of(start[:n], start[:n] + depth), return_index=True, return_inverse=True
        )
        score, steps = np.full(len(first), -np.inf), np.zeros(len(first), np.int64)
        stop = start[first] + depth
        for size in pieces.lengths[pieces.lengths <= depth]:
            origin = node[depth - size][first]
            value = pieces.of(prefix.of(stop - size, stop)) + best[depth - size][origin]
            better = value > score
            score[better] = value[better]
            steps[better] = count[depth - size][origin][better] + 1
        node.append(which)
        best.append(score)
        count.append(steps)
        done = slice(reach[depth + 1] if depth + 1 < len(reach) else 0, n)
        result[done] = steps[which[done]]
    out = np.zeros(len(start), np.int64)
    out[order] = result
    return out


def long_counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces, stretch: int) -> np.ndarray:
    """Like ``best_counts``, for pre-tokens that share little: one after another, ``stretch`` bytes at a time.

    Byte k of pre-token t has slot (bytes of earlier pre-tokens) + t + k, and the pre-token's end one more.
    Scores of a slot are final once all earlier bytes have passed on theirs; what a stretch has passed
    on beyond its end is carried over.
    """
    out = np.zeros(len(start), np.int64)
    total = np.concatenate(([0], np.cumsum(end - start)))
    prefix, reach = Prefix(data), int(pieces.lengths[0])
    best: list[float] = []
    count: list[int] = []
    base = 0
    for a in range(0, int(total[-1]), stretch):
        index = np.arange(a, min(a + stretch, int(total[-1])))
        token = np.searchsorted(total, index, "right") - 1
        slot = index + token
        del best[: slot[0] - base], count[: slot[0] - base]
        base = int(slot[0])
        more = int(slot[-1]) + reach + 1 - base - len(best)
        best += [-np.inf] * more
        count += [0] * more
        for first in np.flatnonzero(index == total[token]).tolist():
            best[int(slot[first]) - base] = 0.0
        which, size, score = pieces.starting(prefix, start[token] + index - total[token], end[token])
        origin = slot[which] - base
        for i, j, value in zip(origin.tolist(), (origin + size).tolist(), score.tolist(), strict=True):
            value += best[i]
            if value > best[j]:  # longer pieces come first: they win ties
                best[j] = value
                count[j] = count[i] + 1
        for last in np.flatnonzero(index + 1 == total[token + 1]).tolist():
            out[token[last]] = count[int(slot[last]) + 1 - base]
    return out


def token_counts(docs: DataFrame, config: CountConfig) -> DataFrame:
    """Per row: doc_id, n_bytes, n_pretokens, n_tokens of the whole text.

    Null and empty text count 0. Repeated rows are counted alike; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(config)
        known: dict[int, int] = {}
        for batch in batches:
            names = batch.schema.names
            n = batch.num_rows
            sizes, found, tokens = (np.zeros(n, np.int64) for _ in range(3))
            for block in blocks(batch.column(names.index("text"))):
                start, end, row = pretokens(block)
                distinct, first, which = np.unique(
                    Prefix(block.data).of(start, end), return_index=True, return_inverse=True
                )
                if len(known) + len(distinct) > config.cache_words:
                    known.clear()
                keys = distinct.tolist()
                new = np.array([k for k, key in enumerate(keys) if key not in known], np.int64)
                if len(new):
                    a, b = start[first[new]], end[first[new]]
                    long = b - a > config.shared
                    counts = np.zeros(len(new), np.int64)
                    counts[~long] = best_counts(block.data, a[~long], b[~long], pieces)
                    counts[long] = long_counts(block.data, a[long], b[long], pieces, config.stretch)
                    known.update(zip((keys[k] for k in new), counts.tolist(), strict=True))
                each = np.fromiter((known[k] for k in keys), np.int64, len(keys))[which]
                rows = len(block.offsets) - 1
                here = slice(block.first, block.last)
                sizes[here] = np.diff(block.offsets)
                found[here] = np.bincount(row, minlength=rows)
                tokens[here] = np.bincount(row, weights=each, minlength=rows)
            arrays = [batch.column(names.index("doc_id")), *map(pa.array, (sizes, found, tokens))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
