"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade <= k) = logistic(threshold_k - score), where all thresholds share one score: the weighted sum
of a text's hashed words, beginnings of words and style marks. The fit uses a bounded sample of rated
documents; scoring is a pass over all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.packing import pretokens
from lumenflow.llm.words import Block, Prefix, Words, blocks, mix, words


@dataclass(frozen=True)
class OrdinalConfig:
    """``sample``: most rated documents fitted on, those with the smallest hashed ids; of these only
    texts of at most ``sample_chars`` (training only). ``bits``: log2 of the weights; those of features
    in fewer than ``least_docs`` sampled texts stay 0.

    ``keep_grade`` and ``cut``: a document is kept if P(grade >= keep_grade) >= cut.
    """

    grades: int = 3
    bits: int = 20
    least_docs: int = 5
    sample: int = 8000
    sample_chars: int = 200_000
    rounds: int = 300
    rate: float = 0.3
    penalty: float = 1e-4
    keep_grade: int = 2
    cut: float = 0.5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


CLASS = np.full(256, 4, np.int64)  # other marks
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256))):
    CLASS[list(_bytes)] = _k
CLASS[list(b".,;:")] = 5


def style(block: Block, found: Words) -> np.ndarray:
    """Per row, feature keys of how it is written: tenths of words by first and last byte's class, of
    words that repeat the one before, of distinct words, and the magnitude of the word count."""
    rows = len(block.offsets) - 1
    count = np.maximum(np.bincount(found.row, minlength=rows), 1)
    shares = []
    for place in (found.start, found.end - 1):
        kind = CLASS[block.data[place]]
        table = np.bincount(found.row * 6 + kind, minlength=rows * 6).reshape(rows, 6)
        shares += list((10 * table / count[:, None]).astype(np.int64).T)
    same = (found.hash[1:] == found.hash[:-1]) & (found.row[1:] == found.row[:-1])
    shares.append(10 * np.bincount(found.row[1:][same], minlength=rows) // count)
    order = np.lexsort((found.hash, found.row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (found.hash[order][1:] != found.hash[order][:-1]) | (found.row[order][1:] != found.row[order][:-1])
    shares.append(10 * np.bincount(found.row[order][fresh], minlength=rows) // count)
    shares.append(np.log2(count).astype(np.int64))
    keys = np.stack(shares, 1) + 1000 * np.arange(1, len(shares) + 1)
    return mix(keys.astype(np.uint64))


def features(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each row laid end to end, and where rows begin.

    They stand for words, beginnings of words and style. A row without words has none.
    """
    found = pretokens(block)
    rows = len(block.offsets) - 1
    keys, owners = [found.hash], [found.row]
    prefix = Prefix(block.data, lower=True)
    for n in (5, 7):
        own = np.flatnonzero(found.end - found.start > n)
        keys.append(mix(prefix.of(found.start[own], found.start[own] + n) + np.uint64(n)))
        owners.append(found.row[own])
    key = np.concatenate(keys) >> np.uint64(64 - bits)
    row = np.concatenate(owners).astype(np.uint64)
    distinct = np.unique(row << np.uint64(bits) | key)
    row = (distinct >> np.uint64(bits)).astype(np.int64)
    count = np.bincount(row, minlength=rows)
    some = np.flatnonzero(count)
    manner = style(block, words(block))[some] >> np.uint64(64 - bits)
    row = np.concatenate((row, np.repeat(some, manner.shape[1])))
    index = np.concatenate((distinct & np.uint64((1 << bits) - 1), manner.ravel())).astype(np.int32)
    order = np.argsort(row, kind="stable")
    begin = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))
    return index[order], begin


def fit(index: np.ndarray, begin: np.ndarray, grade: np.ndarray, config: OrdinalConfig) -> Model:
    """Maximum likelihood by gradient steps with momentum; without rated rows, flat weights."""
    n, size = len(grade), 1 << config.bits
    weights = np.zeros(size)
    base = np.array([np.mean(grade >= k) if n else 0.5 for k in range(1, config.grades)])
    first = -np.log(np.clip(base, 0.01, 0.99) / (1 - np.clip(base, 0.01, 0.99)))
    gaps = np.log(np.maximum(np.diff(first), 0.05))
    parameters = [weights, first[:1].copy(), gaps]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    row = np.repeat(np.arange(n), np.diff(begin))
    known = np.bincount(index, minlength=size) >= config.least_docs
    use = known[index]
    index, row = index[use], row[use]
    for t in range(1, config.rounds + 1 if n else 0):
        weights, lowest, gaps = parameters
        thresholds = np.concatenate((lowest, lowest + np.cumsum(np.exp(gaps))))
        score = np.bincount(row, weights=weights[index], minlength=n)
        below = 1 / (1 + np.exp(-np.clip(np.concatenate(([-60], thresholds, [60]))[None, :] - score[:, None], -60, 60)))
        chance = np.maximum(below[np.arange(n), grade + 1] - below[np.arange(n), grade], 1e-12)
        slope = below * (1 - below)
        slope[:, 0] = slope[:, -1] = 0
        upper, lower = slope[np.arange(n), grade + 1] / chance, slope[np.arange(n), grade] / chance
        d_score = (upper - lower) / n
        d_threshold = np.array(
            [(lower[grade == k].sum() - upper[grade == k - 1].sum()) / n for k in range(1, config.grades)]
        )
        tail = np.cumsum(d_threshold[::-1])[::-1]
        slopes = [
            np.bincount(index, weights=d_score[row], minlength=size) + config.penalty * weights / n,
            tail[:1],
            tail[1:] * np.exp(gaps),
        ]
        for k, g in enumerate(slopes):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * ((g * g).max() - v)  # one scale for all weights: rare features move less
            step = (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            parameters[k] = parameters[k] - config.rate * step
    weights, lowest, gaps = parameters
    return Model(weights.astype(np.float32), np.concatenate((lowest, lowest + np.cumsum(np.exp(gaps)))))


def train(docs: DataFrame, ratings: DataFrame, config: OrdinalConfig = OrdinalConfig()) -> Model:
    """Fit on documents (doc_id, text) with ratings (doc_id, grade 0..grades-1).

    Null grades and ids are left out; a document rated several times takes its lowest grade.
    """
    rated = ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.sample)  # at most ``sample`` rows
    texts = docs.select("doc_id", "text").filter(F.length("text") <= config.sample_chars)
    bits = config.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                index, begin = features(block, bits)
                parts = [index[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                grade = batch.column(0).slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_arrays([grade, pa.array(parts, pa.binary())], ["grade", "f"])

    joined = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    joined = joined.select(F.col("grade").cast("int").alias("grade"), "text")
    rows = joined.mapInArrow(run, "grade int, f binary").toArrow()
    parts = [np.frombuffer(x, np.int32) for x in rows.column("f").to_pylist()]
    begin = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    index = np.concatenate([np.zeros(0, np.int32), *parts])
    return fit(index, begin, rows.column("grade").to_numpy().astype(np.int64), config)


def grade(docs: DataFrame, model: Model, config: OrdinalConfig = OrdinalConfig()) -> DataFrame:
    """Per row: doc_id, expected_grade, tail_probability (of ``keep_grade`` or more), kept.

    Null and empty texts have no features and get the grade of the thresholds alone, but are never
    kept. Repeated rows are graded alike; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            expected, tail, some = np.zeros(n), np.zeros(n), np.zeros(n, bool)
            for block in blocks(batch.column(1)):
                index, begin = features(block, config.bits)
                rows = len(begin) - 1
                row = np.repeat(np.arange(rows), np.diff(begin))
                score = np.bincount(row, weights=model.weights[index], minlength=rows)
                tails = model.tails(score)
                here = slice(block.first, block.last)
                expected[here], tail[here] = tails.sum(1), tails[:, config.keep_grade - 1]
                some[here] = np.diff(begin) > 0
            kept = some & (tail >= config.cut)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(expected), pa.array(tail), pa.array(kept)],
                ["doc_id", "expected_grade", "tail_probability", "kept"],
            )

    schema = "doc_id long, expected_grade double, tail_probability double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
