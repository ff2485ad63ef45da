"""Language of words and documents by a linear-chain conditional random field.

Each word has features (its start and end bytes, inner byte triples, itself) with learned weights per
language, and a lexicon score from training counts. Learned transitions tie neighbouring words, so a
text may switch language; forward-backward gives each word's posterior. A document's language is the
one with the largest sum of posteriors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm.words import Block, Prefix, Words, blocks, mix, words

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
STRETCH = 64  # words per stretch of the chain


@dataclass(frozen=True)
class LanguageConfig:
    """``sample``: most training documents per language, those with the smallest hashed ids, of at most
    ``sample_chars`` characters (training only). ``bits``: log2 of the feature weights per language.
    """

    sample: int = 300
    sample_chars: int = 6000
    bits: int = 16
    rounds: int = 60
    rate: float = 0.1
    penalty: float = 1e-5
    cache_words: int = 1 << 19
    seed: int = 11


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # labels x labels, exponentiated
    lexicon_keys: np.ndarray
    lexicon: np.ndarray  # words x labels, scaled
    bits: int

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
        index, begin = features(data, start, end, key, self.bits)
        out = np.add.reduceat(self.weights[index], begin[:-1], axis=0)
        if len(self.lexicon_keys):
            at = np.minimum(np.searchsorted(self.lexicon_keys, key), len(self.lexicon_keys) - 1)
            known = self.lexicon_keys[at] == key
            out[known] += self.lexicon[at[known]]
        return np.exp(np.clip(out - out.max(1, keepdims=True), -30, 0))


def letters(block: Block) -> Words:
    """Words with a letter byte, lower-cased for hashing."""
    found = words(block, lower=True)
    total = np.concatenate(([0], np.cumsum(LETTER[block.data])))
    keep = total[found.end] > total[found.start]
    return Words(*(x[keep] for x in found))


def features(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words laid end to end, and where each word's begin."""
    prefix = Prefix(data, lower=True)
    length = end - start
    n = len(start)
    word = [np.arange(n)]
    value = [mix(key + np.uint64(1))]
    for size in (1, 2, 3, 4):
        own = np.flatnonzero(length >= size)
        word += [own, own]
        value.append(mix(prefix.of(start[own], start[own] + size) + np.uint64(10 + size)))
        value.append(mix(prefix.of(end[own] - size, end[own]) + np.uint64(20 + size)))
    count = np.maximum(length - 2, 0)
    own = np.repeat(np.arange(n), count)
    at = start[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    word.append(own)
    value.append(mix(prefix.of(at, at + 3) + np.uint64(30)))
    word_, value_ = np.concatenate(word), np.concatenate(value)
    order = np.argsort(word_, kind="stable")
    index = (value_[order] >> np.uint64(64 - bits)).astype(np.int32)
    return index, np.concatenate(([0], np.cumsum(np.bincount(word_, minlength=n))))


def posteriors(emission: np.ndarray, begin: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word posteriors and forward vectors of chains laid end to end; chain c is emission[begin[c]:begin[c+1]].

    Chains are cut into stretches. Products over each stretch are formed side by side, carried along
    the chain stretch by stretch, and then expanded inside all stretches at once.
    """
    size = emission.shape[1]
    length = np.diff(begin)
    parts = -(-length // STRETCH)
    chain = np.repeat(np.arange(len(length)), parts)
    order_in = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = begin[:-1][chain] + order_in * STRETCH
    span = np.minimum(STRETCH, length[chain] - order_in * STRETCH)
    n = len(first)
    steps = np.arange(STRETCH)
    inside = steps[None, :] < span[:, None]
    grid = np.ones((n, STRETCH, size))
    grid[inside] = emission[(first[:, None] + steps[None, :])[inside]]
    total = np.tile(np.eye(size), (n, 1, 1))
    for t in range(STRETCH):
        on = span > t
        step = total[on] @ (moves[None] * grid[on, t][:, None, :])
        total[on] = step / step.sum((1, 2), keepdims=True)
    ahead = np.full((n, size), 1 / size)
    behind = np.full((n, size), 1 / size)
    where = np.cumsum(parts) - parts
    for k in range(1, parts.max(initial=0)):
        live = np.flatnonzero(parts > k)
        now = where[live] + k
        step = np.einsum("ni,nij->nj", ahead[now - 1], total[now - 1])
        ahead[now] = step / step.sum(1, keepdims=True)
        back = where[live] + parts[live] - 1 - k
        step = np.einsum("nij,nj->ni", total[back + 1], behind[back + 1])
        behind[back] = step / step.sum(1, keepdims=True)
    forward = np.empty_like(grid)
    state = ahead
    for t in range(STRETCH):
        state = state @ moves * grid[:, t]
        state /= state.sum(1, keepdims=True)
        forward[:, t] = state
    state = behind.copy()
    both = np.zeros_like(grid)
    for t in range(STRETCH - 1, -1, -1):
        on = span > t
        both[on, t] = forward[on, t] * state[on]
        step = (grid[on, t] * state[on]) @ moves.T
        state[on] = step / step.sum(1, keepdims=True)
    both /= np.maximum(both.sum(2, keepdims=True), 1e-300)
    out = np.empty((2, *emission.shape))
    place = (first[:, None] + steps[None, :])[inside]
    out[0, place], out[1, place] = both[inside], forward[inside]
    return out[0], out[1]


def fit(found: tuple, labels: list[str], config: LanguageConfig) -> Model:
    """``found``: text bytes, each word's number and label, and (start, end, key) of the distinct words.

    The sample's words are laid in segments of changing length from documents in random order, so the
    transitions see switches of language; the likelihood of the labels is raised by gradient steps.
    """
    data, ids, label, spans_ = found
    start, end, key = spans_
    size = len(labels)
    if not len(ids):
        flat = np.zeros((1 << config.bits, size), np.float32)
        return Model(tuple(labels), flat, np.ones((size, size)), key[:0], np.zeros((0, size)), config.bits)
    index, begin = features(data, start, end, key, config.bits)
    owner = np.repeat(np.arange(len(key)), np.diff(begin))
    rng = np.random.default_rng(config.seed)
    # segments of 8 to 64 words in random order, then lanes of one stretch each
    cut = [0]
    while cut[-1] < len(ids):
        cut.append(cut[-1] + int(rng.integers(8, STRETCH + 1)))
    order = np.concatenate(
        [np.arange(cut[k], min(cut[k + 1], len(ids))) for k in rng.permutation(len(cut) - 1)]
    )
    order = order[: len(order) // STRETCH * STRETCH] if len(order) >= STRETCH else order
    ids, label = ids[order], label[order]
    lanes = np.arange(0, len(ids) + 1, STRETCH)
    if lanes[-1] < len(ids):
        lanes = np.append(lanes, len(ids))
    seen = np.bincount(ids * size + label, minlength=len(key) * size).reshape(-1, size).astype(float)
    log_odds = np.log((seen + 0.1) / (seen.sum(1, keepdims=True) + 0.1 * size) * size)
    log_odds[seen.sum(1) < 3] = 0
    weights = np.zeros((1 << config.bits, size))
    logs, scale = np.eye(size) * 2.0, np.array([0.5])
    parameters = [weights, logs, scale]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    truth = np.zeros((len(ids), size))
    truth[np.arange(len(ids)), label] = 1
    pair_truth = np.zeros((size, size))
    inner = np.ones(len(ids), bool)
    inner[lanes[:-1]] = False
    np.add.at(pair_truth, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1)
    n = len(ids)
    for t in range(1, config.rounds + 1):
        weights, logs, scale = parameters
        table = np.add.reduceat(weights[index], begin[:-1], axis=0) + scale[0] * log_odds
        table = np.exp(np.clip(table - table.max(1, keepdims=True), -30, 0))
        emission, moves = table[ids], np.exp(logs - logs.max())
        post, forward = posteriors(emission, lanes, moves)
        left = forward[:-1][inner[1:]]
        pair = (left.T @ (post[1:][inner[1:]] / (left @ moves))) * moves  # expected transitions
        pull = np.zeros((len(key), size))
        np.add.at(pull, ids, (post - truth) / n)
        slopes = [
            np.stack([np.bincount(index, weights=pull[owner, y], minlength=len(weights)) for y in range(size)], 1)
            + config.penalty * weights,
            (pair - pair_truth) / n,
            np.array([(pull * log_odds).sum()]),
        ]
        for k, g in enumerate(slopes):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            parameters[k] = parameters[k] - config.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    weights, logs, scale = parameters
    common = seen.sum(1) >= 3
    keys = np.argsort(key[common])
    return Model(
        tuple(labels), weights.astype(np.float32), np.exp(logs - logs.max()),
        key[common][keys], (scale[0] * log_odds[common][keys]), config.bits,
    )


def train(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> Model:
    """Learn from documents (doc_id, text, lang); rows with a null among them are left out."""
    known = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= config.sample_chars)
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= config.sample)
    rows = known.join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"]).toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    labels = sorted(set(rows.column("lang").to_pylist()))
    place = {x: k for k, x in enumerate(labels)}
    of_row = np.array([place[x] for x in rows.column("lang").to_pylist()], np.int64)
    parts = list(blocks(rows.column("text")))
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(p.offsets) for p in parts)])
    data = np.concatenate([np.zeros(0, np.uint8), *(p.data for p in parts)])
    whole = Block(0, len(sizes), data, np.concatenate(([0], np.cumsum(sizes))))
    found = letters(whole)
    key, first, which = np.unique(found.hash, return_index=True, return_inverse=True)
    spans_ = (found.start[first], found.end[first], key)
    return fit((whole.data, which, of_row[found.row] if len(of_row) else which, spans_), labels, config)


def identify(docs: DataFrame, model: Model, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """Per row: doc_id, lang_pred, score (mean posterior of that language over the text's words).

    Null text and text without a letter give ``und`` and 0. Repeated rows are labelled alike; an empty
    table gives an empty one. A model without languages gives ``und``.
    """
    size = len(model.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        table = np.zeros((0, size))
        for batch in batches:
            n = batch.num_rows
            label, score = np.full(n, -1), np.zeros(n)
            for block in blocks(batch.column(1)) if size else ():
                found = letters(block)
                if not len(found.hash):
                    continue
                distinct, first, which = np.unique(found.hash, return_index=True, return_inverse=True)
                if len(known) + len(distinct) > config.cache_words:
                    known.clear()
                    table = np.zeros((0, size))
                keys = distinct.tolist()
                new = np.array([k for k, x in enumerate(keys) if x not in known], np.int64)
                if len(new):
                    at = first[new]
                    fresh = model.scores(block.data, found.start[at], found.end[at], distinct[new])
                    known.update(zip((keys[k] for k in new), range(len(table), len(table) + len(new)), strict=True))
                    table = np.concatenate((table, fresh))
                slots = np.fromiter((known[x] for x in keys), np.int64, len(keys))
                rows = len(block.offsets) - 1
                count = np.bincount(found.row, minlength=rows)
                some = np.flatnonzero(count)
                post, _ = posteriors(table[slots[which]], np.concatenate(([0], np.cumsum(count[some]))), model.moves)
                total = np.add.reduceat(post, np.concatenate(([0], np.cumsum(count[some])))[:-1], axis=0)
                best = total.argmax(1)
                label[block.first + some] = best
                score[block.first + some] = np.clip(total[np.arange(len(some)), best] / count[some], 0, 1)
            ok = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & (label >= 0)
            names = [model.labels[k] if good else "und" for k, good in zip(label.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0))],
                ["doc_id", "lang_pred", "score"],
            )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), "text", lettered.alias("lettered")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
