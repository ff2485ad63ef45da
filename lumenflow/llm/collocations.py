"""Phrase collocations over a prefix-free parse of the corpus.

1. Pieces (text between punctuation) are cut into chunks where the next ``longest - 1`` words hash to a
   trigger. A chunk ends with the words that triggered the cut and the next one begins with them, so equal
   passages give equal chunks and every phrase lies whole in the chunk in which it begins. A phrase counts
   there and only there: what begins in the overlap belongs to the next chunk.
2. The dictionary of distinct chunks with parse frequencies is all that is counted from here on.
3. Words, then pairs of frequent words, then longer phrases of frequent pairs are counted in distinct chunks,
   weighted by frequency and combined inside a task. Phrases are counted under 64-bit keys first; a filter of
   bounded size says which parts are frequent. Equal keys, or a full filter, only let more through.
4. What is left is counted once more as text, so counts are exact, and cut, scored and ranked as rows.

Odd input: a null or empty text has no words; a null ``lang`` is ``und``. Repeated rows count each time.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm.store import saved
from lumenflow.llm.words import Block, Prefix, blocks, give_back, mix, spans

#: Punctuation and line ends become line feeds, tabs become spaces, A-Z small letters.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[list(b".,;:!?\n\x0b\x0c\r")] = 10
_PLAIN[9] = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNKS = 1 << 14  # chunks worked on at a time
COMBINE = 1 << 22  # keys held by a task before they are combined or passed on
PHRASES = 1 << 18  # distinct texts held by a task


@dataclass(frozen=True)
class CollocationConfig:
    """``least`` occurrences of a phrase of 2 to ``longest`` words; ``top`` phrases a language.

    ``trigger``: one cut in so many words. ``filter_bits``: bits of a filter at most (32 MB).
    """

    longest: int = 5
    least: int = 100
    top: int = 2000
    trigger: int = 16
    filter_bits: int = 1 << 28


# Parse ----------------------------------------------------------------------------------------


def cuts(block: Block, longest: int, trigger: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte, last byte and number of words of every chunk; the last: whether words overlap."""
    start, end = spans(block)
    n, overlap = len(start), longest - 1
    if not n:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, nothing.astype(bool)
    row = np.searchsorted(block.offsets, start, "right") - 1
    breaks = np.searchsorted(np.flatnonzero(block.data == 10), start)
    opens = np.ones(n, bool)
    opens[1:] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
    piece = np.cumsum(opens) - 1
    firsts = np.flatnonzero(opens)
    ends = np.append(firsts[1:], n)[piece]  # where the piece of a word ends
    fires = np.zeros(n, bool)
    if n >= overlap:
        hashes = Prefix(block.data).of(start, end)
        rolled = hashes[: n - overlap + 1].copy()
        for k in range(1, overlap):
            rolled = rolled * _STEP + hashes[k : n - overlap + 1 + k]
        fires[: n - overlap + 1] = mix(rolled) % np.uint64(trigger) == 0
        fires &= np.arange(n) + overlap <= ends
    begins = np.flatnonzero(opens | fires)
    last = np.append(begins[1:], n) - 1  # last word that is the chunk's own
    tail = last + 1 < ends[begins]
    last = np.where(tail, last + overlap, last)
    return row[begins], start[begins], end[last], tail


def parse(docs: DataFrame, config: CollocationConfig) -> DataFrame:
    """(lang, chunk, tail, times), combined inside an Arrow batch; ``tail``: the last words overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, codes = coded(batch["lang"])
            found: dict[tuple[str, bool], Counter] = defaultdict(Counter)
            for block in blocks(batch["text"]):
                block = block._replace(data=_PLAIN[block.data])
                row, first, end, tail = cuts(block, config.longest, config.trigger)
                raw = block.data.tobytes()
                kind = codes[block.first : block.last][row] * 2 + tail
                wide = double_spaces(block.data, first, end)
                for k in np.unique(kind).tolist():
                    key = names[k // 2], bool(k % 2)
                    mine = kind == k
                    some = mine & ~wide
                    found[key].update([raw[a:b] for a, b in zip(first[some].tolist(), end[some].tolist())])
                    some = mine & wide
                    found[key].update([b" ".join(raw[a:b].split()) for a, b in zip(first[some].tolist(), end[some].tolist())])
            for (name, cut), counter in found.items():
                n = len(counter)
                columns = [pa.array([name] * n, pa.string()), pa.array(list(counter), pa.binary()).cast(pa.string()),
                           pa.array([cut] * n, pa.bool_()), pa.array(list(counter.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "tail", "times"])
        give_back()

    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "lang string, chunk string, tail boolean, times long")


def coded(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct values and the place of each row's value among them."""
    found = column.dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy()


def double_spaces(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a stretch has two spaces side by side."""
    two = np.zeros(len(data) + 1, np.int64)
    two[1:-1] = np.cumsum((data[1:] == 32) & (data[:-1] == 32)) if len(data) > 1 else 0
    two[-1] = two[-2] if len(two) > 1 else 0
    return two[np.maximum(end - 1, first)] > two[first]


def dictionary(docs: DataFrame, config: CollocationConfig) -> DataFrame:
    """Distinct chunks with their parse frequency."""
    return parse(docs, config).groupBy("lang", "chunk", "tail").agg(F.sum("times").alias("times"))


# Count ----------------------------------------------------------------------------------------


class Grams(NamedTuple):
    """Words of a block of chunks. ``own``: whether phrases may begin at the word; ``left``: words up to the end."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    own: np.ndarray
    left: np.ndarray
    seed: np.ndarray
    hash: np.ndarray


def grams(block: Block, tail: np.ndarray, seeds: np.ndarray, overlap: int) -> Grams:
    start, end = spans(block)
    row = np.searchsorted(block.offsets, start, "right") - 1
    count = np.bincount(row, minlength=block.last - block.first)
    left = np.cumsum(count)[row] - np.arange(len(row))
    own = ~tail[row] | (left > overlap)
    return Grams(start, end, row, own, left, seeds[row], Prefix(block.data).of(start, end))


def keys(g: Grams, n: int, at: np.ndarray) -> np.ndarray:
    """64-bit keys of the ``n`` words from each word of ``at`` on."""
    rolled = g.hash[at]
    for k in range(1, n):
        rolled = rolled * _STEP + g.hash[at + k]
    return mix(rolled + g.seed[at] * np.uint64(2 * n + 1))


def word_counts(block: Block, g: Grams, names: list[str], codes: np.ndarray, times: np.ndarray, own: np.ndarray) -> Iterator[tuple[str, list[bytes], list[int]]]:
    """For each language its distinct words among ``own`` and how often they occur."""
    length = g.end - g.start
    at = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    inside = np.zeros(len(block.data) + 1, np.int8)
    inside[g.start] += 1
    inside[g.end] -= 1
    solid = block.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]  # words side by side
    words = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(solid)])
    found = words.dictionary_encode()
    texts, number = found.dictionary.to_pylist(), found.indices.to_numpy()
    code = codes[g.row]
    for c in np.unique(code).tolist():
        some = own[code[own] == c]
        sums = np.bincount(number[some], weights=times[g.row[some]], minlength=len(texts)).astype(np.int64)
        held = np.flatnonzero(sums)
        yield names[c], [texts[k] for k in held.tolist()], sums[held].tolist()


def seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest())


class Filter:
    """Bits of a Bloom filter with two probes a key."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, key: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.bits) * 8 - 1)
        out = self._probe(key & mask)
        out[out] = self._probe((key[out] >> np.uint64(32)) & mask)
        return out

    def _probe(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def filter_of(frequent: DataFrame, limit: int) -> np.ndarray:
    """Filter of the column ``key``, built as bitmaps of 4 KB by the tasks; ``limit`` bits at most."""
    rows = frequent.count()
    size = min(limit, 1 << max(15, (16 * rows).bit_length()))
    low = F.col("key").bitwiseAND(F.lit(size - 1))
    high = F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(size - 1))
    bits = frequent.select(F.explode(F.array(low, high)).alias("bit"))
    inside = F.col("bit").bitwiseAND(F.lit((1 << 15) - 1))
    maps = bits.groupBy(F.shiftright("bit", 15).alias("bucket")).agg(F.bitmap_construct_agg(inside).alias("map"))
    out = np.zeros(size // 8, np.uint8)
    for row in maps.toLocalIterator():
        at = row["bucket"] << 12
        out[at : at + 4096] = np.frombuffer(row["map"], np.uint8)
    return out


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``CHUNKS`` rows but for the last: chunks are short."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNKS:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def gram_blocks(batch: pa.RecordBatch, overlap: int) -> Iterator[tuple[Block, Grams, list[str], np.ndarray, np.ndarray]]:
    """Blocks of chunks with their words, the languages, and each row's language (by place) and frequency."""
    names, codes = coded(batch["lang"])
    seeds = np.array([seed(x) for x in names], np.uint64)[codes]
    tail = batch["tail"].to_numpy(zero_copy_only=False)
    times = batch["times"].to_numpy()
    for block in blocks(batch["chunk"], rows=CHUNKS):
        part = slice(block.first, block.last)
        yield block, grams(block, tail[part], seeds[part], overlap), names, codes[part], times[part]


def tallied(found: dict[tuple[str, int], Counter], block: Block, g: Grams, names: list[str], codes: np.ndarray, times: np.ndarray, n: int, fits: np.ndarray) -> None:
    """Count the ``n`` words at each of ``fits`` as text."""
    raw = block.data.tobytes()
    weight, code = times[g.row[fits]], codes[g.row[fits]]
    for c in np.unique(code).tolist():
        tally = found[names[c], n]
        at = fits[(code == c) & (weight == 1)]
        tally.update([raw[a:b] for a, b in zip(g.start[at].tolist(), g.end[at + n - 1].tolist())])
        some = (code == c) & (weight > 1)
        at = fits[some]
        for a, b, w in zip(g.start[at].tolist(), g.end[at + n - 1].tolist(), weight[some].tolist()):
            tally[raw[a:b]] += w


def phrase_batches(found: dict[tuple[str, int], Counter], least: int = 0) -> Iterator[pa.RecordBatch]:
    """The tallies as rows, which empties them, if they hold more than ``least`` texts."""
    if sum(map(len, found.values())) > least:
        for (lang, n), tally in found.items():
            size = len(tally)
            columns = [pa.array([lang] * size, pa.string()), pa.array(list(tally), pa.binary()).cast(pa.string()),
                       pa.array(np.full(size, n, np.int32)), pa.array(list(tally.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "f"])
        found.clear()


def counted_words(chunks: DataFrame, config: CollocationConfig) -> DataFrame:
    """(lang, phrase, words, f): counts of all words; 0 words: of all words of the language together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], Counter] = defaultdict(Counter)
        for batch in gathered(batches):
            for block, g, names, codes, times in gram_blocks(batch, config.longest - 1):
                own = np.flatnonzero(g.own)
                for name, texts, counts in word_counts(block, g, names, codes, times, own):
                    found[name, 1].update(dict(zip(texts, counts)))
                    found[name, 0][b""] += sum(counts)
            yield from phrase_batches(found, PHRASES)
        yield from phrase_batches(found)
        give_back()

    rows = chunks.select("lang", "chunk", "tail", "times").mapInArrow(run, "lang string, phrase string, words int, f long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def word_keys(words: DataFrame) -> DataFrame:
    """``key`` of (lang, phrase) rows of one word each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, codes = coded(batch["lang"])
            seeds = np.array([seed(x) for x in names], np.uint64)[codes]
            for block in blocks(batch["phrase"]):
                rows = block.last - block.first
                g = grams(block, np.zeros(rows, bool), seeds[block.first : block.last], 0)
                yield pa.RecordBatch.from_arrays([pa.array(keys(g, 1, np.arange(len(g.row))).view(np.int64))], ["key"])

    return words.select("lang", "phrase").mapInArrow(run, "key long")


def combined(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(times, first) if len(first) else times


def level(chunks: DataFrame, sizes: range, known: int, below: np.ndarray, config: CollocationConfig) -> DataFrame:
    """(words, key) of the phrases of ``sizes`` words that may occur ``least`` times.

    ``below`` holds the keys of frequent phrases of ``known`` words; all such parts of a phrase must be in it.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = Filter(shared.value)
        held: dict[int, list] = defaultdict(list)
        size = Counter()
        for batch in gathered(batches):
            for _, g, _, _, times in gram_blocks(batch, config.longest - 1):
                usable = np.flatnonzero(g.left >= known)
                good = np.zeros(len(g.row), bool)
                good[usable] = passes(keys(g, known, usable))
                for n in sizes:
                    fits = np.flatnonzero(g.own & (g.left >= n))
                    for k in range(n - known + 1):
                        fits = fits[good[fits + k]]
                    held[n].append((keys(g, n, fits), times[g.row[fits]]))
                    size[n] += len(fits)
                    if size[n] >= COMBINE:
                        held[n] = [combined(*map(np.concatenate, zip(*held[n])))]
                        size[n] = len(held[n][0][0])
                        if size[n] > COMBINE // 2:
                            yield count_batch(n, *held.pop(n)[0])
                            size[n] = 0
        for n, parts in held.items():
            yield count_batch(n, *combined(*map(np.concatenate, zip(*parts))))
        give_back()

    counts = chunks.select("lang", "chunk", "tail", "times").mapInArrow(run, "words int, key long, times long")
    return counts.groupBy("words", "key").agg(F.sum("times").alias("times")).filter(F.col("times") >= config.least).select("words", "key")


def count_batch(n: int, key: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(key), n, np.int32)), pa.array(key.view(np.int64)), pa.array(times)]
    return pa.RecordBatch.from_arrays(columns, ["words", "key", "times"])


def exact(chunks: DataFrame, filters: dict[int, np.ndarray], config: CollocationConfig) -> DataFrame:
    """(lang, phrase, words, f) of the phrases that the filter of their size lets through."""
    shared = chunks.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = {n: Filter(bits) for n, bits in shared.value.items()}
        found: dict[tuple[str, int], Counter] = defaultdict(Counter)
        for batch in gathered(batches):
            for block, g, names, codes, times in gram_blocks(batch, config.longest - 1):
                pairs = np.flatnonzero(g.left >= 2)
                good = np.zeros(len(g.row), bool)
                good[pairs] = passes[2](keys(g, 2, pairs))
                for n, passing in passes.items():
                    fits = np.flatnonzero(g.own & (g.left >= n))
                    for k in range(n - 1):
                        fits = fits[good[fits + k]]
                    tallied(found, block, g, names, codes, times, n, fits[passing(keys(g, n, fits))])
            yield from phrase_batches(found, PHRASES)
        yield from phrase_batches(found)
        give_back()

    rows = chunks.select("lang", "chunk", "tail", "times").mapInArrow(run, "lang string, phrase string, words int, f long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def frequent_phrases(chunks: DataFrame, config: CollocationConfig) -> DataFrame:
    """All phrases that occur ``least`` times, with exact counts; 0 words: all words of a language."""
    words = saved(counted_words(chunks, config).filter((F.col("words") == 0) | (F.col("f") >= config.least)))
    below = filter_of(word_keys(words.filter("words = 1")), config.filter_bits)
    two = saved(level(chunks, range(2, 3), 1, below, config))
    filters = {2: filter_of(two, config.filter_bits)}
    more = saved(level(chunks, range(3, config.longest + 1), 2, filters[2], config))
    for n in range(3, config.longest + 1):
        filters[n] = filter_of(more.filter(F.col("words") == n), config.filter_bits)
    return words.unionByName(exact(chunks, filters, config).filter(F.col("f") >= config.least))


# Score ----------------------------------------------------------------------------------------


def score_phrases(counts: DataFrame, config: CollocationConfig) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from what ``frequent_phrases`` gives."""
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    phrases = counts.filter("words > 0")
    long_ones = phrases.filter("words > 1")
    split = F.split("phrase", " ")
    # a phrase that is never seen without one of its neighbours; longer ones imply the next longer
    inner = F.array(F.slice(split, 1, F.col("words") - 1), F.slice(split, 2, F.col("words") - 1))
    covered = phrases.filter("words > 2").select("lang", F.explode(inner).alias("part"), F.col("f").alias("a"))
    covered = covered.select("lang", F.array_join("part", " ").alias("phrase"), "a").distinct()
    open_ones = long_ones.withColumnRenamed("f", "a").join(covered, ["lang", "phrase", "a"], "left_anti")
    cut = open_ones.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("split", split)
    cut = cut.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("split", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("split", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
    )
    part = phrases.select("lang", "phrase", "f")
    cut = cut.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cut = cut.join(totals, "lang")
    wide = "CAST({} AS DECIMAL(18,0))".format
    score = F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    lowest = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score").withColumn("rank", F.row_number().over(order))
    columns = ["lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"]
    return ranked.filter(F.col("rank") <= config.top).select(columns)


def collocations(docs: DataFrame, config: CollocationConfig = CollocationConfig()) -> DataFrame:
    """Each language's ``top`` phrases whose parts keep together most."""
    chunks = saved(dictionary(docs, config))
    return score_phrases(saved(frequent_phrases(chunks, config)), config)
