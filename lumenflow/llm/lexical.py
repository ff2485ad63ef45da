"""Ranked lexical search by sequential reads of impact-sorted lists (NRA).

1. The queries are read in blocks of bounded size; one block's vocabulary goes to every task.
2. Documents become term counts, restricted to the vocabulary; corpus counts (documents, terms, documents
   a term) come from the same table.
3. Documents are dealt out in shards of a bounded number of postings. In a shard every term has a list of
   postings by falling impact. For a query its lists are read in step, a stretch at a time. A document has a
   lower score (what has been read) and an upper one (plus what each list it was not seen in can still give).
   Reading goes on until no unseen document can enter, all that may belong to the best are read to the end,
   and so membership, ties and scores are settled. A task carries its k-th score from shard to shard.
4. The best of each task meet in one ranking a query.

So no list, however frequent its term, is in one place, and what is shuffled is the best ``top`` of a task.

Odd input: a null text has no term; an item without a known term finds nothing. A null doc_id comes after
all others among equal scores. Rows are documents and items of their own, also with equal ids.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm.store import saved
from lumenflow.llm.words import ROWS, give_back

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
CELLS = 1 << 25  # documents times lists that are followed at a time


@dataclass(frozen=True)
class SearchConfig:
    """``top`` results an item; ``block``: bytes of query text in a block; ``shard``: postings in a shard;
    ``stretch``: postings first read of each list, doubled from read to read."""

    top: int = 20
    block: int = 1 << 22
    shard: int = 1 << 21
    stretch: int = 64


def terms(text: str | bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased."""
    data = text.encode() if isinstance(text, str) else text or b""
    return TERM.findall(data.lower())


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def query_blocks(items: DataFrame, config: SearchConfig) -> Iterator[list[tuple[object, Counter]]]:
    """Blocks of (item_id, terms with repeats); a longer text is a block of its own at most."""
    own = items.select("item_id", F.col("text").cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = size // config.block + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield [(r.item_id, Counter(terms(r.text))) for r in own.filter(block == k).toLocalIterator()]


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): number of terms, and numbers and counts of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                total, ids, counts = [], [], []
                for text in part["text"].cast(pa.large_binary()):
                    found = terms(text.as_py())
                    known = Counter(map(number, found))
                    known.pop(None, None)
                    total.append(len(found))
                    ids.append(list(known))
                    counts.append(list(known.values()))
                columns = [part["doc_id"], pa.array(total, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                           pa.array(counts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "term", "tf"])
        give_back()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value; 0 if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def settle(lists: list[tuple[np.ndarray, np.ndarray]], size: int, top: int, least: int, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the best ``top`` and their exact scores, by sequential reads only.

    A list has documents (numbers below ``size``) and their impacts, falling. Documents below ``least`` are
    not needed. All that tie with the last place are returned.
    """
    lower = np.zeros(size, np.int64)
    seen = np.zeros((size, len(lists)), bool)
    alive = np.ones(size, bool)
    read, closed = 0, False
    while True:
        high = np.zeros(len(lists), np.int64)  # what an unread posting of the list can be worth
        for t, (docs, impacts) in enumerate(lists):
            new, gain = docs[read : read + stretch], impacts[read : read + stretch]
            if closed:
                followed = alive[new]
                new, gain = new[followed], gain[followed]
            lower[new] += gain
            seen[new, t] = True
            if read + stretch < len(docs):
                high[t] = impacts[read + stretch - 1]
        read += stretch
        stretch *= 2
        bound = max(least, kth(lower, top), 1)
        closed = closed or high.sum() < bound
        rows = np.flatnonzero(alive)
        slack = high.sum() - seen[rows] @ high
        alive[rows] = lower[rows] + slack >= bound
        if closed and not slack[alive[rows]].any():
            found = np.flatnonzero(alive)
            return found, lower[found]


class Shard:
    """Postings of some documents, by term and falling impact."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, documents: int, words: int):
        table = pa.Table.from_batches(batches)
        ids = table["doc_id"].combine_chunks()
        self.none = np.asarray(ids.is_null())
        self.doc = ids.fill_null(0).to_numpy()
        n = table["n"].to_numpy()
        m = 75 + (25 * n * documents) // max(words, 1)
        held = [np.concatenate([c.flatten().to_numpy() for c in table[name].chunks]) for name in ("term", "tf")]
        term, tf = held[0], held[1].astype(np.int64)
        of = np.repeat(np.arange(len(n)), table["term"].combine_chunks().value_lengths().to_numpy())
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[of]))
        order = np.lexsort((-impact, term))
        self.of, self.impact = of[order], impact[order]
        self.begin = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def search(self, query: list[tuple[int, int]], config: SearchConfig, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (by their number in the shard) and scores that may be among the query's best."""
        lists = []
        for term, repeats in query:
            a, b = self.begin[term], self.begin[term + 1]
            if a < b:
                lists.append((self.of[a:b], self.impact[a:b] * repeats))
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size, step = len(self.doc), max(1, CELLS // len(lists))
        found = []
        for first in range(0, size, step):
            if size > step:
                inside = [(d >= first) & (d < first + step) for d, _ in lists]
                part = [(d[i] - first, x[i]) for (d, x), i in zip(lists, inside)]
            else:
                part = lists
            docs, scores = settle(part, min(step, size - first), config.top, least, config.stretch)
            found.append((docs + first, scores))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def best_of_tasks(postings: DataFrame, queries: list[list[tuple[int, int]]], weights: np.ndarray, documents: int, words: int, config: SearchConfig) -> DataFrame:
    """(item, doc_id, score): the best ``top`` of every task for every query of the block."""
    shared = postings.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weigh = shared.value
        best = [(np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)

        def answer(held: list[pa.RecordBatch]) -> None:
            shard = Shard(held, weigh, documents, words)
            for q, query in enumerate(asked):
                none, doc, score = best[q]
                found, scores = shard.search(query, config, int(score[-1]) if len(score) == config.top else 0)
                none, doc = np.append(none, shard.none[found]), np.append(doc, shard.doc[found])
                score = np.append(score, scores)
                order = np.lexsort((doc, none, -score))[: config.top]
                best[q] = none[order], doc[order], score[order]

        held, size = [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                held.append(part)
                size += len(part["term"].flatten())
                if size >= config.shard:
                    answer(held)
                    held, size = [], 0
        if size:
            answer(held)
        give_back()
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b[0]) for b in best])
        none, doc, score = (np.concatenate([b[c] for b in best]) if best else np.zeros(0) for c in range(3))
        columns = [pa.array(item), pa.array(doc.astype(np.int64), mask=none.astype(bool)), pa.array(score.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return postings.mapInArrow(run, "item int, doc_id long, score long")


def search_block(docs: DataFrame, block: list[tuple[object, Counter]], config: SearchConfig) -> DataFrame:
    """(item, rank, doc_id, score) with the item's place in the block."""
    vocabulary: dict[bytes, int] = {}
    for _, found in block:
        for term in found:
            vocabulary.setdefault(term, len(vocabulary))
    postings = saved(counted(docs, vocabulary))
    documents, words = postings.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    held = postings.select(F.explode("term").alias("term")).groupBy("term").count()
    for row in held.toLocalIterator():  # one row a term of the block
        weights[row["term"]] = weight(documents, row["count"])
    queries = [[(vocabulary[t], r) for t, r in found.items()] for _, found in block]
    found = best_of_tasks(postings, queries, weights, documents, words, config)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.top)


def search(docs: DataFrame, items: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in query_blocks(items, config):
        if block:
            ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item int, item_id {kind}")
            ranked = search_block(docs, block, config).join(ids, "item")
            out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out
