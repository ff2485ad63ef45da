"""Remove byte strings of a given length that occur earlier, with suffix arrays.

1. Texts are cut at content-chosen anchors: the least hash of a short gram inside each window of
   ``length`` bytes. Equal windows have equal anchors, so windows need comparing only under one
   anchor. A stretch of windows with one anchor is a segment. Segments whose bytes all equal an
   earlier one are removed by digest; of the others, those whose anchor occurs once are dropped.
2. The bytes of the remaining segments (parts of texts that agree near the anchor and differ further
   off) are dealt by anchor and neighbouring gram to shards. Each shard's suffix array is built by
   Larsson-Sadakane refinement, Kasai's method gives common prefixes, and runs with a common prefix
   of at least ``length`` are equal windows. The segments of an anchor too frequent for one shard are
   salted over several, in tasks of their own; each hands on its distinct windows once, and those of
   all shards meet by 128-bit digest.
3. Per text, removed windows are joined into spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm.store import numbered, saved
from lumenflow.llm.words import Block, Prefix, blocks, give_back, mix

NAMES = ["doc_id", "lo", "hi", "digest"]
DIGESTS = 1 << 16  # windows a worker hands on at a time


@dataclass(frozen=True)
class SuffixConfig:
    """``gram``: bytes of an anchor. ``shard``: bytes sorted in one suffix array."""

    length: int = 100
    gram: int = 32
    shard: int = 1 << 19


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    shift = width - span
    return np.minimum(values[: len(values) - shift], values[shift:]) if shift else values


def segments(block: Block, config: SuffixConfig) -> tuple[np.ndarray, ...]:
    """Row, anchor, first and last window start (in the block), anchor gram's hash and segment's hash."""
    data, n = block.data, len(block.data)
    none = np.zeros(0, np.int64)
    if n < config.length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = Prefix(data)
    at = np.arange(n - config.gram + 1)
    gram = prefix.of(at, at + config.gram)
    bits = np.uint64(max(int(n).bit_length(), 1))
    key = gram >> bits << bits | at.astype(np.uint64)
    anchor = (sliding_least(key, config.length - config.gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.searchsorted(block.offsets, start, "right") - 1
    inside = start + config.length <= block.offsets[row + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    new &= inside
    stop = np.ones(len(anchor), bool)
    stop[:-1] = new[1:] | ~inside[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(stop & inside)
    return row[first], anchor[first], first, last, gram[anchor[first]], prefix.of(first, last + config.length)


def anchors(docs: DataFrame, config: SuffixConfig) -> DataFrame:
    """doc_id, lo, hi (window starts), at (anchor), anchor and segment hash, and ``again``.

    ``again`` marks segments equal to an earlier one of the same block; they need no comparing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            ids = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                row, at, lo, hi, gram, segment = segments(block, config)
                base = block.offsets[row]
                _, first = np.unique(segment ^ mix(gram), return_index=True)
                again = np.ones(len(row), bool)
                again[first] = False
                # neighbouring repeated segments are one run
                joined = np.zeros(len(row), bool)
                joined[1:] = again[1:] & again[:-1] & (row[1:] == row[:-1]) & (lo[1:] == hi[:-1] + 1)
                head = np.flatnonzero(~joined)
                tail = np.append(head[1:], len(row)) - 1
                doc, start = ids[block.first + row[head]], (lo - base)[head]
                shown = np.where(again[head], mix(mix(doc.astype(np.uint64)) + start.astype(np.uint64)), gram[head])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc), pa.array(start), pa.array((hi - base)[tail]), pa.array((at - base)[head]),
                        pa.array(shown.view(np.int64)), pa.array(segment[head].view(np.int64)), pa.array(again[head]),
                    ],
                    ["doc_id", "lo", "hi", "at", "anchor", "segment", "again"],
                )

    schema = "doc_id long, lo long, hi long, at long, anchor long, segment long, again boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def suffix_array(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of all suffixes, equal ones by position; suffix i stops at ``end[i]``.

    Larsson-Sadakane: suffixes sorted by h symbols are sorted by 2h through the ranks h further on,
    and only groups that are still tied are sorted again.
    """
    n = len(data)
    h = 7
    key = np.zeros(n, np.uint64)
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(h, np.uint64)))
    place = np.arange(n)
    for k in range(h):
        symbol = padded[k : n + k]
        key = key * np.uint64(257) + np.where(place + k < end, symbol, np.uint64(0))
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.ones(n, bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(head, place, 0))
    rank[order] = group
    longest = int((end - place).max(initial=0))
    while h < longest:
        tied = ~head
        tied[:-1] |= ~head[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        own = order[tied]
        further = own + h
        second = np.where(further < end[own], rank[np.minimum(further, n - 1)] + 1, 0)
        both = rank[own] * (n + 1) + second
        turn = np.argsort(both)
        own, both = own[turn], both[turn]
        order[tied] = own
        change = np.ones(len(own), bool)
        change[1:] = both[1:] != both[:-1]
        head[tied] = change
        group = np.maximum.accumulate(np.where(change, tied, 0))
        rank[own] = group
        h *= 2
    tied = ~head
    tied[:-1] |= ~head[1:]
    own = order[tied]
    order[tied] = own[np.argsort(rank[own] * n + own)]
    return order


def common_prefixes(data: np.ndarray, end: np.ndarray, order: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """Kasai: common prefix of each suffix with the one before it in ``order``.

    A suffix's common prefix is at least its left neighbour's less one, so each lane of text runs on
    from position to position; lanes advance together.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    width = -(-n // lanes)
    out = np.zeros(n, np.int64)
    known = np.zeros(-(-n // width), np.int64)
    starts = np.arange(len(known)) * width
    for step in range(width):
        i = starts + step
        if i[-1] >= n:
            i = i[: np.searchsorted(i, n)]
        j = before[i]
        length = np.maximum(known[: len(i)] - 1, 0)
        most = np.where(j >= 0, np.minimum(end[i] - i, end[j] - j), 0)
        length = np.minimum(length, most)
        live = np.flatnonzero(length < most)
        while len(live):
            same = data[i[live] + length[live]] == data[j[live] + length[live]]
            live = live[same]
            length[live] += 1
            live = live[length[live] < most[live]]
        known[: len(i)] = length
        out[i] = length
    return out[order]


def equal_windows(data: np.ndarray, end: np.ndarray, config: SuffixConfig) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all whole windows in suffix order, and where a run of equal ones begins."""
    order = suffix_array(data, end)
    prefix = common_prefixes(data, end, order)
    whole = end[order] - order >= config.length
    head = prefix < config.length
    # whole windows of a run stand together; a shorter suffix never has a prefix of full length
    return order[whole], head[whole]


def repeats(parts: DataFrame, config: SuffixConfig) -> DataFrame:
    """Removed windows (doc_id, lo, hi) among segments (key, salted, doc_id, lo, bytes) that share a key.

    Under salted keys, also the earliest of each distinct window with its ``digest``, else null: the same
    window may be under another salt.
    """

    def shard(ids: np.ndarray, lo: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Windows of the shard in suffix order: doc, start, head of run, and the bytes they begin at."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        stop = np.cumsum(size)
        owner = np.repeat(np.arange(len(size)), size)
        place, head = equal_windows(data, stop[owner], config)
        own = owner[place]
        return ids[own], lo[own] + place - (stop - size)[own], head, place, data

    def later(doc: np.ndarray, start: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which windows are not the earliest of their run, and the earliest of each run."""
        run_ = np.cumsum(head) - 1
        order = np.lexsort((start, doc, run_))
        first = order[np.flatnonzero(np.diff(run_[order], prepend=-1))]
        mark = np.ones(len(doc), bool)
        mark[first] = False
        return mark, first

    def runs(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        head = np.ones(len(doc), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(doc)) - 1 if len(first) else first
        none = pa.nulls(len(first), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start[first]), pa.array(start[last]), none], NAMES)

    def settle(rows: list, salted: bool) -> Iterator[pa.RecordBatch]:
        ids = np.array([r[2] for r in rows], np.int64)
        lo = np.array([r[3] for r in rows], np.int64)
        doc, start, head, place, data = shard(ids, lo, [r[4] for r in rows])
        mark, first = later(doc, start, head)
        yield runs(doc[mark], start[mark])
        raw = data.tobytes() if salted else b""
        for k in range(0, len(first) if salted else 0, DIGESTS):
            some = first[k : k + DIGESTS]
            digest = [hashlib.blake2b(raw[x : x + config.length], digest_size=16).digest() for x in place[some].tolist()]
            at = pa.array(start[some])
            yield pa.RecordBatch.from_arrays([pa.array(doc[some]), at, at, pa.array(digest, pa.binary())], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bool, int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != held[-1][0] or row[1] != held[-1][1] and size >= config.shard):
                    yield from settle(held, held[-1][0])
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from settle(held, held[-1][0])
        give_back()

    sorted_ = parts.repartition("key").sortWithinPartitions("salted", "key", "doc_id", "lo")
    schema = "doc_id long, lo long, hi long, digest binary"
    return sorted_.select("salted", "key", "doc_id", "lo", "bytes").mapInArrow(run, schema)


def windows_to_compare(docs: DataFrame, found: DataFrame, config: SuffixConfig) -> DataFrame:
    """Bytes (key, salted, doc_id, lo, bytes) of segments (doc_id, lo, hi, at, anchor, salt), from the texts.

    A window reaches far to the left or to the right of its anchor. Segments are cut between the two
    and keyed by the gram on that side as well, so a frequent short phrase does not gather them all.
    A salt of 0 or more goes into the key.
    """
    side = (config.length - config.gram) // 2
    wanted = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "at", "anchor", "salt"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = batch.column(1).cast(pa.large_binary())
            lists = batch.column(2)
            begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            lo, hi, at, anchor, salt = (flat.field(k).to_numpy() for k in range(5))
            for r, doc in enumerate(batch.column(0).to_pylist()):
                text = texts[r].as_py()
                own = slice(begin[r], begin[r + 1])
                data = np.frombuffer(text, np.uint8)
                prefix = Prefix(data)
                for left in (True, False):
                    # left: starts up to at - side, which hold the gram [at - side, at)
                    first = lo[own] if left else np.maximum(lo[own], at[own] - side + 1)
                    last = np.minimum(hi[own], at[own] - side) if left else hi[own]
                    use = np.flatnonzero(first <= last)
                    if not len(use):
                        continue
                    first, last, mid = first[use], last[use], at[own][use]
                    a, b = (mid - side, mid) if left else (mid + config.gram, mid + config.gram + side)
                    key = mix(prefix.of(a, b) ^ mix(anchor[own][use].view(np.uint64) + np.uint64(left)))
                    salted = salt[own][use] >= 0
                    key = np.where(salted, mix(key + mix(salt[own][use].view(np.uint64))), key)
                    out[0] += key.view(np.int64).tolist()
                    out[1] += salted.tolist()
                    out[2] += [doc] * len(use)
                    out[3] += first.tolist()
                    out[4] += [text[x : y + config.length] for x, y in zip(first.tolist(), last.tolist(), strict=True)]
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["key", "salted", "doc_id", "lo", "bytes"]
            )

    # the same columns as in ``cut``: both joins then share one shuffle of the texts
    rows = docs.join(wanted, "doc_id").select("doc_id", "text", "s", *docs.columns[2:])
    return rows.mapInArrow(run, "key long, salted boolean, doc_id long, lo long, bytes binary")


def repeated_segments(docs: DataFrame, config: SuffixConfig) -> DataFrame:
    """Segments of ``anchors`` that are ``again`` or share an anchor with different ones.

    ``salt`` is -1, or a number below the shards that the bytes to compare under the anchor fill.
    """
    found = anchors(docs, config)
    every = Window.partitionBy("anchor")
    order = every.orderBy("segment", "doc_id", "lo")
    same = F.lag("segment").over(order) == F.col("segment")
    found = found.withColumn("again", F.col("again") | F.coalesce(same, F.lit(False)))
    found = found.withColumn("varied", F.min("segment").over(every) != F.max("segment").over(every))
    # a segment is cut in two, each with its windows' further bytes
    size = F.sum(F.when(~F.col("again"), F.col("hi") - F.col("lo") + 2 * config.length)).over(every)
    salt = F.pmod(F.xxhash64("doc_id", "lo"), F.ceil(F.col("size") / config.shard))
    found = found.withColumn("size", size)
    found = found.withColumn("salt", F.when(F.col("size") > 2 * config.shard, salt).otherwise(-1).cast("long"))
    return saved(found.drop("size").filter("again OR varied"))


def removed_windows(docs: DataFrame, config: SuffixConfig) -> DataFrame:
    """Starts (doc_id, lo..hi) of windows that occur earlier."""
    found = repeated_segments(docs, config)
    compared = saved(repeats(windows_to_compare(docs, found.filter("NOT again"), config), config))
    place = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id", "lo"))
    across = compared.filter("digest IS NOT NULL").withColumn("place", place).filter("place > 1")
    removed = (found.filter("again"), compared.filter("digest IS NULL"), across)
    return reduce(DataFrame.unionByName, [x.select("doc_id", "lo", "hi") for x in removed])


def cut(texts: DataFrame, config: SuffixConfig = SuffixConfig(), characters: bool = False) -> DataFrame:
    """Per row of ``texts`` (doc_id, text, more): doc_id, n_bytes, n_removed, n_spans, ``rest``, and the further columns.

    ``rest`` is what remains, as bytes; spans are maximal removed ranges. A null text is empty. Ids
    must be distinct and not null (``numbered`` makes them so). An empty table gives an empty one. With
    ``characters``, spans grow to whole characters at their edges.
    """
    texts = texts.filter("doc_id IS NOT NULL")
    removed = removed_windows(texts, config)
    lists = removed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    more = texts.columns[2:]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "rest", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, lists = batch.column(1).cast(pa.large_binary()), batch.column(2)
            out: list[list] = [[], [], [], []]
            for text, own in zip(contents, lists, strict=True):
                text = text.as_py() or b""
                spans_: list[list[int]] = []
                for x in own.as_py() or ():
                    a, b = x["lo"], x["hi"] + config.length
                    if characters:
                        a, b = _widened(text, a, b)
                    if spans_ and a <= spans_[-1][1]:
                        spans_[-1][1] = max(spans_[-1][1], b)
                    else:
                        spans_.append([a, b])
                at, rest = 0, []
                for a, b in spans_:
                    rest.append(text[at:a])
                    at = b
                rest.append(text[at:])
                left = b"".join(rest)
                for column, x in zip(out, (len(text), len(text) - len(left), len(spans_), left), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[3:]], names)

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, rest binary"
    schema += "".join(f", `{c}` {kinds[c]}" for c in more)
    return texts.join(lists, "doc_id", "left").select("doc_id", "text", "runs", *more).mapInArrow(run, schema)


def strip(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """The rows of ``docs`` with repeated strings taken out of ``text`` and ``n_chars`` brought up to date.

    A character cut in the middle is removed whole. Documents stay even if nothing is left of them;
    a null text stays null.
    """
    rest = cut(numbered(docs), config, characters=True).select("row", "rest")
    rest = rest.withColumn("text", F.when(~F.col("row.none"), F.col("rest").cast("string")))
    kinds = dict(docs.dtypes)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("text"))
        elif c == "n_chars":
            columns.append(F.length("text").cast(kinds[c]).alias(c))
        else:
            columns.append(F.col("row")["id" if c == "doc_id" else f"c_{c}"].alias(c))
    return rest.select(*columns)


def _widened(text: bytes, a: int, b: int) -> tuple[int, int]:
    """Range a..b with the rest of a UTF-8 character that either edge cuts."""
    if a < len(text) and text[a] & 0xC0 == 0x80:
        a = next((k for k in range(a - 1, max(a - 4, -1), -1) if text[k] >= 0xC0), a)
    for _ in range(3):
        if b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
    return a, b
