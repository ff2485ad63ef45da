"""Near copies by a chosen-path set similarity join.

1. Each text becomes its set of word shingles, a minhash signature and a short sketch. Texts with
   equal sets count once from here on.
2. Independent trees, each with coordinates of its own: a node branches by the minwise tokens at its
   level's coordinate, sometimes at a second one of its own choice, which keeps a pair at the wanted
   similarity on about one common path however deep.
   Nodes with few documents stop and are compared exhaustively by sketch. In a larger node all
   documents meet a few leaders: those like a leader are done, since whatever is like them is linked
   to that leader too; the others branch again. What is left at the last level is walked once.
3. Sketch matches give loose groups. Inside these, links are confirmed on the full sets: a group is
   dealt out in chunks that share its first document, and what a chunk leaves outside the group's
   main class is then compared with every chunk. So no pair inside a loose group goes unjudged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm.graph import components
from lumenflow.llm.store import no_rows, numbered, numbered_columns, own_ids, saved
from lumenflow.llm.words import blocks, give_back, mix, shingles, words

COORDINATES = 128


@dataclass(frozen=True)
class NearConfig:
    """Texts are linked if 100 * common shingles >= ``percent`` * shingles of both.

    ``trees`` (64 at most), ``depth``, ``leaf``: number of trees, branching levels, rows compared exhaustively.
    ``loose``: least sketch similarity followed up, far enough below ``percent`` that noise loses
    nothing. ``leaders`` per larger node, met by ``walk`` rows at a time. ``chunk``: shingles per chunk.
    """

    width: int = 5
    percent: int = 80
    trees: int = 16
    depth: int = 6
    leaf: int = 64
    loose: float = 0.6
    leaders: int = 32
    walk: int = 4096
    chunk: int = 1 << 20
    seed: int = 3


def _multipliers() -> np.ndarray:
    return np.random.default_rng(97).integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)


def signatures(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Minwise values of sets laid end to end, none empty."""
    high, low = (values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32)
    out = np.empty((len(begin) - 1, COORDINATES), np.uint32)
    for k, factor in enumerate(_multipliers()):
        out[:, k] = np.minimum.reduceat(high + low * factor, begin[:-1])
    return out


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, two coordinates to a byte."""
    bits = (mix(signature.astype(np.uint64)) >> np.uint64(40)).astype(np.uint8) & 15
    return bits[:, ::2] << 4 | bits[:, 1::2]


_EQUAL = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches along the last axis."""
    same = _EQUAL[a ^ b].sum(-1) / COORDINATES
    return (same - 1 / 16) / (1 - 1 / 16)


def text_sets(docs: DataFrame, config: NearConfig) -> DataFrame:
    """doc_id, n_shingles, digest (null for an empty set), signature, sketch."""
    width = config.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                rows = len(block.offsets) - 1
                values, begin = shingles(words(block, lower=True), rows, width)
                count = np.diff(begin)
                some = np.flatnonzero(count)
                digest, signature, sketch = [None] * rows, [None] * rows, [None] * rows
                if len(some):
                    table = signatures(values, np.append(begin[:-1][some], len(values)))
                    short = sketches(table)
                    for k, r in enumerate(some):
                        digest[r] = hashlib.blake2b(values[begin[r] : begin[r + 1]].tobytes(), digest_size=16).digest()
                        signature[r], sketch[r] = table[k].tobytes(), short[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, rows),
                        pa.array(count.astype(np.int64)),
                        *(pa.array(x, pa.binary()) for x in (digest, signature, sketch)),
                    ],
                    ["doc_id", "n_shingles", "digest", "signature", "sketch"],
                )

    schema = "doc_id long, n_shingles long, digest binary, signature binary, sketch binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _rows_of(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def branch(rows: DataFrame, config: NearConfig, level: int) -> DataFrame:
    """(node, id) of the children of ``rows`` (id, signature, and node; without node, the trees' roots).

    The low six bits of a node are its tree, which has an equal share of the coordinates to itself.
    """
    trees, seed, depth = config.trees, config.seed, config.depth
    own = COORDINATES // trees
    rooted = "node" not in rows.columns
    low = np.uint64(63)

    def children(node: np.ndarray, ids: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tree = (node & low).astype(np.int64)
        first = tree * own + (level - 1) % own
        spare = depth + (mix(node + np.uint64(3)) % np.uint64(max(1, own - depth))).astype(np.int64)
        second = tree * own + spare % own
        twice = (mix(node + np.uint64(2)) % np.uint64(4) == 0) & (second != first)  # 1 / 0.8 = 1.25 a node
        row = np.concatenate((np.arange(len(node)), np.flatnonzero(twice)))
        at = np.concatenate((first, second[twice]))
        value = signature[row, at].astype(np.uint64)
        child = mix(node[row] ^ mix(value + (at.astype(np.uint64) << np.uint64(32))))
        return child & ~low | (node[row] & low), ids[row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            signature = _rows_of(batch.column(1), np.uint32, COORDINATES)
            if rooted:
                roots = mix(np.arange(trees, dtype=np.uint64) + np.uint64(seed << 20)) & ~low | np.arange(trees, dtype=np.uint64)
                parts = [children(np.full(len(ids), r), ids, signature) for r in roots]
            else:
                parts = [children(batch.column(2).to_numpy().view(np.uint64), ids, signature)]
            for node, own_ids in parts:
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(own_ids)], ["node", "id"])

    return rows.select("id", "signature", *([] if rooted else ["node"])).mapInArrow(run, "node long, id long")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """From batches sorted by their first ``keys`` columns: whole groups only, with each group's first row."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in range(keys):
            x = table.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(change)

    def joined() -> pa.RecordBatch:
        return pa.concat_batches(held) if len(held) > 1 else held[0]

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [batch.column(k)[batch.num_rows - 1].as_py() for k in range(keys)]
        starts = [batch.column(k)[0].as_py() for k in range(keys)]
        held.append(batch)
        if last == starts == ends:
            continue  # the group at hand goes on
        whole = joined()
        first = cut(whole)
        last = ends
        if len(first) > 1:
            yield first[:-1], whole.slice(0, first[-1])
        held = [whole.slice(first[-1])]
    if held:
        whole = joined()
        yield cut(whole), whole
    give_back()


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links within one group, as many as connect the same rows."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            keep.append(k)
    return i[keep], j[keep]


def _emit(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct links between different labels."""
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    a, b = np.maximum(a, b), np.minimum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = a != b
    keep[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def compare_leaves(rows: DataFrame, config: NearConfig) -> DataFrame:
    """Links (a, b) by sketch inside small nodes: (node, id, sketch, label), every pair of a node looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, table in grouped(batches, 1):
            ids = table.column(3).to_numpy()
            sketch = _rows_of(table.column(2), np.uint8, COORDINATES // 2)
            size = np.diff(np.append(first, len(ids)))
            a, b = [], []
            for n in np.unique(size[size > 1]):
                own = first[size == n]
                i, j = np.triu_indices(n, 1)
                step = max(1, 20_000 // len(i))
                for k in range(0, len(own), step):
                    part = own[k : k + step]
                    left, right = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                    near = likeness(sketch[left], sketch[right]) >= config.loose
                    left, right = left[near], right[near]
                    if n > 2 and len(left):
                        base = part[0]
                        left, right = _forest(left - base, right - base, int(part[-1] + n - base))
                        left, right = left + base, right + base
                    a.append(ids[left])
                    b.append(ids[right])
            yield _emit(a, b)

    return _sorted(rows.select("node", "id", "sketch", "label"), "node").mapInArrow(run, "a long, b long").distinct()


class _Net:
    """Links that connect rows start..end as their being near common leaders does, about one per row.

    Rows go by their labels: what is connected already is not linked again.
    """

    def __init__(self, ids: np.ndarray, start: int, end: int):
        self.ids, self.start = ids, start
        self.first = np.full(end - start, -1)
        self.a, self.b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(self, head: int, near: np.ndarray) -> None:
        near = near.copy()
        near[head - self.start] = True
        old = np.unique(self.first[near & (self.first >= 0)])
        fresh = np.flatnonzero(near & (self.first < 0))
        self.first[fresh] = head
        self._add(np.concatenate((fresh + self.start, old)), head)

    def _add(self, rows: np.ndarray, head: int) -> None:
        rows = rows[rows != head]
        self.a = np.concatenate((self.a, self.ids[rows]))
        self.b = np.concatenate((self.b, np.full(len(rows), self.ids[head])))


def meet_leaders(large: DataFrame, sketch: DataFrame, config: NearConfig) -> DataFrame:
    """Rows (node, id, n) of large nodes meet their node's leaders: links (a, b), or (node, id) to branch on.

    Leaders are the rows with the smallest hashed ids. A row at ``percent`` less 5 from a leader is
    done; every row is linked, as ``walk_nodes`` does, to leaders at ``loose`` less 0.2.
    """
    attach, link = config.percent / 100 - 0.05, config.loose - 0.2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, table in grouped(batches, 2):
            node, ids, labels = (table.column(k).to_numpy() for k in (0, 2, 5))
            sketch = _rows_of(table.column(3), np.uint8, COORDINATES // 2)
            leads = table.column(4).to_numpy(zero_copy_only=False)
            a, b, rest = [], [], []
            for start, end in zip(first, np.append(first[1:], len(ids)), strict=True):
                net = _Net(labels, start, end)
                free = ~leads[start:end]
                for head in start + np.flatnonzero(leads[start:end]):
                    like = likeness(sketch[start:end], sketch[head][None, :])
                    net.meet(head, like >= link)
                    free &= like < attach
                a.append(net.a)
                b.append(net.b)
                rest.append(start + np.flatnonzero(free))
            links, rest = _emit(a, b), np.concatenate(rest)
            none = pa.nulls(links.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*links.columns, none, none], names)
            none = pa.nulls(len(rest), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(node[rest]), pa.array(ids[rest])], names)

    names = ["a", "b", "node", "id"]
    parts = F.ceil(F.col("n") / config.walk)
    order = Window.partitionBy("node").orderBy(F.xxhash64("id", "node"), "id")
    leaders = large.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= config.leaders)
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    leaders = leaders.select("node", "id", everywhere.alias("part"), F.lit(True).alias("leads"))
    rows = large.join(leaders.select("node", "id").distinct(), ["node", "id"], "left_anti")
    part = F.pmod(F.xxhash64("id"), parts)
    rows = rows.select("node", "id", part.alias("part"), F.lit(False).alias("leads"))
    rows = rows.unionByName(leaders).join(sketch, "id").select("node", "part", "id", "sketch", "leads", "label")
    return _sorted(rows, "node", "part").mapInArrow(run, "a long, b long, node long, id long")


def walk_nodes(rows: DataFrame, config: NearConfig, attach: float, link: float, leaders: bool) -> DataFrame:
    """Walk groups (node, part, id, sketch, label) once. A row joins the first leader at ``attach`` or becomes one.

    Rows are linked, by their labels, to every leader at ``link``. With distance 1 - likeness, a pair nearer than
    ``attach - link`` of distance ends up connected, as the later one is within ``link`` of the
    earlier one's leader. Emits links, or with ``leaders`` the leaders themselves
    as (node, id, sketch, label).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, table in grouped(batches, 2):
            labels = table.column(4).to_numpy()
            sketch = _rows_of(table.column(3), np.uint8, COORDINATES // 2)
            a, b, tops = [], [], []
            for start, end in zip(first, np.append(first[1:], len(labels)), strict=True):
                net = _Net(labels, start, end)
                free = np.ones(end - start, bool)
                while free.any():  # the first row left is a leader, which all rows meet
                    head = start + int(free.argmax())
                    like = likeness(sketch[start:end], sketch[head][None, :])
                    net.meet(head, like >= link)
                    free &= like < attach
                    free[head - start] = False
                    tops.append(head)
                a.append(net.a)
                b.append(net.b)
            if leaders:
                columns = [table.column(k).take(tops) for k in (0, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "id", "sketch", "label"])
            else:
                yield _emit(a, b)

    schema = "node long, id long, sketch binary, label long" if leaders else "a long, b long"
    return _sorted(rows.select("node", "part", "id", "sketch", "label"), "node", "part").mapInArrow(run, schema)


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, "id")


def loose_links(sets: DataFrame, config: NearConfig) -> DataFrame:
    """Links (a, b) of sets (id, signature, sketch) that look alike by sketch, enough to connect all such."""
    sketch = sets.select("id", "sketch", F.col("id").alias("label"))
    level = branch(sets, config, 1)
    leaves, met, last = [], [], None
    for depth in range(1, config.depth + 1):
        level = saved(level)
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        level = saved(level.join(sizes, "node"))
        leaves.append(level.filter(F.col("n") <= config.leaf).select("node", "id"))
        large = level.filter(F.col("n") > config.leaf)
        if no_rows(large):
            break
        if depth == config.depth:
            last = large
        else:
            after = None
            if depth == 1:  # the first tree labels crowds for all others
                first = F.col("node").bitwiseAND(63) == 0
                after = saved(meet_leaders(large.filter(first), sketch, config))
                large = large.filter(~first)
                known = components(after.filter("a IS NOT NULL")).withColumnRenamed("node", "id")
                label = F.coalesce("component", "id").alias("label")
                sketch = saved(sets.select("id", "sketch").join(known, "id", "left").select("id", "sketch", label))
            more = saved(meet_leaders(large, sketch, config))
            after = more if after is None else after.unionByName(more)
            met.append(after.filter("a IS NOT NULL").select("a", "b").distinct())
            rest = after.filter("id IS NOT NULL").select("node", "id")
            level = branch(rest.join(sets.select("id", "signature"), "id"), config, depth + 1)
    small = leaves[0]
    for more in leaves[1:]:
        small = small.unionByName(more)
    links = compare_leaves(small.join(sketch, "id"), config)
    for more in met:
        links = links.unionByName(more)
    if last is not None:
        parts = F.ceil(F.col("n") / config.walk)
        large = last.withColumn("part", F.pmod(F.xxhash64("id", "node"), parts).cast("int")).join(sketch, "id")
        near = config.percent / 100 - 0.05
        links = links.unionByName(walk_nodes(large, config, near, config.loose - 0.2, False))
        heads = walk_nodes(large.filter(F.col("n") > config.walk), config, near, config.loose - 0.2, True)
        # leaders of a node's parts meet in one walk; leaders are far apart, so they are few
        heads = heads.withColumn("part", F.lit(0))
        links = links.unionByName(walk_nodes(heads, config, near, config.loose - 0.3, False))
    return links


def _full_sets(docs: DataFrame, members: DataFrame, config: NearConfig) -> DataFrame:
    """members (id, digest, group, parts, sketch) with their shingles, from the texts."""
    width = config.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                rows = len(block.offsets) - 1
                values, begin = shingles(words(block, lower=True), rows, width)
                parts = [values[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                digest = [hashlib.blake2b(x, digest_size=16).digest() for x in parts]
                wanted = batch.column(1).slice(block.first, rows).to_pylist()
                keep = pa.array([a == b for a, b in zip(digest, wanted, strict=True)])
                columns = [c.slice(block.first, rows) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], names).filter(keep)

    names = ["id", "group", "parts", "sketch", "shingles"]
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = texts.join(members, "id").select("text", "digest", *names[:-1])
    return rows.mapInArrow(run, "id long, group long, parts long, sketch binary, shingles binary")


def confirm(rows: DataFrame, config: NearConfig) -> DataFrame:
    """Links (a, b) on full sets inside groups (group, part, block, id, main, sketch, shingles).

    Emits what connects all linked rows of a group. ``main`` rows are known to be connected already
    and are not compared with each other.
    """
    percent, loose = config.percent, config.loose - 0.1

    def links(ids: np.ndarray, main: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray]) -> tuple[list, list]:
        n = len(ids)
        size = np.array([len(s) for s in sets])
        label = np.arange(n)
        label[main] = np.flatnonzero(main)[0] if main.any() else 0
        done = main.copy()
        a, b = [], []
        while True:
            counts = np.bincount(label, minlength=n)
            todo = np.flatnonzero(~done & (label != counts.argmax())) if not main.any() else np.flatnonzero(~done)
            if not len(todo):
                return a, b
            x = todo[0]
            done[x] = True
            rest = np.flatnonzero(
                (label != label[x])
                & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
            )
            rest = rest[likeness(sketch[rest], sketch[x][None, :]) >= loose] if len(rest) else rest
            if not len(rest):
                continue
            flat = np.concatenate([sets[r] for r in rest])
            at = np.minimum(np.searchsorted(sets[x], flat), len(sets[x]) - 1)
            same = np.add.reduceat(sets[x][at] == flat, np.cumsum(size[rest]) - size[rest], dtype=np.int64)
            for r in rest[100 * same >= percent * (size[rest] + size[x] - same)]:
                if label[r] != label[x]:
                    a.append(ids[x])
                    b.append(ids[r])
                    label[label == label[r]] = label[x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, table in grouped(batches, 3):
            ids, main = table.column(3).to_numpy(), table.column(4).to_numpy(zero_copy_only=False)
            sketch = _rows_of(table.column(5), np.uint8, COORDINATES // 2)
            sets = [np.frombuffer(x, np.uint64) for x in table.column(6).to_pylist()]
            a, b = [], []
            for start, end in zip(first, np.append(first[1:], len(ids)), strict=True):
                keep = start + np.flatnonzero(np.diff(ids[start:end], prepend=ids[start] - 1))  # repeated rows once
                if len(keep) < 2:
                    continue
                more = links(ids[keep], main[keep], sketch[keep], [sets[k] for k in keep])
                a += more[0]
                b += more[1]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keys = ("group", "part", "block")
    return _sorted(rows.select(*keys, "id", "main", "sketch", "shingles"), *keys).mapInArrow(run, "a long, b long")


def confirmed_links(docs: DataFrame, sets: DataFrame, groups: DataFrame, config: NearConfig) -> DataFrame:
    """Links on full sets that connect all linked members of each loose group (node, component)."""
    named = groups.select(F.col("node").alias("id"), F.col("component").alias("group"))
    members = sets.select("id", "n_shingles", "digest", "sketch").join(named, "id")
    parts = members.groupBy("group").agg(F.ceil(F.sum("n_shingles") / config.chunk).alias("parts"))
    members = members.join(parts, "group").select("id", "digest", "group", "parts", "sketch")
    full = saved(_full_sets(docs, members, config))
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    first = F.when(F.col("id") == F.col("group"), everywhere).otherwise(F.array(own))
    dealt = full.withColumn("part", F.explode(first)).withColumn("block", F.lit(0)).withColumn("main", F.lit(False))
    links = saved(confirm(dealt, config))
    split = full.filter("parts > 1")
    if no_rows(split):
        return links
    found = components(links).withColumnRenamed("node", "id")
    labelled = split.select("id", "group", "parts", F.length("shingles").alias("bytes")).distinct()
    labelled = labelled.join(found, "id", "left").withColumn("class", F.coalesce("component", "id"))
    sizes = labelled.groupBy("group", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("group").agg(F.max(F.struct("n", "class"))["class"].alias("main_class"))
    state = labelled.join(largest, "group").withColumn("main", F.col("class") == F.col("main_class"))
    state = saved(state.select("id", "group", "parts", "main", "bytes"))
    outside = state.filter(~F.col("main"))
    if no_rows(outside):
        return links
    load = outside.groupBy("group").agg(F.ceil(F.sum("bytes") / (8 * config.chunk)).alias("blocks"))
    marked = split.join(state.select("id", "main"), "id").join(load, "group")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))
    here = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    # every chunk of the main class, and every block of the others, meets every block of the others
    mains = marked.filter("main").withColumn("part", own).withColumn("block", here)
    others = marked.filter("NOT main").withColumn("block", block)
    spread = others.withColumn("part", F.explode(everywhere))
    shifted = marked.filter("NOT main").withColumn("other", block).withColumn("block", here)
    shifted = shifted.filter("other <> block").withColumn("part", F.col("parts") + F.col("other"))
    meeting = others.withColumn("part", F.explode(F.sequence(F.col("parts"), F.col("parts") + F.col("blocks") - 1)))
    columns = ["group", "part", "block", "id", "main", "sketch", "shingles"]
    rows = mains.select(columns).unionByName(spread.select(columns))
    rows = rows.unionByName(shifted.select(columns)).unionByName(meeting.select(columns))
    return links.unionByName(confirm(rows, config))


def _classes(docs: DataFrame, config: NearConfig) -> DataFrame:
    """(doc_id, n_shingles, component_id) of texts under distinct ids."""
    every = saved(text_sets(docs, config))
    sets = every.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("id"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"),
        F.first("sketch").alias("sketch"),
    )
    sets = saved(sets)
    groups = saved(components(loose_links(sets, config)))
    links = confirmed_links(docs, sets, groups, config)
    named = components(links).withColumnRenamed("node", "id")
    named = sets.select("id", "digest").join(named, "id", "left")
    named = named.select("digest", F.coalesce("component", "id").alias("component_id"))
    out = every.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def classes(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    The component is the smallest doc_id that links reach. Null text and text without words link with
    nothing. Where ids repeat or are null every row counts as a document of its own: rows are linked by
    their texts, not by their ids, and a component of rows without an id has none (its first row is kept).
    An empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    if own_ids(docs):
        return _classes(docs, config).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    placed = numbered(docs)
    found = _classes(placed.select("doc_id", "text"), config)
    found = found.select(F.col("doc_id").alias("own"), "n_shingles", F.col("component_id").alias("top"))
    names = placed.select(F.col("doc_id").alias("own"), F.col("row.id").cast("long").alias("doc_id"))
    tops = names.select(F.col("own").alias("top"), F.col("doc_id").alias("component_id"))
    out = found.join(names, "own").join(tops, "top")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("own") == F.col("top"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def dedup(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with its smallest doc_id stays.

    Of several such rows one stays; rows with a null doc_id come last. Rows without words all stay.
    """
    own = own_ids(docs)
    placed = docs if own else numbered(docs)
    found = _classes(placed.select("doc_id", "text"), config)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"))
    left = placed.join(gone, placed["doc_id"] == gone["gone_id"], "left_anti")
    return left if own else left.select(*numbered_columns(docs))
