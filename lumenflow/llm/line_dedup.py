"""Lines that an earlier document holds already, by a range-partitioned sort of line keys.

1. Every line worth a look becomes a row (128-bit key, document, position); texts stay where they are.
2. Rows are range-partitioned by key, document and position and sorted inside each partition, so a key
   that is everywhere is cut over many tasks. A task streams its rows in constant memory: the first
   document of a key keeps its lines, those after it lose theirs.
3. Only the first key of a partition may have begun in an earlier one. A table of at most two rows a
   partition (its first and its last key, with the first document seen) settles these.
4. Dropped positions come together as one deflated bitmap a document; texts are joined with bitmaps.

A key is the line without white space at both ends, A-Z lower-cased. Keys of fewer than ``least`` code
points keep all lines. Within the smallest doc_id that holds a key all its lines stay.

Odd input: a null or empty text is one empty line. A null doc_id counts as one document behind all
others. Rows with one doc_id count as one document: what one of them holds first, the others keep.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.store import saved
from lumenflow.llm.words import ROWS

BLANK = b" \t\n\x0b\x0c\r"
PLACE = "none boolean, doc long, digest long, at int"
KEY = "high long, low long"
MARKS = f"kind byte, {KEY}, {PLACE}"
DROPPED, WAITING, EDGE = 0, 1, 2


@dataclass(frozen=True)
class LineConfig:
    """``least``: code points a key needs."""

    least: int = 10


def line_key(line: bytes, least: int) -> bytes | None:
    """128-bit digest of the line's key, or None if the key is too short."""
    key = line.strip(BLANK).lower()
    if len(key) < 4 * least and len(key.decode()) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def identified(docs: DataFrame) -> DataFrame:
    """Adds what a bitmap is joined by: the document and a digest of its text."""
    doc = F.col("doc_id").cast("long")
    return docs.select(
        F.struct("*").alias("row"),
        doc.isNull().alias("none"),
        F.coalesce(doc, F.lit(0).cast("long")).alias("doc"),
        F.xxhash64("text").alias("digest"),
        F.col("text").cast("string").alias("text"),
    )


def line_rows(docs: DataFrame, config: LineConfig) -> DataFrame:
    """One row a line whose key is long enough: (high, low) of the key, document and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                keys, rows, at = [], [], []
                for r, text in enumerate(part["text"].cast(pa.large_binary())):
                    for k, line in enumerate((text.as_py() or b"").split(b"\n")):
                        key = line_key(line, config.least)
                        if key is not None:
                            keys.append(key)
                            rows.append(r)
                            at.append(k)
                lanes = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                place = part.select(["none", "doc", "digest"]).take(pa.array(rows, pa.int64()))
                columns = [pa.array(lanes[:, 0]), pa.array(lanes[:, 1]), *place.columns, pa.array(at, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["high", "low", "none", "doc", "digest", "at"])

    return docs.select("none", "doc", "digest", "text").mapInArrow(run, f"{KEY}, {PLACE}")


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream one sorted partition: rows to drop, rows that wait for an edge, and the edges."""
    names = ["kind", "high", "low", "none", "doc", "digest", "at"]
    schema = pa.schema([("kind", pa.int8()), ("high", pa.int64()), ("low", pa.int64()), ("none", pa.bool_()),
                        ("doc", pa.int64()), ("digest", pa.int64()), ("at", pa.int32())])
    head = last = None  # (high, low, none, doc): the first key and the present one, with its first document
    for batch in batches:
        if not batch.num_rows:
            continue
        high, low, none, doc = (batch[c].to_numpy(zero_copy_only=False) for c in ("high", "low", "none", "doc"))
        begins = np.ones(len(high), bool)
        begins[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        begins[0] = last is None or (high[0], low[0]) != last[:2]
        starts = np.flatnonzero(begins)
        group = np.cumsum(begins) - 1
        first_none, first_doc = none[starts], doc[starts]
        if not begins[0]:  # group -1 goes on from the batch before
            first_none, first_doc = np.append(first_none, last[2]), np.append(first_doc, last[3])
        later = (none != first_none[group]) | (doc != first_doc[group])
        if head is None:
            head = (high[0], low[0], none[0], doc[0])
        waits = ~later & (high == head[0]) & (low == head[1])
        if len(starts):
            last = tuple(x[starts[-1]] for x in (high, low, none, doc))
        for kind, chosen in ((DROPPED, later), (WAITING, waits)):
            if chosen.any():
                part = batch.filter(pa.array(chosen))
                kinds = pa.array(np.full(part.num_rows, kind, np.int8))
                yield pa.RecordBatch.from_arrays([kinds, *(part[c] for c in names[1:])], schema=schema)
    for edge in {head, last} - {None}:
        values = [EDGE, *(x.item() for x in edge), 0, 0]
        yield pa.RecordBatch.from_pylist([dict(zip(names, values))], schema=schema)


def dropped_lines(rows: DataFrame) -> DataFrame:
    """(none, doc, digest, at) of every line whose key a smaller document holds."""
    order = ["high", "low", "none", "doc", "digest", "at"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marks = saved(spread.mapInArrow(_marks, MARKS))
    edges = marks.filter(F.col("kind") == EDGE).groupBy("high", "low").agg(F.min(F.struct("none", "doc")).alias("first"))
    waiting = marks.filter(F.col("kind") == WAITING).join(edges, ["high", "low"]).filter(F.struct("none", "doc") > F.col("first"))
    place = ["none", "doc", "digest", "at"]
    return marks.filter(F.col("kind") == DROPPED).select(place).unionByName(waiting.select(place))


def pack_bits(positions: np.ndarray) -> bytes:
    """Deflated bits of the lines, 0 where one goes; lines behind the last byte stay."""
    bits = np.ones(int(positions.max()) // 8 * 8 + 8, np.uint8)
    bits[positions] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def kept_bits(bitmap: bytes | None, lines: int) -> np.ndarray:
    """One boolean a line."""
    kept = np.ones(lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:lines]
        kept[: len(bits)] = bits
    return kept


def keep_bitmaps(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """(none, doc, digest, bitmap) of every document that loses lines; see ``pack_bits``."""
    dropped = dropped_lines(saved(line_rows(identified(docs), config)))
    found = dropped.groupBy("none", "doc", "digest").agg(F.collect_set("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [pack_bits(x.values.to_numpy()) for x in batch["at"]]
            columns = [batch["none"], batch["doc"], batch["digest"], pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["none", "doc", "digest", "bitmap"])

    return found.mapInArrow(run, "none boolean, doc long, digest long, bitmap binary")


def with_lines(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """(row, n_lines, n_dropped, kept) of every document; ``row`` has the columns of ``docs``."""

    @F.arrow_udf("struct<n_lines: long, n_dropped: long, kept: string>")
    def apply(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
        out = []
        for text, bitmap in zip(texts, bitmaps):
            lines = (text.as_py() or "").split("\n")
            kept = kept_bits(bitmap.as_py(), len(lines))
            left = "\n".join(x for x, k in zip(lines, kept) if k)
            out.append({"n_lines": len(lines), "n_dropped": len(lines) - int(kept.sum()), "kept": left})
        kind = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])
        return pa.array(out, kind)

    bitmaps = keep_bitmaps(docs, config)
    same = [F.col(f"d.{c}") == F.col(f"b.{c}") for c in ("none", "doc", "digest")]
    joined = identified(docs).alias("d").join(bitmaps.alias("b"), same, "left")
    return joined.select("row", apply("d.text", "b.bitmap").alias("x")).select("row", "x.*")


def dedup_lines(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """``docs`` with the text each document keeps; null texts stay null."""
    text = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.col("kept")).alias("text")
    cut = with_lines(docs, config)
    return cut.select(*(text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
