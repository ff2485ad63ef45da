"""Packed words inside table rows: encode events to blocks, decode blocks to records.

``decode_blocks`` also serves recordings that were loaded whole with ``binaryFile``, when each row
starts with the registers unset.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lumenflow.functions import evt
from lumenflow.plans.hopping import floor_div
from lumenflow.schema import RECORD
from lumenflow.sources.evt import _batch

BLOCK_EVENTS = 4096


def _pack(value: Column, nibbles: int) -> Column:
    """Little-endian bytes of a non-negative number, as hex text."""
    text = F.lpad(F.hex(value), nibbles, "0")
    return F.concat(*[F.substring(text, i, 2) for i in range(nibbles - 1, 0, -2)])


def _words(fmt: str) -> list[Column]:
    """Hex words of one event; every event repeats its registers, so blocks need no state."""
    t, x, y = F.col("timestamp_us"), F.col("x").cast("long"), F.col("y").cast("long")
    on = F.col("polarity").cast("long")
    if fmt == "evt3":
        high, low = F.floor(t / 4096) % 4096, t % 4096
        parts = [(8, high), (6, low), (0, y), (2, x + on * 2048)]
        return [_pack(value.cast("long") + kind * 4096, 4) for kind, value in parts]
    high, low = F.floor(t / 64).cast("long") % (1 << 28), t % 64
    event = on * (1 << 28) + low * (1 << 22) + x * (1 << 11) + y
    if fmt == "evt2":
        return [_pack(high + (8 << 28), 8), _pack(event, 8)]
    # 64-bit words are packed as two halves, so no value leaves the signed range.
    return [F.concat(_pack(F.lit(0), 8), _pack(high + (8 << 28), 8)), F.concat(_pack(F.lit(1), 8), _pack(event, 8))]


def encode_blocks(events: DataFrame, fmt: str) -> DataFrame:
    """``(stream_id, block, content)`` with up to 4096 consecutive ``seq`` values per block."""
    word = F.concat(*_words(fmt))
    return (
        events.select("stream_id", "seq", floor_div(F.col("seq"), BLOCK_EVENTS).alias("block"), word.alias("w"))
        .groupBy("stream_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "w"))).alias("rows"))
        .select("stream_id", "block", F.unhex(F.concat_ws("", F.col("rows.w"))).alias("content"))
    )


def decode_blocks(blocks: DataFrame, fmt: str, endian: str = "little") -> DataFrame:
    """Events of packed blocks; ``seq`` counts inside the block, after a ``block`` column."""
    schema = to_arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, numbers, contents = (batch.column(c) for c in ("stream_id", "block", "content"))
            for name, number, content in zip(names, numbers, contents):
                words = evt.words_of(content.as_buffer().to_pybytes(), fmt, endian)
                records, _ = evt.decode(words, evt.Registers(base=0), fmt)
                out = _batch(records, 0, name.as_py(), schema)
                block = pa.array([number.as_py()] * out.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*out.columns, block], names=[*schema.names, "block"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD.fields)
    records = blocks.select("stream_id", "block", "content").mapInArrow(run, f"{columns}, block long")
    return records.where(F.col("record_type") == evt.EVENT).select(
        "stream_id", "block", "seq", "timestamp_us", "x", "y", "polarity"
    )
