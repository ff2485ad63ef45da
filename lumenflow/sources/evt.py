"""``spark.read.format("evt")``: packed event recordings as a table of records.

A file is cut into byte ranges that are decoded independently. A reader that starts inside a file looks
back only for registers that its words use before they set them. It composes register summaries of the
stretches before, nearest first, each byte once, so splits give the same records as one pass. The driver
only lists files; headers are read where the data is decoded.

A filter on ``timestamp_us`` reaches the reader: stretches whose time words lie outside are not decoded. With
``timeSorted`` a reader first searches its range for the time by probing some kilobytes (high time words must
not decrease, so EVT3 recordings must be shorter than one wrap of 16.7 s), and leaves the rest unread.

Options: ``path`` (file, folder or URI; comma separated), ``format`` (auto, evt2, evt21, evt3),
``endian`` (little, little32, big), ``splitBytes``, ``timeRows`` (also emit high time words), ``live``
(low time part restarts with the high part) and ``timeSorted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition,
    LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema

from lumenflow.config import InvalidConfig
from lumenflow.functions import evt
from lumenflow.plans.hopping import floor_div
from lumenflow.plans.scan import running
from lumenflow.schema import EVENT_COLUMNS, RECORD

CHUNK_BYTES = 1 << 22
LOOK_BACK_BYTES = 1 << 16
HEADER_BYTES = 1 << 20
PROBE_BYTES = 1 << 12
SEARCH_BYTES = 1 << 18  # distance of the places that a search by time looks at
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Range(InputPartition):
    """File bytes; a word belongs to the range that holds its last byte."""

    path: str
    begin: int
    end: int


@dataclass
class Stretch:
    """A range resolved to whole words of one format."""

    fmt: str
    data_start: int
    begin: int
    end: int


def _filesystem(path: str):
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """Files and their sizes under a comma separated list of paths, in name order."""
    found = []
    for part in path.split(","):
        filesystem, inner = _filesystem(part.strip())
        prefix = part.strip()[: len(part.strip()) - len(inner)] if "://" in part else ""
        info = filesystem.get_file_info(inner)
        if info.type == pafs.FileType.Directory:
            infos = filesystem.get_file_info(pafs.FileSelector(inner, recursive=True))
        else:
            infos = [info]
        for item in infos:
            if item.type == pafs.FileType.NotFound:
                raise FileNotFoundError(item.path)
            if item.type == pafs.FileType.File:
                found.append((prefix + item.path, item.size))
    return sorted(found)


def read_header(path: str) -> evt.Header:
    filesystem, inner = _filesystem(path)
    with filesystem.open_input_file(inner) as file:
        size = min(file.size(), HEADER_BYTES)
        header = evt.parse_header(file.read_at(size, 0))
        while header.size == size < file.size():
            size = min(size * 2, file.size())
            header = evt.parse_header(file.read_at(size, 0))
    return header


class Options:
    def __init__(self, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}.get
        self.path = get("path")
        if not self.path:
            raise InvalidConfig("path", "is required")
        self.format = (get("format") or "auto").lower()
        if self.format != "auto" and self.format not in evt.FORMATS:
            raise InvalidConfig("format", f"unknown format {self.format!r}")
        self.endian = (get("endian") or "little").lower()
        if self.endian not in evt.ENDIANS:
            raise InvalidConfig("endian", f"unknown endian {self.endian!r}")
        self.split_bytes = int(get("splitbytes") or 64 << 20)
        self.time_rows = (get("timerows") or "false").lower() == "true"
        self.live = (get("live") or "false").lower() == "true"
        self.sorted = (get("timesorted") or "false").lower() == "true"
        self.prune = (get("prune") or "false").lower() == "true"
        self.since: int | None = None  # inclusive bounds of the times asked for
        self.until: int | None = None

    def resolve(self, header: evt.Header) -> str:
        return header.format if self.format == "auto" else evt.FORMATS[self.format]

    def ranges(self, path: str, end: int, begin: int = 0) -> list[Range]:
        step = max(self.split_bytes, 1)
        return [Range(path, at, min(at + step, end)) for at in range(begin, end, step)]

    def stretch(self, part: Range) -> Stretch:
        header = read_header(part.path)
        fmt = self.resolve(header)
        word = evt.WORD_BYTES[fmt]

        def whole(at: int) -> int:
            return header.size + max(at - header.size, 0) // word * word

        return Stretch(fmt, header.size, whole(part.begin), whole(part.end))


class _Behind:
    """Registers at ``at``, from as little of the file before as needed."""

    def __init__(self, file, part: Stretch, at: int, options: Options):
        self.file, self.part, self.options = file, part, options
        self.at, self.size = at, LOOK_BACK_BYTES
        self.summary = evt.Summary(live=options.live)

    def registers(self, wanted: set[str] = frozenset()) -> evt.Registers:
        fmt, start = self.part.fmt, self.part.data_start
        while self.at > start and not all(map(self.summary.knows, wanted)):
            begin = max(start, self.at - self.size)
            words = evt.words_of(self.file.read_at(self.at - begin, begin), fmt, self.options.endian)
            self.summary = evt.summarise(words, fmt, self.options.live).then(self.summary)
            self.at = begin
            self.size *= 2
        return self.summary.after(evt.Registers(base=0) if self.at == start else evt.Registers())


def _first_high(file, part: Stretch, at: int, options: Options) -> tuple[int, int] | None:
    """Value and place of the first high time word at or after ``at``."""
    while at < part.end:
        words = evt.words_of(file.read_at(min(PROBE_BYTES, part.end - at), at), part.fmt, options.endian)
        kind, value = evt.shape(words, part.fmt)
        found = np.flatnonzero(kind == 0x8)
        if len(found):
            return int(value[found[0]]), at + int(found[0]) * evt.WORD_BYTES[part.fmt]
        if not len(words):
            break
        at += len(words) * evt.WORD_BYTES[part.fmt]
    return None


def narrowed(file, part: Stretch, options: Options) -> Stretch:
    """The part of a range that can hold the times asked for, if high time words do not decrease."""
    bits = 12 if part.fmt == "evt3" else 6
    blocks = range(part.begin, part.end, SEARCH_BYTES)
    found: dict[int, tuple[int, int] | None] = {}

    def high(k: int) -> tuple[int, int] | None:
        if k not in found:
            found[k] = _first_high(file, part, blocks[k], options)
        return found[k]

    def first(test) -> int:
        """The first block for which ``test`` holds of its high time; all later ones hold too."""
        low, up = 0, len(blocks)
        while low < up:
            middle = (low + up) // 2
            low, up = (low, middle) if high(middle) is None or test(high(middle)[0]) else (middle + 1, up)
        return low

    begin, end = part.begin, part.end
    if options.since is not None:
        begin = blocks[max(0, first(lambda x: x >= options.since >> bits) - 1)]
    if options.until is not None:
        k = first(lambda x: x > options.until >> bits)
        if k < len(blocks) and high(k) is not None:
            end = high(k)[1]
    return Stretch(part.fmt, part.data_start, begin, max(begin, end))


def _batch(records: evt.Records, first_word: int, stream_id: str, schema: pa.Schema) -> pa.RecordBatch:
    n = len(records.word)
    kind = records.kind
    is_event, is_trigger = kind == evt.EVENT, kind == evt.TRIGGER

    def column(values, valid, type_):
        return pa.array(values, type=type_, mask=~valid)

    return pa.RecordBatch.from_arrays(
        [
            pa.array([stream_id], pa.string()).take(pa.array(np.zeros(n, dtype=np.int64))),
            pa.array((records.word + first_word) * evt.SEQ_PER_WORD + records.offset, pa.int64()),
            pa.array(kind.astype(object), pa.string()),
            column(records.timestamp_us.astype(np.int64), kind != evt.OTHER, pa.int64()),
            column(records.x.astype(np.int32), is_event, pa.int32()),
            column(records.y.astype(np.int32), is_event, pa.int32()),
            column(records.flag.astype(bool), is_event, pa.bool_()),
            column(records.trigger_id.astype(np.int32), is_trigger, pa.int32()),
            column(records.flag.astype(bool), is_trigger, pa.bool_()),
        ],
        schema=schema,
    )


def read_range(source: Range, options: Options) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(RECORD)
    filesystem, inner = _filesystem(source.path)
    part = options.stretch(source)
    word = evt.WORD_BYTES[part.fmt]
    stream_id = source.path.rsplit("/", 1)[-1]
    with filesystem.open_input_file(inner) as file:
        if options.sorted and part.begin < part.end:
            part = narrowed(file, part, options)
        behind = _Behind(file, part, part.begin, options)
        passed = evt.Summary(live=options.live)
        for at in range(part.begin, part.end, CHUNK_BYTES):
            data = file.read_at(min(CHUNK_BYTES, part.end - at), at)
            words = evt.words_of(data, part.fmt, options.endian)
            wanted = evt.missing(words, passed.after(behind.registers()), part.fmt, options.live)
            regs = passed.after(behind.registers(wanted & {"high"}))
            if not _outside(words, regs, part.fmt, options):
                regs = passed.after(behind.registers(wanted))
                records, _ = evt.decode(words, regs, part.fmt, options.time_rows, options.live)
                if len(records.word):
                    yield _batch(records, (at - part.data_start) // word, stream_id, schema)
            passed = passed.then(evt.summarise(words, part.fmt, options.live))


def _outside(words: np.ndarray, regs: evt.Registers, fmt: str, options: Options) -> bool:
    """Whether no word can have a time that is asked for."""
    if options.since is None and options.until is None:
        return False
    span = evt.time_span(words, regs, fmt)
    if span is None:
        return True
    before = options.until is not None and span[0] > options.until
    return before or (options.since is not None and span[1] <= options.since)


class _Reader(DataSourceReader):
    def __init__(self, options: Options):
        self.options = options

    def partitions(self):
        files = list_files(self.options.path)
        return [r for path, size in files for r in self.options.ranges(path, size)]

    def read(self, partition):
        # An empty folder yields one None partition.
        return iter(()) if partition is None else read_range(partition, self.options)


class _PruningReader(_Reader):
    """Takes bounds on ``timestamp_us``; Spark still applies the filters themselves."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if getattr(f, "attribute", None) == ("timestamp_us",) and isinstance(getattr(f, "value", None), int):
                low, high = {
                    EqualTo: (f.value, f.value),
                    GreaterThanOrEqual: (f.value, None),
                    GreaterThan: (f.value + 1, None),
                    LessThanOrEqual: (None, f.value),
                    LessThan: (None, f.value - 1),
                }.get(type(f), (None, None))
                options = self.options
                options.since = max((x for x in (options.since, low) if x is not None), default=None)
                options.until = min((x for x in (options.until, high) if x is not None), default=None)
            yield f


class _StreamReader(DataSourceStreamReader):
    """Follows growing and new files; the offset is the size of each file that was listed."""

    def __init__(self, options: Options):
        self.options = options

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {path: size for path, size in list_files(self.options.path)}

    def partitions(self, start, end):
        # A word that was cut off last time ends in the new bytes, so it is read now as a whole.
        return [
            part
            for path, size in end.items()
            if size > start.get(path, 0)
            for part in self.options.ranges(path, size, start.get(path, 0))
        ]

    def read(self, partition):
        return read_range(partition, self.options)


class EvtDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evt"

    def schema(self):
        return RECORD

    def reader(self, schema):
        options = Options(self.options)
        return _PruningReader(options) if options.prune else _Reader(options)

    def streamReader(self, schema):
        return _StreamReader(Options(self.options))


def read_records(spark: SparkSession, path: str, **options) -> DataFrame:
    """All records of one or more recordings."""
    Options({"path": path, **{k: str(v) for k, v in options.items()}})
    spark.dataSource.register(EvtDataSource)
    if spark.conf.get(PUSHDOWN, None) is None or spark.conf.get(PUSHDOWN) == "false":
        spark.conf.set(PUSHDOWN, "true")
    reader = spark.read.format("evt").option("path", path).option("prune", True)
    for key, value in options.items():
        reader = reader.option(key, str(value).lower() if isinstance(value, bool) else value)
    return reader.load()


def events_of(records: DataFrame) -> DataFrame:
    """Only events go on to filters; triggers and unknown words are skipped."""
    return records.where(F.col("record_type") == evt.EVENT).select(*EVENT_COLUMNS)


def read_events(spark: SparkSession, path: str, unwrap: bool = False, **options) -> DataFrame:
    """Events of recordings; ``unwrap`` continues time across the 24-bit wrap."""
    if not unwrap:
        return events_of(read_records(spark, path, **options))
    return unwrap_time(read_records(spark, path, timeRows=True, live=True, **options))


def unwrap_time(records: DataFrame, block_rows: int = 1 << 25) -> DataFrame:
    """Monotonic event time from records that include the high time words.

    A wrap is a high part that falls by more than half its range. Wraps are counted and the running
    maximum taken in blocks of the stream, so one long recording is unwrapped in parallel.
    """
    block = floor_div(F.col("seq"), block_rows)
    high = F.when(F.col("record_type") == evt.TIME, F.floor(F.col("timestamp_us") / 4096))
    ordered = records.where(F.col("record_type").isin(evt.TIME, evt.EVENT)).withColumn("high", high)
    stepped = running(ordered, ["stream_id"], "seq", block, last={"before": F.col("high")})
    falls = F.coalesce((F.col("before") - F.col("high") > 2048).cast("long"), F.lit(0))
    wrapped = running(
        stepped, ["stream_id"], "seq", block, total={"wraps": falls}, include_current=True
    )
    shifted = events_of(
        wrapped.withColumn("timestamp_us", F.col("timestamp_us") + F.col("wraps") * evt.WRAP_US)
    )
    peaked = running(
        shifted, ["stream_id"], "seq", block, peak={"at": F.col("timestamp_us")}, include_current=True
    )
    return peaked.withColumn("timestamp_us", F.col("at")).select(*EVENT_COLUMNS)


def time_range(events: DataFrame) -> DataFrame:
    """First and last event time per stream, in stream order."""
    return events.groupBy("stream_id").agg(
        F.min_by("timestamp_us", "seq").alias("first_us"),
        F.max_by("timestamp_us", "seq").alias("last_us"),
        F.count(F.lit(1)).alias("events"),
    )


def header_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per recording: header lines, version, size and the format that will be used."""
    schema = "stream_id string, lines array<string>, version string, width int, height int, format string"

    def headers(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            rows = []
            for name in table.column(0).to_pylist():
                h = read_header(name)
                rows.append((name.rsplit("/", 1)[-1], h.lines, h.version, h.width, h.height, h.format))
            columns = [list(c) for c in zip(*rows)] or [[]] * 6
            kinds = (pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["stream_id", "lines", "version", "width", "height", "format"],
            )

    names = spark.createDataFrame([(name,) for name, _ in list_files(path)], "path string")
    return names.mapInArrow(headers, schema)
