"""Event filters. Order matters: a rejected event never reaches a later filter."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from lumenflow.config import BackgroundConfig, PolarityConfig, StaticConfig
from lumenflow.plans.hopping import floor_div
from lumenflow.plans.lineage import materialise
from lumenflow.plans.ordered import scan_ordered, spread
from lumenflow.plans.scan import running
from lumenflow.plans.sized import broadcast_if_small

EventFilter = Callable[[DataFrame], DataFrame]


def effective_polarity(cfg: PolarityConfig) -> Column:
    return F.col("polarity") != F.lit(cfg.invert)


def polarity_filter(events: DataFrame, cfg: PolarityConfig = PolarityConfig()) -> DataFrame:
    """Keep one polarity, after the optional inversion. Stored values stay as they are."""
    if cfg.mode == "all":
        return events
    return events.where(effective_polarity(cfg) == F.lit(cfg.mode == "positive"))


def background_flags(events: DataFrame, cfg: BackgroundConfig = BackgroundConfig()) -> DataFrame:
    """Add ``supported``: another pixel within the radius fired in the preceding window.

    Time must not decrease with ``seq`` inside a stream. One shuffle on (tile, time slice) with a
    thin halo, then one pass in order that keeps the newest time per pixel of a tile, so each event
    is sorted once and not once per neighbour. A flickering pixel is cut by the time slices, a busy
    instant by the tiles.
    """
    r, side = cfg.radius_px, cfg.tile_px
    disc = [
        (dx, dy)
        for dx in range(-r, r + 1)
        for dy in range(-r, r + 1)
        if (dx or dy) and dx * dx + dy * dy <= r * r
    ]
    if not disc:
        return events.withColumn("supported", F.lit(False))
    length = cfg.window_us * cfg.slice_windows
    x, y, t = F.col("x").cast("long"), F.col("y").cast("long"), F.col("timestamp_us")
    payload = events.columns

    placed = (
        events.withColumn(
            "__tx", F.explode(F.sequence(floor_div(x - r, side), floor_div(x + r, side)))
        )
        .withColumn("__ty", F.explode(F.sequence(floor_div(y - r, side), floor_div(y + r, side))))
        .withColumn(
            "__slice",
            F.explode(F.sequence(floor_div(t, length), floor_div(t + cfg.window_us, length))),
        )
    )
    keys = ["__slice", "__tx", "__ty", "stream_id"]
    home = (
        (F.col("__tx") == floor_div(x, side))
        & (F.col("__ty") == floor_div(y, side))
        & (F.col("__slice") == floor_div(t, length))
    )
    reach = side + 2 * r
    placed = placed.select(
        *payload,
        *[k for k in keys if k not in payload],
        ((y - F.col("__ty") * side + r) * reach + x - F.col("__tx") * side + r).alias("__pixel"),
        home.alias("__home"),
    )
    steps = [dy * reach + dx for dx, dy in disc]
    ordered = spread(placed, keys).sortWithinPartitions(*keys, "seq")
    schema = T.StructType([*events.schema.fields, T.StructField("supported", T.BooleanType())])
    return ordered.mapInArrow(_newest_around(keys, payload, reach * reach, steps, cfg.window_us), schema)


def _newest_around(keys: list[str], payload: list[str], pixels: int, steps: list[int], window_us: int):
    """Flags home rows of tiles that arrive in order; between batches only one tile's times are held."""
    never = np.iinfo(np.int64).min // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = np.full(pixels, never), None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            changed = np.zeros(n, dtype=bool)
            for key in keys:
                here, before = batch.column(key).slice(1), batch.column(key).slice(0, n - 1)
                differ = pc.fill_null(pc.not_equal(here, before), False)
                differ = pc.or_(differ, pc.xor(here.is_null(), before.is_null()))
                changed[1:] |= differ.to_numpy(zero_copy_only=False)
            first, final = ([batch.column(key)[at].as_py() for key in keys] for at in (0, n - 1))
            if held != first:
                last[:] = never
            tile = np.cumsum(changed)
            times = batch.column("timestamp_us").to_numpy()
            pixel = tile * pixels + batch.column("__pixel").to_numpy()
            # Pixel and place in the batch as one number: the row before (pixel, i) is that pixel's latest.
            stamps = np.sort(pixel * n + np.arange(n))
            # The newest time of each pixel so far, by ranks that start over with every pixel.
            values, rank = np.unique(times, return_inverse=True)
            place = stamps % n
            run_of = np.cumsum(np.r_[False, np.diff(stamps // n) != 0])
            newest = values[np.maximum.accumulate(run_of * n + rank[place]) % n]
            home = batch.column("__home").to_numpy(zero_copy_only=False)
            asked = np.flatnonzero(home)
            since, supported = times[asked] - window_us, np.zeros(len(asked), dtype=bool)
            for step in steps:
                near = pixel[asked] + step
                at = np.searchsorted(stamps, near * n + asked) - 1
                here = (at >= 0) & (stamps[at] // n == near)
                before = np.where(tile[asked] == 0, last[near % pixels], never)
                supported |= np.maximum(np.where(here, newest[at], never), before) >= since
            if tile[-1]:
                last[:] = never
            held = final
            end = tile == tile[-1]
            np.maximum.at(last, pixel[end] % pixels, times[end])
            kept = batch.select(payload).filter(pa.array(home))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(supported)], [*payload, "supported"])

    return run


def background_filter(events: DataFrame, cfg: BackgroundConfig = BackgroundConfig()) -> DataFrame:
    return background_flags(events, cfg).where("supported").drop("supported")


#: Up to this many distinct event times, one ordered pass beats the rounds of joins.
SINGLE_PASS_TIMES = 5_000_000


def cleanup_instants(
    events: DataFrame, inactive_us: int, single_pass_times: int = SINGLE_PASS_TIMES
) -> DataFrame:
    """Times at which the idle sweep runs: first event later than the last sweep + ``inactive_us``.

    The rule chains from sweep to sweep over the whole stream. A counted, small set of distinct
    times is walked in order with constant memory; a larger one by ``_doubled_chain``.
    """
    times = materialise(events.select("stream_id", "timestamp_us").distinct())
    if times.limit(single_pass_times + 1).count() > single_pass_times:
        return _doubled_chain(times, inactive_us)

    def sweeps():
        last = 0

        def step(rows):
            nonlocal last
            at = rows["timestamp_us"].to_numpy()
            hits, i = [], int(np.searchsorted(at, last + inactive_us, side="right"))
            while i < len(at):
                hits.append(i)
                last = int(at[i])
                i = int(np.searchsorted(at, last + inactive_us, side="right"))
            return rows.iloc[hits].rename(columns={"timestamp_us": "cleanup_us"})

        return step

    return scan_ordered(
        times, ["stream_id"], ["timestamp_us"], sweeps, "stream_id string, cleanup_us long"
    )


def _doubled_chain(times: DataFrame, step: int) -> DataFrame:
    """The sweep chain by pointer doubling.

    Every distinct event time points to the sweep that would follow it; each round doubles the
    pointers' reach and the marked part of the chain, so the number of rounds is the logarithm of
    the number of sweeps and every round is a plain equi join.
    """
    slot = floor_div(F.col("timestamp_us"), step)
    slots = times.groupBy("stream_id", slot.alias("slot")).agg(F.min("timestamp_us").alias("first_us"))
    # First event after a slot, for thresholds behind the last event of their own slot.
    following = running(
        slots.withColumn("back", -F.col("slot")),
        ["stream_id"],
        "back",
        floor_div(F.col("back"), 1 << 16),
        last={"next_first_us": F.col("first_us")},
    ).select("stream_id", "slot", "next_first_us", "first_us")

    # Threshold t + step lies exactly one slot later; look for a later event there.
    probes = times.select(
        "stream_id",
        (slot + 1).alias("slot"),
        (F.col("timestamp_us") + step).alias("at"),
        F.lit(True).alias("asks"),
        "timestamp_us",
    )
    marks = times.select(
        "stream_id", slot.alias("slot"), F.col("timestamp_us").alias("at"), F.lit(False).alias("asks"), "timestamp_us"
    )
    later = (
        Window.partitionBy("stream_id", "slot")
        .orderBy(F.desc("at"), F.desc("asks"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    found = (
        probes.union(marks)
        .withColumn("inside_us", F.min(F.when(~F.col("asks"), F.col("at"))).over(later))
        .where("asks")
        .select("stream_id", F.col("timestamp_us").alias("node"), "slot", "inside_us")
    )
    # An empty threshold slot has no row of its own: use the first event after the slot before it.
    own = following.select("stream_id", "slot", "next_first_us")
    before = following.select("stream_id", (F.col("slot") + 1).alias("slot"), F.col("next_first_us").alias("after_previous"))
    pointers = materialise(
        found.join(own, ["stream_id", "slot"], "left")
        .join(before, ["stream_id", "slot"], "left")
        .select(
            "stream_id",
            "node",
            F.coalesce(
                "inside_us",
                F.when(F.col("next_first_us").isNotNull(), F.col("next_first_us")),
                F.when(F.col("after_previous") > F.col("node") + step, F.col("after_previous")),
            ).alias("next"),
        )
        .where("next is not null")
    )
    start = times.where(F.col("timestamp_us") > step).groupBy("stream_id").agg(F.min("timestamp_us").alias("node"))
    span = times.groupBy("stream_id").agg((F.max("timestamp_us") - F.min("timestamp_us")).alias("span"))
    longest = span.agg(F.max("span")).first()[0]
    marked, jump = materialise(start), pointers
    for _ in range(math.ceil(math.log2((longest or 0) / step + 2))):
        onward = marked.join(jump, ["stream_id", "node"]).select("stream_id", F.col("next").alias("node"))
        marked = materialise(marked.union(onward))
        hop = jump.select("stream_id", F.col("node").alias("next"), F.col("next").alias("beyond"))
        jump = materialise(
            jump.join(hop, ["stream_id", "next"]).select("stream_id", "node", F.col("beyond").alias("next"))
        )
    return marked.withColumnRenamed("node", "cleanup_us")


def static_flags(events: DataFrame, cfg: StaticConfig = StaticConfig()) -> DataFrame:
    """Add ``is_static``: the event's cell has been active too long and too often.

    A cell's history restarts when a sweep finds it idle for more than ``inactive_after_us``.
    ``inactive_after_us=None`` never restarts. All per-cell scans are split into row blocks, so a
    cell that holds most of a recording is processed in parallel.
    """
    keys = ["stream_id", "__sx", "__sy"]
    block = floor_div(F.col("seq"), cfg.block_rows)
    t = F.col("timestamp_us")
    cells = events.withColumn("__sx", floor_div(F.col("x").cast("long"), cfg.cell_size)).withColumn(
        "__sy", floor_div(F.col("y").cast("long"), cfg.cell_size)
    )
    idle = cfg.inactive_after_us
    stepped = running(
        cells, keys, "seq", block, last={"__prev": t}, total={"__n": F.lit(1).cast("long")}
    )
    opens = F.col("__prev").isNull()
    if idle is not None:
        # The latest sweep at or before an event lies in its own slot or the one before.
        per_slot = materialise(
            cleanup_instants(events, idle)
            .withColumn("slot", floor_div(F.col("cleanup_us"), idle))
            .withColumn("slot", F.explode(F.array(F.col("slot"), F.col("slot") + 1)))
            .groupBy("stream_id", "slot")
            .agg(F.sort_array(F.collect_set("cleanup_us"), asc=False).alias("__sweeps"))
        )
        stepped = stepped.withColumn("slot", floor_div(t, idle)).join(
            broadcast_if_small(per_slot), ["stream_id", "slot"], "left"
        )
        latest = F.element_at(F.filter("__sweeps", lambda c: c <= t), 1)
        opens = opens | F.coalesce(latest - F.col("__prev") > idle, F.lit(False))
    # The second scan reads its input twice; a written table spares it the first scan's sort.
    flagged = materialise(stepped.withColumn("__opens", opens).drop("slot", "__sweeps"))
    scored = running(
        flagged,
        keys,
        "seq",
        block,
        last={"__first_us": F.when(F.col("__opens"), t), "__first_n": F.when(F.col("__opens"), F.col("__n"))},
        include_current=True,
    ).withColumn("__count", F.col("__n") + 1 - F.col("__first_n"))
    held = F.greatest(t - F.col("__first_us"), F.lit(0)) >= cfg.stable_after_us
    return scored.select(
        *events.columns, (held & (F.col("__count") >= cfg.min_events)).alias("is_static")
    )


def static_filter(events: DataFrame, cfg: StaticConfig = StaticConfig()) -> DataFrame:
    return static_flags(events, cfg).where(~F.col("is_static")).drop("is_static")


def mask_pixels(events: DataFrame, pixels: Iterable[tuple[int, int]]) -> DataFrame:
    """Drop listed defective pixels. At most 64 are allowed, so this is a literal predicate."""
    listed = [F.struct(F.lit(int(x)), F.lit(int(y))) for x, y in pixels]
    if not listed:
        return events
    here = F.struct(F.col("x").cast("int"), F.col("y").cast("int"))
    return events.where(~here.isin(*listed))


def clip_range(events: DataFrame, start_us: int | None, end_us: int | None) -> DataFrame:
    """Inclusive time range; reaches the scan of a prepared table or a recording as a filter."""
    if start_us is not None:
        events = events.where(F.col("timestamp_us") >= start_us)
    if end_us is not None:
        events = events.where(F.col("timestamp_us") <= end_us)
    return events


def time_decreases(events: DataFrame, block_rows: int = 1 << 25) -> DataFrame:
    """Rows whose time is earlier than that of the event before them in the stream."""
    previous = running(
        events,
        ["stream_id"],
        "seq",
        floor_div(F.col("seq"), block_rows),
        last={"previous_us": F.col("timestamp_us")},
    )
    return previous.where(F.col("timestamp_us") < F.col("previous_us"))


def chain(*filters: EventFilter) -> EventFilter:
    """Compose filters; each sees only what the one before it accepted."""

    def apply(events: DataFrame) -> DataFrame:
        for step in filters:
            events = events.transform(step)
        return events

    return apply


def configured(
    polarity: PolarityConfig | None = PolarityConfig(),
    background: BackgroundConfig | None = None,
    static: StaticConfig | None = None,
) -> EventFilter:
    """Polarity, then background, then static; ``None`` switches a filter off."""
    steps: list[EventFilter] = []
    if polarity is not None:
        steps.append(lambda df: polarity_filter(df, polarity))
    if background is not None:
        steps.append(lambda df: background_filter(df, background))
    if background is not None and static is not None:
        # The static scans read their input several times; do not repeat the neighbour search.
        steps.append(materialise)
    if static is not None:
        steps.append(lambda df: static_filter(df, static))
    return chain(*steps)


def accepted_flags(events: DataFrame, accept: EventFilter) -> DataFrame:
    """Keep every event and add ``accepted``, for displays that also show rejected events."""
    kept = accept(events).select("stream_id", "seq", F.lit(True).alias("accepted"))
    return events.join(kept, ["stream_id", "seq"], "left").withColumn(
        "accepted", F.coalesce("accepted", F.lit(False))
    )
