"""Vectorised decoders for packed sensor words, and the matching text header.

Each decoder takes the words of one stretch and the register state before it, and returns the
records plus the state after it. A register is ``None`` until the stream has set it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the formats.
FORMATS = {
    "evt2": "evt2", "evt2.0": "evt2", "2.0": "evt2",
    "evt21": "evt21", "evt2.1": "evt21", "2.1": "evt21",
    "evt3": "evt3", "evt3.0": "evt3", "3.0": "evt3",
}
ENDIANS = ("little", "little32", "big")
WORD_BYTES = {"evt2": 4, "evt21": 8, "evt3": 2}
#: Order key of a record: word number times this, plus the position inside a vector word.
SEQ_PER_WORD = 32
EVENT, TRIGGER, OTHER, TIME = "event", "trigger", "other", "time"
WRAP_US = 1 << 24


@dataclass
class Header:
    """Leading ``%`` lines; later lines override earlier ones."""

    lines: list[str] = field(default_factory=list)
    version: str | None = None
    width: int | None = None
    height: int | None = None
    size: int = 0

    @property
    def format(self) -> str:
        """Missing or unknown versions are read as the oldest format."""
        return FORMATS.get((self.version or "").strip(), "evt2")


def parse_header(head: bytes) -> Header:
    header = Header()
    while head[header.size : header.size + 1] == b"%":
        end = head.find(b"\n", header.size)
        stop = len(head) if end < 0 else end + 1
        line = head[header.size : stop].decode("utf-8", "replace").strip()
        header.size = stop
        header.lines.append(line)
        if line.startswith("% evt "):
            header.version = line.removeprefix("% evt ")
        if found := re.fullmatch(r"% geometry (\d+)x(\d+)", line):
            header.width, header.height = int(found[1]), int(found[2])
        elif line.startswith("% format ") and ";" in line:
            pairs = dict(p.split("=", 1) for p in line.split(";")[1:] if "=" in p)
            if pairs.get("width", "").isdigit() and pairs.get("height", "").isdigit():
                header.width, header.height = int(pairs["width"]), int(pairs["height"])
    return header


def words_of(data: bytes, fmt: str, endian: str) -> np.ndarray:
    """Whole words of ``data``; a cut-off last word is ignored."""
    size = WORD_BYTES[fmt]
    data = data[: len(data) - len(data) % size]
    if fmt == "evt21" and endian == "little32":
        halves = np.frombuffer(data, "<u4").astype(np.uint64)
        return (halves[0::2] << np.uint64(32)) | halves[1::2]
    order = ">" if endian == "big" else "<"
    return np.frombuffer(data, f"{order}u{size}").astype(f"u{size}")


@dataclass(frozen=True)
class Registers:
    high: int | None = None
    low: int | None = None
    y: int | None = None
    base: int | None = None
    polarity: bool = False


@dataclass(frozen=True)
class Summary:
    """What a stretch of words does to the registers; summaries of neighbouring stretches compose.

    ``base`` is the vector base at the end if the stretch set it, ``moved`` how far vectors moved it since, or
    over the whole stretch. The low time part is kept apart for words before and after the first high part,
    because a live feed restarts it there if the high part before was another one.
    """

    first_high: int | None = None
    high: int | None = None
    low_before: int | None = None
    low_after: int | None = None
    y: int | None = None
    base: int | None = None
    moved: int = 0
    polarity: bool = False
    live: bool = False

    def then(self, later: Summary) -> Summary:
        before, after = self.low_before, self.low_after
        if self.first_high is None:
            before, after = _last(before, later.low_before), later.low_after
        else:
            after = _last(after, later.low_before)
            if later.live and later.first_high is not None and later.first_high != self.high:
                after = 0
            after = _last(after, later.low_after)
        set_later = later.base is not None
        return Summary(
            first_high=later.first_high if self.first_high is None else self.first_high,
            high=_last(self.high, later.high),
            low_before=before,
            low_after=after,
            y=_last(self.y, later.y),
            base=_last(self.base, later.base),
            moved=later.moved if set_later else self.moved + later.moved,
            polarity=later.polarity if set_later else self.polarity,
            live=self.live or later.live,
        )

    def after(self, regs: Registers) -> Registers:
        """The registers behind the stretch, given those before it."""
        low = _last(regs.low, self.low_before)
        if self.live and None not in (self.first_high, regs.high) and self.first_high != regs.high:
            low = 0
        base, polarity = (regs.base, regs.polarity) if self.base is None else (self.base, self.polarity)
        return Registers(
            high=_last(regs.high, self.high),
            low=_last(low, self.low_after),
            y=_last(regs.y, self.y),
            base=None if base is None else min(base + self.moved, 0xFFFF),
            polarity=polarity,
        )

    def knows(self, register: str) -> bool:
        """Whether the register behind the stretch does not depend on what was before."""
        if register == "low":
            if self.low_after is not None:
                return True
            return self.low_before is not None and (self.first_high is None or not self.live)
        return getattr(self, register) is not None


def _last(earlier, later):
    return earlier if later is None else later


def shape(words: np.ndarray, fmt: str) -> tuple[np.ndarray, np.ndarray]:
    """Kind of each word and its high time part, if it is one."""
    if fmt == "evt3":
        w = words.astype(np.int64)
        return w >> 12, w & 0xFFF
    top = words.astype(np.int64) if fmt == "evt2" else (words >> np.uint64(32)).astype(np.int64)
    return top >> 28, top & 0x0FFFFFFF


def summarise(words: np.ndarray, fmt: str, live: bool = False) -> Summary:
    kind, value = shape(words, fmt)
    highs = np.flatnonzero(kind == 0x8)
    first = int(value[highs[0]]) if len(highs) else None
    high = int(value[highs[-1]]) if len(highs) else None
    if fmt != "evt3":
        return Summary(first_high=first, high=high)
    lows, at_low = np.flatnonzero(kind == 0x6), value
    border = highs[0] if len(highs) else len(kind)
    if live and len(highs):
        changes = highs[1:][value[highs[1:]] != value[highs[:-1]]]
        at_low = value.copy()
        at_low[changes] = 0
        lows = np.union1d(lows, changes)
    before, after = lows[lows < border], lows[lows > border]
    width = np.where(kind == 0x4, 12, np.where(kind == 0x5, 8, 0))
    bases, ys = np.flatnonzero(kind == 0x3), np.flatnonzero(kind == 0x0)
    since = bases[-1] if len(bases) else 0
    return Summary(
        first_high=first,
        high=high,
        low_before=int(at_low[before[-1]]) if len(before) else None,
        low_after=int(at_low[after[-1]]) if len(after) else None,
        y=int(value[ys[-1]] & 0x7FF) if len(ys) else None,
        base=int(value[since] & 0x7FF) if len(bases) else None,
        moved=int(width[since:].sum()),
        polarity=bool(len(bases) and value[since] & 0x800),
        live=live,
    )


def missing(words: np.ndarray, regs: Registers, fmt: str, live: bool = False) -> set[str]:
    """Unset registers that ``words`` use before they set them."""
    kind, _ = shape(words, fmt)

    def first(*kinds: int) -> int:
        at = np.flatnonzero(np.isin(kind, kinds))
        return int(at[0]) if len(at) else len(kind)

    if fmt != "evt3":
        return {"high"} if regs.high is None and first(0x0, 0x1, 0xA) < first(0x8) else set()
    timed, placed, vectors = first(0x2, 0x4, 0x5, 0xA), first(0x2, 0x4, 0x5), first(0x4, 0x5)
    found = {
        "high": timed < first(0x8) or live,  # a live feed needs the high part before to know of a restart
        "low": timed < first(0x6) or live,
        "y": placed < first(0x0),
        "base": vectors < first(0x3),
    }
    return {name for name, used in found.items() if used and getattr(regs, name) is None}


def time_span(words: np.ndarray, regs: Registers, fmt: str) -> tuple[int, int] | None:
    """Bounds of the times that ``words`` can have, or None if no word has a time."""
    kind, value = shape(words, fmt)
    highs = value[kind == 0x8]
    if regs.high is not None:
        highs = np.append(highs, regs.high)
    if not len(highs):
        return None
    bits = 12 if fmt == "evt3" else 6
    return int(highs.min()) << bits, int(highs.max()) + 1 << bits


@dataclass
class Records:
    word: np.ndarray
    offset: np.ndarray
    kind: np.ndarray
    timestamp_us: np.ndarray
    x: np.ndarray
    y: np.ndarray
    flag: np.ndarray
    trigger_id: np.ndarray


def _held(mask: np.ndarray, values: np.ndarray, initial: int | None):
    """Last value set at or before each position; -1 where the register is still unset."""
    at = np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))
    start = -1 if initial is None else initial
    return np.where(at >= 0, values[np.maximum(at, 0)].astype(np.int64), start), at


def _records(parts) -> Records:
    """Concatenate record groups (word, offset, kind, ts, x, y, flag, id) in stream order."""
    columns = []
    for i in range(8):
        pieces = []
        for part in parts:
            n = len(part[0])
            value = part[i]
            pieces.append(np.full(n, value) if np.isscalar(value) else value)
        columns.append(np.concatenate(pieces))
    order = np.lexsort((columns[1], columns[0]))
    return Records(*[c[order] for c in columns])


def _end(held: np.ndarray, initial):
    return initial if not len(held) else (None if held[-1] < 0 else int(held[-1]))


def _decode_high_low(words, regs, kind, low, high_value, events, trigger_id, trigger_value, time_rows):
    """Shared frame of the two formats whose only register is the high time part."""
    index = np.arange(len(words))
    is_time = kind == 0x8
    high, _ = _held(is_time, high_value, regs.high)
    known = high >= 0
    ts = (high << 6) | low
    trigger = np.flatnonzero((kind == 0xA) & known)
    other = np.flatnonzero(~np.isin(kind, (0x0, 0x1, 0x8, 0xA)))
    parts = [
        events(known, ts),
        (trigger, 0, TRIGGER, ts[trigger], -1, -1, trigger_value[trigger].astype(bool), trigger_id[trigger]),
        (other, 0, OTHER, -1, -1, -1, False, -1),
    ]
    if time_rows:
        at = index[is_time]
        parts.append((at, 0, TIME, high[at] << 6, -1, -1, False, -1))
    return _records(parts), Registers(high=_end(high, regs.high))


def decode_evt2(words: np.ndarray, regs: Registers, time_rows: bool = False):
    w = words.astype(np.int64)
    kind = w >> 28

    def events(known, ts):
        at = np.flatnonzero((kind <= 1) & known)
        v = w[at]
        return (at, 0, EVENT, ts[at], (v >> 11) & 0x7FF, v & 0x7FF, kind[at] == 1, -1)

    return _decode_high_low(
        words, regs, kind, (w >> 22) & 0x3F, w & 0x0FFFFFFF, events, (w >> 8) & 0x1F, w & 1, time_rows
    )


def decode_evt21(words: np.ndarray, regs: Registers, time_rows: bool = False):
    top = (words >> np.uint64(32)).astype(np.int64)
    mask = (words & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    kind = top >> 28

    def events(known, ts):
        at = np.flatnonzero((kind <= 1) & known)
        bits = (mask[at, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
        row, offset = np.nonzero(bits)
        word = at[row]
        v = top[word]
        return (word, offset, EVENT, ts[word], ((v >> 11) & 0x7FF) + offset, v & 0x7FF, kind[word] == 1, -1)

    return _decode_high_low(
        words, regs, kind, (top >> 22) & 0x3F, top & 0x0FFFFFFF, events, (top >> 8) & 0x1F, top & 1, time_rows
    )


def decode_evt3(words: np.ndarray, regs: Registers, time_rows: bool = False, live: bool = False):
    """``live`` restarts the low time part at every change of the high part, as a live feed does."""
    w = words.astype(np.int64)
    kind, value = w >> 12, w & 0xFFF
    is_high = kind == 0x8
    high, _ = _held(is_high, value, regs.high)
    sets_low, low_value = kind == 0x6, value
    if live:
        previous = np.concatenate([[-1 if regs.high is None else regs.high], high[:-1]])
        restart = is_high & (previous >= 0) & (previous != high)
        sets_low, low_value = sets_low | restart, np.where(restart, 0, value)
    low, _ = _held(sets_low, low_value, regs.low)
    y, _ = _held(kind == 0x0, value & 0x7FF, regs.y)
    ready = (high >= 0) & (low >= 0)
    ts = (high << 12) | low

    # Vector words advance the base whether or not they emit.
    width = np.where(kind == 0x4, 12, np.where(kind == 0x5, 8, 0))
    passed = np.cumsum(width) - width
    base_start, base_at = _held(kind == 0x3, value & 0x7FF, regs.base or 0)
    base = base_start + passed - np.where(base_at >= 0, passed[np.maximum(base_at, 0)], 0)
    base = np.minimum(base, 0xFFFF)
    polarity, _ = _held(kind == 0x3, (value >> 11) & 1, int(regs.polarity))

    single = np.flatnonzero((kind == 0x2) & ready & (y >= 0))
    vector = np.flatnonzero((width > 0) & ready & (y >= 0))
    valid = np.where(kind[vector] == 0x5, value[vector] & 0xFF, value[vector])
    row, offset = np.nonzero((valid[:, None] >> np.arange(12)) & 1)
    word = vector[row]
    trigger = np.flatnonzero((kind == 0xA) & ready)
    other = np.flatnonzero(~np.isin(kind, (0x0, 0x2, 0x3, 0x4, 0x5, 0x6, 0x8, 0xA)))
    parts = [
        (single, 0, EVENT, ts[single], value[single] & 0x7FF, y[single], (value[single] & 0x800) != 0, -1),
        (word, offset, EVENT, ts[word], base[word] + offset, y[word], polarity[word] == 1, -1),
        (trigger, 0, TRIGGER, ts[trigger], -1, -1, (value[trigger] & 1) == 1, (value[trigger] >> 8) & 0xF),
        (other, 0, OTHER, -1, -1, -1, False, -1),
    ]
    if time_rows:
        at = np.flatnonzero(is_high)
        parts.append((at, 0, TIME, high[at] << 12, -1, -1, False, -1))
    if not len(w):
        return _records(parts), regs
    # A base that was only advanced, never set, stays unknown: a reader must look further back.
    base_known = base_at[-1] >= 0 or regs.base is not None
    after = Registers(
        high=_end(high, regs.high),
        low=_end(low, regs.low),
        y=_end(y, regs.y),
        base=int(base[-1] + width[-1]) if base_known else None,
        polarity=bool(polarity[-1]),
    )
    return _records(parts), after


def decode(words, regs: Registers, fmt: str, time_rows: bool = False, live: bool = False):
    if fmt == "evt2":
        return decode_evt2(words, regs, time_rows)
    if fmt == "evt21":
        return decode_evt21(words, regs, time_rows)
    return decode_evt3(words, regs, time_rows, live)
