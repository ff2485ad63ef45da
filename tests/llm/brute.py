"""Plain readings of the operators' rules, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text: str | None, width: int) -> set[tuple[str, ...]]:
    found = WORD.findall(text or "")
    found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in found]
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def near_components(rows: list[tuple[int, str | None]], width: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest id reachable), by an inverted index of all shingles."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in sets.items():
        common: dict[int, int] = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeated_bytes(rows: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (bytes, removed, spans, digest of what is left)."""
    seen: set[bytes] = set()
    out = {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(window)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        left = bytes(c for c, g in zip(data, gone) if not g)
        out[i] = (len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest())
    return out
