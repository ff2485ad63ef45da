"""Connected components of many small grids at once, in numpy."""

from __future__ import annotations

import numpy as np

#: The four forward neighbours; the other four follow by symmetry.
FORWARD = ((0, 1), (1, -1), (1, 0), (1, 1))


def connected(group: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """8-connected components per group.

    Returns, per row, the index of the component's first row in (group, cx, cy) order.
    Cells must be unique. Works for negative coordinates.
    """
    n = len(cx)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    order = np.lexsort((cy, cx, group))
    g = np.unique(group, return_inverse=True)[1].astype(np.int64)[order]
    x = cx[order].astype(np.int64) - int(cx.min()) + 1
    y = cy[order].astype(np.int64) - int(cy.min()) + 1
    width, height = int(x.max()) + 2, int(y.max()) + 2
    key = (g * width + x) * height + y
    left, right = [], []
    for dx, dy in FORWARD:
        wanted = key + dx * height + dy
        at = np.searchsorted(key, wanted)
        at[at == n] = 0
        hit = np.flatnonzero(key[at] == wanted)
        left.append(hit)
        right.append(at[hit])
    a, b = np.concatenate(left), np.concatenate(right)

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    result = np.empty(n, dtype=np.int64)
    result[order] = order[label]
    return result
