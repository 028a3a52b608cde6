"""Codes of byte contexts: a byte and the bytes before it in its text, as one integer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from vellum.llm import textbytes as tb

#: Positions coded at once; bounds the memory of a worker however long a text is.
WINDOW = 1 << 20


def windows(data: np.ndarray, offsets: np.ndarray, order: int, size: int = WINDOW) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first position, end, codes): the byte is the lowest of a code's bytes; bytes before the text are 0."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    for a in range(0, len(data), size):
        b = min(a + size, len(data))
        codes = data[a:b].astype(np.uint64)
        for back in range(1, order + 1):
            first = max(a, back)
            if first >= b:
                break
            codes[first - a :] |= data[first - back : b - back].astype(np.uint64) << np.uint64(8 * back)
        near = starts[np.searchsorted(starts, a - order) : np.searchsorted(starts, b)]
        for r in range(order):
            at = near + r
            at = at[(at >= a) & (at < b)]
            codes[at - a] &= np.uint64((1 << 8 * (r + 1)) - 1)
        # a text shorter than the order: its successor's start already cut what it must
        yield a, b, codes


def sums_by_text(values: np.ndarray, a: int, offsets: np.ndarray, into: np.ndarray) -> None:
    """Add values (a row for each position from a on) to the texts that hold the positions."""
    b = a + len(values)
    lo, hi = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
    edges = np.clip(offsets[lo:hi], a, b) - a
    full = np.diff(np.concatenate((edges, [b - a]))) > 0
    if full.any():
        into[lo:hi][full] += np.add.reduceat(values, edges[full], axis=0)


def arrow_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tb.utf8(column)
    return tb.lower(data), offsets
