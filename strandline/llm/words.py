"""Words of whole texts as Arrow arrays, cut from the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: What a byte is to a cutter.
INSIDE, GAP, STOP = 0, 1, 2
#: Bytes that are cut in one go.
WINDOW = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """``text`` (lower-cased A-Z only), and for each word its row in the batch and its piece: words of one piece stand side by side with only gaps between. The last ``ahead`` words belong to the next Words and are context here."""

    text: pa.Array
    row: np.ndarray
    piece: np.ndarray
    ahead: int


def _cut(data: np.ndarray, kind: np.ndarray, rows: np.ndarray, begins: np.ndarray, ahead: int) -> Words:
    """Words of ``data``; texts begin at ``begins`` and are rows ``rows``."""
    inside = kind == INSIDE
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[begins] = inside[begins]
    stops = (kind == STOP).astype(np.int32)
    stops[begins] += 1
    where = np.flatnonzero(start)
    own = np.zeros(len(data), np.int32)
    own[begins] = 1
    offsets = np.append(np.cumsum(inside)[where] - 1, np.count_nonzero(inside)).astype(np.int32)
    text = pa.StringArray.from_buffers(len(where), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]]))
    return Words(text, rows[np.cumsum(own)[where] - 1], np.cumsum(stops)[where], ahead)


def _kinds(data: np.ndarray, table: np.ndarray | None) -> np.ndarray:
    if table is not None:
        return table[data]
    # Letters A-Z, a-z and U+00C0 to U+00FF, which are the byte C3 and the one behind it.
    letter = LETTER[data]
    letter[1:] |= data[:-1] == 0xC3
    return np.where(letter, np.uint8(INSIDE), np.uint8(GAP))


LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[0xC3] = True

#: Blanks and tabs part words, these also pieces; anything else is part of a word.
PIECES = np.zeros(256, np.uint8)
PIECES[[0x20, 0x09]] = GAP
PIECES[[*b".,;:!?\n\x0b\x0c\r"]] = STOP


def words(batch: pa.RecordBatch, table: np.ndarray | None = PIECES, context: int = 0, window: int | None = None) -> Iterator[Words]:
    """Words of the first column (binary; null: none), cut by ``table``, or runs of Latin-1 letters without one.

    Short texts are cut many at once, long ones a window at a time, which ends
    between words; where it ends within a piece, ``context`` words of what
    follows stand behind, so that memory is bounded by windows and words.
    """
    column = batch.column(0).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    n, at, window = len(column), 0, window or WINDOW
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + window, "right")) - 1)
        data = whole[offsets[at] : offsets[end]]
        if len(data) <= window:
            sizes = np.diff(offsets[at : end + 1])
            full = np.flatnonzero(sizes)
            if len(full):
                yield _cut(data, _kinds(data, table), full + at, (offsets[at:end] - offsets[at])[full], 0)
        else:  # one long text
            yield from _long(data, at, table, context, window)
        at = end


def _long(data: np.ndarray, row: int, table, context: int, window: int) -> Iterator[Words]:
    at, zero = 0, np.zeros(1, np.int64)
    while at < len(data):
        reach, stop = window, None
        while stop is None:  # until the window holds a place to cut
            end = min(len(data), at + reach)
            kind = _kinds(data[at:end], table)
            if end == len(data):
                stop = end - at
                break
            ends = np.flatnonzero(kind == STOP)
            gaps = ends if len(ends) else np.flatnonzero(kind != INSIDE)
            # A gap needs words of context behind it, and all need the byte before the window's own edge.
            if len(ends):
                stop = int(ends[-1]) + 1
            elif len(gaps):
                starts = np.flatnonzero((kind[1:] == INSIDE) & (kind[:-1] != INSIDE)) + 1
                if len(starts) > context + 1:
                    stop = int(starts[-context - 2])
                    behind = int(gaps[-1])  # the last word may be cut
                    yield _cut(data[at : at + behind], kind[:behind], np.array([row]), zero, int(np.count_nonzero((starts >= stop) & (starts < behind))))
                    at += stop
                    stop = -1
                    break
            reach *= 2
        if stop == -1:
            continue
        yield _cut(data[at : at + stop], kind[:stop], np.array([row]), zero, 0)
        at += stop
