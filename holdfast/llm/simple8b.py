"""Simple-8b: words of 64 bits, 4 for a selector and 60 for as many ids as fit at one width.

Ids are coded in blocks of ``BLOCK``; where each block's words begin is kept, so that blocks decode independently and all
words of one selector decode in one numpy operation. A value that needs more than 60 bits is escaped: its word has selector
15 and, in the other bits, its place in a list of whole values.
"""

from __future__ import annotations

import numpy as np

#: Bits for each value under selectors 0 to 13; such a word holds 60 // bits values.
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
BLOCK = 1024
_counts = np.ones(16, np.int64)
_counts[: len(WIDTHS)] = 60 // WIDTHS
_low = np.uint64((1 << 60) - 1)


def _selectors(width: np.ndarray) -> np.ndarray:
    """For each place in blocks (rows), the selector of a word that begins there: the most values that fit."""
    blocks, size = width.shape
    padded = np.zeros((blocks, size + 60), np.int8)
    padded[:, :size] = width
    # The largest width among the next k places, for each k from the one before; the padding keeps blocks apart.
    widest, seen = padded.ravel(), 1
    out = np.where(widest > 60, ESCAPE, 13).astype(np.int8)
    for s in range(len(WIDTHS) - 2, -1, -1):
        more = int(_counts[s]) - seen
        ahead = np.zeros_like(widest)
        np.maximum(widest[:-more], widest[more:], out=ahead[:-more])
        widest, seen = ahead, seen + more
        out[widest <= WIDTHS[s]] = s
    return out.reshape(blocks, size + 60)[:, :size]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block, and escaped values (all unsigned 64-bit)."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # Places after the last value are coded as zeros and cut off by the number of values.
    whole = np.zeros(blocks * BLOCK, np.uint64)
    whole[:n] = values
    width = np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), whole, side="right").astype(np.int8)
    chosen = _selectors(width.reshape(blocks, BLOCK)).ravel()
    step = _counts[chosen]
    place, live, starts = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        at = live * BLOCK + place[live]
        starts.append(at)
        place[live] += step[at]
        live = live[place[live] < BLOCK]
    start = np.sort(np.concatenate(starts))
    selector = chosen[start].astype(np.uint64)
    words = selector << np.uint64(60)
    padded = np.concatenate([whole, np.zeros(60, np.uint64)])
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s == ESCAPE:
            words[here] |= np.arange(len(here), dtype=np.uint64)
            continue
        end = (start[here] // BLOCK + 1) * BLOCK
        for j in range(_counts[int(s)]):
            at = start[here] + j
            words[here] |= np.where(at < end, padded[at], np.uint64(0)) << np.uint64(j * WIDTHS[int(s)])
    return words, np.searchsorted(start, np.arange(blocks) * BLOCK).astype(np.uint64), whole[start[selector == ESCAPE]]


def decode(words: np.ndarray, block_starts: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The n values that were encoded."""
    blocks = len(block_starts)
    out = np.zeros(blocks * BLOCK, np.uint64)
    if not n:
        return out[:0]
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = _counts[selector]
    before = np.cumsum(count) - count
    first = block_starts.astype(np.int64)
    block = np.repeat(np.arange(blocks), np.diff(np.append(first, len(words))))
    start = before - before[first][block] + block * BLOCK
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[start[here]] = escaped[(words[here] & _low).astype(np.int64)]
            continue
        mask, end = np.uint64((1 << int(WIDTHS[s])) - 1), (block[here] + 1) * BLOCK
        for j in range(_counts[s]):
            at = start[here] + j
            inside = at < end
            out[at[inside]] = (words[here][inside] >> np.uint64(j * WIDTHS[s])) & mask
    return out[:n]
