"""Word hashes of Arrow text columns, vectorised over a block of whole texts.

Words are runs of bytes other than space, tab, LF, VT, FF and CR, after lower-casing A-Z.
A block holds as many whole texts as fit in ``BLOCK`` bytes, and at least one, so memory
is bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_OF_BYTE = mix64(_LOWER.astype(np.uint64) + np.uint64(1))
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers = np.ones(1, dtype=np.uint64)
_inverse_powers = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse_powers
    if n > len(_powers):
        size = 1 << (n - 1).bit_length()
        _powers, _inverse_powers = (
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, dtype=np.uint64)]))
            for base in (_ODD, _INVERSE)
        )


class Block:
    """Words of texts ``first`` to ``last - 1`` of a column: text ``i`` has words ``at[i]`` to ``at[i + 1] - 1``."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, first: int):
        self.first, self.last = first, first + len(bounds) - 1
        bounds = bounds - bounds[0]
        n = len(raw)
        inside = ~_IS_SPACE[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        after = np.concatenate([inside[1:], [False]]) if n else inside
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        _grow(n + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_OF_BYTE[raw] * _powers[:n])])
        value = (sums[self.ends] - sums[self.starts]) * _inverse_powers[self.starts]
        self.words = mix64(value + (self.ends - self.starts).astype(np.uint64))
        self.at = np.searchsorted(self.starts, bounds)


def blocks(texts: pa.Array) -> Iterator[Block]:
    """Blocks of a text column; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1)
        yield Block(data[offsets[first] : offsets[last]], offsets[first : last + 1], first)
        first = last


def shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, one text after the other, and where each begins.

    A shingle is ``size`` words in a row; a text with fewer words is one shingle.
    """
    words, at = block.words, block.at
    n = np.diff(at)
    weights = mix64(np.arange(1, size + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    combined = np.zeros(max(len(words) - size + 1, 0), dtype=np.uint64)
    for i in range(size):
        combined += words[i : i + len(combined)] * weights[i]
    combined = mix64(combined)
    each = []
    for a, m in zip(at[:-1].tolist(), n.tolist(), strict=True):
        if m >= size:
            each.append(np.unique(combined[a : a + m - size + 1]))
        elif m:
            whole = np.uint64(m) + (words[a : a + m] * weights[:m]).sum(dtype=np.uint64)
            each.append(mix64(np.array([whole], dtype=np.uint64)))
        else:
            each.append(combined[:0])
    begins = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    return (np.concatenate(each) if each else combined[:0]), begins
