"""Canonical length-limited Huffman codes: code lengths, bit packing, table-driven decoding from many places at once."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


#: Codes that the decoder can look up: it sees at least so many bits from any bit offset on.
MAX_BITS = 25


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Length of the code of each symbol (counts above 0), at most ``limit``, by package-merge.

    Level by level, the sorted symbols are merged with the pairs of the level below. Of the last level 2n - 2 items are
    chosen; each level's chosen symbols are its cheapest ones and get one bit more.
    """
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    is_leaf, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        by_weight = np.argsort(items, kind="stable")
        is_leaf.append(by_weight < n)
        items = items[by_weight]
        pairs = len(items) // 2 * 2
        packages = items[:pairs:2] + items[1:pairs:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass(frozen=True)
class Codebook:
    """Canonical codes follow from the lengths alone: shorter codes first, then smaller ids."""

    ids: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def from_counts(ids: np.ndarray, counts: np.ndarray, limit: int = 16) -> Codebook:
        """The limit is raised where so many ids do not fit."""
        limit = max(limit, math.ceil(math.log2(max(len(ids), 2))) + 1)
        if limit > MAX_BITS:
            raise ValueError(f"codes of {limit} bits are too long for the decoder")
        order = np.argsort(ids)
        return Codebook(ids[order].astype(np.int64), code_lengths(counts[order], limit))

    @property
    def width(self) -> int:
        return int(self.lengths.max()) if len(self.lengths) else 1

    def canonical(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbols in code order and their codes, aligned to ``width`` bits."""
        order = np.lexsort((self.ids, self.lengths))
        step = np.left_shift(np.int64(1), self.width - self.lengths[order])
        return order, np.cumsum(step) - step

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length by id."""
        order, aligned = self.canonical()
        codes = np.zeros(int(self.ids.max(initial=0)) + 1, np.uint64)
        sizes = np.zeros(len(codes), np.int64)
        codes[self.ids[order]] = aligned >> (self.width - self.lengths[order])
        sizes[self.ids] = self.lengths
        return codes, sizes

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length by the next ``width`` bits."""
        order, aligned = self.canonical()
        size = 1 << self.width
        reach = np.diff(np.append(aligned, size if len(order) > 1 else aligned[-1:] + size)) if len(order) else np.zeros(0, np.int64)
        return np.repeat(self.ids[order], reach).astype(np.uint32), np.repeat(self.lengths[order], reach).astype(np.int64)


def pack(ids: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids' codes, most significant bit first, and the bit offset of each id."""
    size = sizes[ids]
    ends = np.cumsum(size)
    begins = ends - size
    if not len(ids):
        return np.zeros(0, np.uint8), begins
    word, shift = begins >> 6, 64 - (begins & 63) - size
    code = codes[ids]
    over = np.flatnonzero(shift < 0)  # codes that run into the next 64 bits
    high = np.left_shift(code, np.maximum(shift, 0).astype(np.uint64))
    high[over] = code[over] >> (-shift[over]).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    out[word[first]] = np.add.reduceat(high, first)  # bits don't overlap: a sum is an or
    out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").view(np.uint8)[: int(ends[-1] + 7 >> 3)], begins


def unpack(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray, width: int) -> list[np.ndarray]:
    """Read ``counts[i]`` ids from bit ``offsets[i]`` on, for all i at once: each step reads one id in every place."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    order = np.argsort(-counts, kind="stable")
    at, left = offsets[order].astype(np.int64), counts[order]
    out = np.zeros((int(left.max(initial=0)), len(at)), np.uint32)
    drop, mask = 32 - width, np.int64((1 << width) - 1)
    n = len(at)
    for step in range(len(out)):
        while left[n - 1] <= step:
            n -= 1
        pos = at[:n]
        code = (window[pos >> 3].astype(np.int64) >> (drop - (pos & 7))) & mask
        out[step, :n] = ids[code]
        pos += sizes[code]
    result: list[np.ndarray] = [out[:0, 0]] * len(order) if len(order) else []
    for lane, i in enumerate(order):
        result[i] = out[: left[lane], lane]
    return result
