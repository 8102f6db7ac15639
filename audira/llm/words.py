"""Words of many texts at once, as numpy arrays: spans, 64-bit hashes, rows.

Hashes are sums of a random 64-bit number per byte times a power that depends on the place in the word. Equal spans have
equal hashes; two different ones meet by chance once in about 2^64 pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

#: Spans are hashed in segments of about so many bytes.
SEGMENT = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = b" \t\n\x0b\x0c\r"


def lookup(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


IS_WORD = ~lookup(SPACE)
#: Every byte to itself, A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@cache
def byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**64, 512, dtype=np.uint64)


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for the places of a segment and some more."""
    n, inverse = 2 * SEGMENT, np.uint64(pow(int(BASE), -1, 2**64))
    out = []
    for base in (BASE, inverse):
        p = np.empty(n, np.uint64)
        p[0] = 1
        done = 1
        while done < n:  # doubling: p[done:2 done] = p[:done] * base^done
            step = np.uint64(pow(int(base), done, 2**64))
            p[done : 2 * done] = p[: min(done, n - done)] * step
            done *= 2
        out.append(p)
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a one-to-one map)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of every span [first, last) of bytes or of codes below 512; spans are in order and don't overlap."""
    out = np.zeros(len(first), np.uint64)
    up, down = powers()
    i = 0
    while i < len(first):
        lo = int(first[i])
        j = max(i + 1, int(np.searchsorted(last, lo + SEGMENT, "right")))
        if last[j - 1] - lo <= len(up):
            part = data[lo : int(last[j - 1])]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(byte_values()[part] * up[: len(part)], out=sums[1:])
            s, e = first[i:j] - lo, last[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * down[s]
        else:  # one span longer than the table of powers
            total, shift = np.uint64(0), 1
            for at in range(lo, int(last[i]), SEGMENT):
                part = data[at : min(at + SEGMENT, int(last[i]))]
                total += (byte_values()[part] * up[: len(part)]).sum(dtype=np.uint64) * np.uint64(shift)
                shift = shift * pow(int(BASE), SEGMENT, 2**64) % 2**64
            out[i] = total
        i = j
    return mix(out + (last - first).astype(np.uint64))


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each run of true values; runs end at the bounds of rows."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    begins = inside & cut[:-1]
    begins[1:] |= inside[1:] & ~inside[:-1]
    ends = inside & cut[1:]
    ends[:-1] |= inside[:-1] & ~inside[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


@dataclass
class Words:
    first: np.ndarray  # place of the first byte
    last: np.ndarray  # after the last byte
    row: np.ndarray  # row of the batch
    hash: np.ndarray
    bounds: np.ndarray  # n + 1 bounds of the rows in the words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words_of(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray = IS_WORD, hashed: bool = True) -> Words:
    """Words of the texts whose bytes are ``data``: runs of bytes that ``is_word`` accepts."""
    first, last = spans(is_word[data], bounds)
    at = np.searchsorted(first, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    return Words(first, last, row, hash_spans(data, first, last) if hashed else np.zeros(0, np.uint64), at)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of every window of n words inside a row."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words.hash[k : k + m]
    at = np.flatnonzero(words.row[:m] == words.row[n - 1 :])
    return at, mix(total[at])
