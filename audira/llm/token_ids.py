"""Token ids of whole texts by a public tokenizer file, word by word.

A BPE tokenizer that splits words first gives each word the same ids wherever it stands. So a group of texts is split into
words with numpy, each word that was not seen before goes through the tokenizers library once, and the ids of the texts are
gathered. Texts for which that could differ from the library (characters beyond Latin, combining marks, control characters,
special strings) go through the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from audira.llm.shared import GROUP_BYTES, text_groups
from audira.llm.words import hash_spans

SPACE, LETTER, NUMBER, OTHER, UNSAFE = range(5)
SLOT_BITS = 19
#: Characters up to here may be split with numpy.
N_SAFE = 0x180


@cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of the characters below N_SAFE; controls and those without a one-character lower case are unsafe."""
    kinds, lower = np.full(N_SAFE + 1, UNSAFE, np.uint8), np.arange(N_SAFE + 1, dtype=np.uint16)
    for i in range(N_SAFE):
        c, category = chr(i), unicodedata.category(chr(i))
        low = c.lower()
        if c in " \t\n\r":
            kinds[i] = SPACE
        elif category[0] != "C" and not c.isspace() and len(low) == 1 and ord(low) < N_SAFE:
            kinds[i] = {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)
            lower[i] = ord(low)
    return kinds, lower


class WordBpe:
    """Ids by a tokenizers file that lowers case, splits into letters, single digits and other runs, and marks word ends."""

    def __init__(self, path: str, max_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.max_words = max_words
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        # Words met last, by the top bits of their hashes: most words are found here.
        self.slot_hash, self.slot_place = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int64)
        self.flat, self.starts, self.n_flat = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of one group and their n + 1 bounds."""
        text = data.tobytes().decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        at = chars[bounds]
        kinds_of, lower = classes()
        small = np.minimum(codes, N_SAFE)
        kinds, low = kinds_of[small], lower[small]
        unsafe = kinds == UNSAFE
        unsafe[:-1] |= (low[:-1] == ord("<")) & (low[1:] == ord("|"))  # a special string may begin
        n_unsafe = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(unsafe, out=n_unsafe[1:])
        odd = np.flatnonzero(np.diff(n_unsafe[at]))
        if len(at) and at[-1] != len(codes):  # not UTF-8
            odd = np.arange(len(bounds) - 1)
        for r in odd:
            kinds[at[r] : at[r + 1]] = SPACE  # no words here
        first, last = word_spans(kinds, low, at)
        ids, counts = self._ids_of_words(low, first, last)
        token_at = np.zeros(len(first) + 1, np.int64)
        np.cumsum(counts, out=token_at[1:])
        cuts = token_at[np.searchsorted(first, at)]
        if not len(odd):
            return ids, cuts
        parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        whole = [data[bounds[r] : bounds[r + 1]].tobytes().decode("utf-8", "replace") for r in odd]
        for r, e in zip(odd, self.library.encode_batch(whole, add_special_tokens=False), strict=True):
            parts[r] = np.array(e.ids, np.uint32)
        out = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=out[1:])
        return np.concatenate(parts), out

    def _ids_of_words(self, low: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = hash_spans(low, first, last)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        place = np.where(self.slot_hash[slot] == hashes, self.slot_place[slot], -1)
        missed = np.flatnonzero(place < 0)
        if len(missed):
            distinct, example, which = np.unique(hashes[missed], return_index=True, return_inverse=True)
            if self.index and len(self.index) + len(distinct) > self.max_words:
                self.clear()
                return self._ids_of_words(low, first, last)
            found = np.array([self.index.get(h, -1) for h in distinct.tolist()], np.int64)
            new = np.flatnonzero(found < 0)
            if len(new):
                at = missed[example[new]]
                found[new] = self._learn(distinct[new], low, first[at], last[at])
            place[missed] = found[which]
            self.slot_hash[slot[missed]], self.slot_place[slot[missed]] = hashes[missed], place[missed]
        counts = self.starts[place + 1] - self.starts[place]
        return self.flat[ramps(self.starts[place], counts)], counts

    def _learn(self, hashes: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Put words through the library, many in one text with spaces between them."""
        sizes = last - first
        joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint32)
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        joined[ramps(begin, sizes)] = low[ramps(first, sizes)]
        ids = []
        for k in range(0, len(first), 4096):
            stop = min(k + 4096, len(first))
            text = joined[begin[k] : (begin[stop] if stop < len(first) else len(joined))].tobytes().decode("utf-32-le")
            got = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
            if self.ends[got].sum() != stop - k:
                raise ValueError("this tokenizer does not keep words apart")
            ids.append(got)
        got = np.concatenate(ids)
        n, m = len(self.index), len(got)
        if self.n_flat + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(m, len(self.flat)), np.uint32)])
        if n + len(hashes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(hashes) + 1, len(self.starts)), np.int64)])
        self.flat[self.n_flat : self.n_flat + m] = got
        self.starts[n + 1 : n + 1 + len(hashes)] = self.n_flat + np.flatnonzero(self.ends[got]) + 1
        self.n_flat += m
        self.index.update(zip(hashes.tolist(), range(n, n + len(hashes)), strict=True))
        return np.arange(n, n + len(hashes))


def ramps(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] numbers), first[1], ..."""
    total = np.cumsum(counts)
    if not len(total):
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(first - (total - counts), counts)


def word_spans(kinds: np.ndarray, low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the words: letters, one digit, other characters, or one of 's 't 'm 'd 're 've 'll."""
    n = len(kinds)
    new = np.zeros(n + 1, bool)
    new[at] = True
    new = new[:-1]
    new[1:] |= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
    quote = np.flatnonzero(new & (low == 39))
    if len(quote):
        # A quote that is a whole run, with letters of the same text behind it, may be a contraction.
        padded = np.concatenate([low, np.zeros(3, low.dtype)])
        starts = np.concatenate([new, np.ones(3, bool)])
        text_end = np.zeros(n + 4, bool)
        text_end[at] = True
        a, b = padded[quote + 1], padded[quote + 2]
        open_ = starts[quote + 1] & ~text_end[quote + 1]
        one = open_ & np.isin(a, [ord(c) for c in "stmd"])
        pair = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        two = open_ & pair & ~text_end[quote + 2]
        new[quote[one | two] + 1] = False
        for which, size in ((one, 2), (two, 3)):
            cut = quote[which] + size
            cut = cut[cut < n]
            new[cut] = True
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], n)
    keep = kinds[begins] != SPACE
    return begins[keep], ends[keep]


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(column: pa.Array, path: str, size: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, ids, bounds) of each group of texts."""
    for first, last, data, bounds in text_groups(column, size):
        yield first, last, *word_bpe(path).encode(data, bounds)
