"""Benchmark decontamination: passages within a small edit distance of a benchmark item, by CGK embedding and bit sampling.

Texts and items are words: runs of letters and digits in lower case (every character beyond ASCII counts as a letter). A
document holds an item if a passage of it is within ``floor(max_edits * words of the item)`` word edits of the item.

1. Windows. Each item falls in a size class, a grid of lengths with a ratio of about 1.12; its first words, as many as the
   class has, are its key passage. Every place of every text opens a window of each class that occurs. An edit changes at
   most two word pairs, so a window with more than ``2 * edits`` pairs that no key passage of its class has is left out
   before anything else, pairs that it repeats and no key passage does counted in. Pairs are looked up in a
   bit map of fixed size, whatever the size of the benchmark. All other windows are looked at, also those beside a better
   one: that one may stand for another item.
2. CGK embedding. A window is read by a random walk: at each step the word under the pointer is copied, and the pointer
   moves on if a random bit of (step, word) says so. Few edits become few differing places.
3. Bit-sampling LSH. Each of ``repeats`` walks samples ``samples`` places; windows and key passages that agree in all of
   them meet in a join on (class, key). Keys that no item has, by a second bit map, are left out before the join.
4. Verification. The exact edit distance of the whole item to the best passage around the window decides.

With 64 walks of 3 samples (one for each word of longer windows) at least 99 of 100 passages with the largest number of edits are found, and all exact ones;
``tests/llm`` measures it. Items with fewer than ``min_words`` words only match documents that consist of the same words.

Null and empty texts match nothing, nor do items without words. Repeated rows give one row per (doc_id, item_id); null ids
are values like any other. Empty tables give empty results. Texts are never cut and candidates never capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from audira.llm.shared import map_batches, numbered, pick, position, same, settle, text_groups
from audira.llm.token_ids import ramps
from audira.llm.words import Words, lookup, mix, ngrams, words_of

IS_LETTER = lookup(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
#: Size of the bit map of word pairs.
MAP_BITS = 23
#: Cells of the edit matrix' rows that are worked on at once.
CELLS_AT_ONCE = 1 << 19


@dataclass(frozen=True)
class Leaks:
    max_edits: float = 0.2  # of the words of an item
    min_words: int = 8
    repeats: int = 64
    samples: int = 3

    def edits(self, n_words: int) -> int:
        return int(self.max_edits * n_words) if n_words >= self.min_words else 0

    def walks(self, size: int) -> int:
        """Long windows may hold more edits, so they take more walks."""
        return max(self.repeats, size)

    def size_class(self, n_words: int) -> int:
        """Largest size of the grid that is not above the number of words; short items are classes of their own."""
        size = n_words if n_words < self.min_words else self.min_words
        while n_words >= self.min_words and max(size + 1, size * 9 // 8) <= n_words:
            size = max(size + 1, size * 9 // 8)
        return size


def lower_words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for first, last, data, bounds in text_groups(pc.utf8_lower(column)):
        yield first, last, words_of(data, bounds, IS_LETTER)


def pair_bits(pairs: np.ndarray, size: int) -> np.ndarray:
    """Place of word pairs in the bit map, each class on its own."""
    return (mix(pairs + np.uint64(size * 0xA24BAED4963EE407 % 2**64)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


#: The class that holds the pairs of all classes; classes from REPEATED on hold the pairs that a key passage has twice.
ANY = 0
REPEATED = 1 << 40


@cache
def sampled_steps(size: int, config: Leaks) -> tuple[np.ndarray, np.ndarray]:
    """Walks in the order of the steps they sample, and where each step begins in it; distinct steps by Floyd's rule.

    A walk moves on at every other step, so most have left the window after twice as many steps as it has words; what is
    copied from there on is the same for all windows, and is not sampled.
    """
    steps, repeats = max(1, 7 * size // 4), config.walks(size)
    n = min(config.samples, steps)
    chosen = np.full((repeats, n), -1, np.int64)
    for k, top in enumerate(range(steps - n, steps)):
        pick = (mix(_counter(size, np.arange(repeats), steps + k)) % np.uint64(top + 1)).astype(np.int64)
        chosen[:, k] = np.where((chosen == pick[:, None]).any(axis=1), top, pick)
    order = np.argsort(chosen.ravel(), kind="stable")
    return order // n, np.searchsorted(chosen.ravel()[order], np.arange(steps + 1))


def _counter(size: int, walk: np.ndarray, step: int) -> np.ndarray:
    """A number of its own for each (size, walk, step): random bits follow from it, none are stored."""
    return walk.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((size << 40 | step) * 0xD1B54A32D192ED03 % 2**64)


def embedded(windows: np.ndarray, config: Leaks) -> np.ndarray:
    """(windows, repeats) keys: the sampled places of each CGK walk over windows of one size, all walks at once."""
    n, size = windows.shape
    walk, begins = sampled_steps(size, config)
    steps, repeats = len(begins) - 1, config.walks(size)
    every = np.arange(repeats)
    padded = np.concatenate([windows, np.zeros((n, steps - size + 1), np.uint64)], axis=1).ravel()  # past the end: a symbol of its own
    pointer, key = np.tile(np.arange(n) * (steps + 1), (repeats, 1)), np.zeros((repeats, n), np.uint64)
    for step in range(steps):
        word = padded[pointer]
        here = walk[begins[step] : begins[step + 1]]
        if len(here):
            key[here] = mix(key[here] * np.uint64(0x9FB21C651E98DF25) + word[here])
        seeds = mix(_counter(size, every, step)) | np.uint64(1)  # odd: the top bit of a product depends on every bit of a word
        pointer += (word * seeds[:, None] >> np.uint64(63)).view(np.int64)
    return mix(key + (every + size * repeats).astype(np.uint64)[:, None]).T


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1).astype(np.uint64).view(np.int64)))


ITEMS = "item_id {kind}, n_words int, size int, words array<long>, keys array<long>, bits array<long>"


def items_of(benchmark: DataFrame, item_id: str, text: str, config: Leaks) -> DataFrame:
    """Per item with words: its size class, words, keys and the bits of its key passage's word pairs."""
    rows = pick(benchmark, item_id, text).toDF("item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, words in lower_words(batch.column(1)):
                for r in np.flatnonzero(words.counts):
                    hashes = words.hash[words.bounds[r] : words.bounds[r + 1]]
                    size = config.size_class(len(hashes))
                    part = Words(*[np.zeros(size, np.int64)] * 3, hashes[:size], np.array([0, size]))
                    pairs, times = np.unique(ngrams(part, 2)[1], return_counts=True)
                    bits = np.concatenate([pair_bits(pairs, size), pair_bits(pairs, ANY), pair_bits(pairs[times > 1], size + REPEATED)]).astype(np.uint64)
                    keys = embedded(hashes[None, :size], config)[0]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first + r, 1), pa.array([len(hashes)], pa.int32()), pa.array([size], pa.int32()), *[_lists(x, [len(x)]) for x in (hashes, keys, bits)]],
                        names=["item_id", "n_words", "size", "words", "keys", "bits"],
                    )

    return map_batches(rows, run, ITEMS.format(kind=rows.schema["item_id"].dataType.simpleString()))


def bit_map(items: DataFrame, bits: Column) -> np.ndarray:
    """The bits of all items in one map; at most 2^17 words of 64 bits reach the driver, whatever the benchmark."""
    words = items.select(F.explode(bits).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in words.collect():
        out[r.word] = r.bits
    return out.view(np.uint64)


def key_bits(keys: np.ndarray) -> np.ndarray:
    """Place of keys in their bit map; a key holds its class and walk."""
    return (keys >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def is_set(bit_map: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return bit_map[bits >> 6] >> (bits & 63).astype(np.uint64) & np.uint64(1) > 0


def hopeful(foreign: np.ndarray, words: Words, size: int, edits: int) -> np.ndarray:
    """Begins of windows with few pairs that no class has; near the end of a text also those with up to ``edits`` words less,
    as a passage with words left out may be shorter than its class, each missing word counted as in ``strangers``."""
    n, span = len(words.hash), size - 1
    full = np.flatnonzero(foreign[span:n] - foreign[: max(n - span, 0)] <= 2 * edits) if n > span else np.zeros(0, np.int64)
    full = full[full + size <= words.bounds[words.row[full] + 1]]
    length = np.arange(max(size - edits, 1), size)[None, :]
    begin = words.bounds[1:, None] - length
    row, at = np.nonzero(begin >= words.bounds[:-1, None])
    begin, missing = begin[row, at], size - length[0, at]
    few = foreign[words.bounds[row + 1] - 1] - foreign[begin] + missing <= 2 * edits
    return np.union1d(full, begin[few])


def strangers(grams: np.ndarray, begin: np.ndarray, stop: np.ndarray, size: int, bit_map: np.ndarray) -> np.ndarray:
    """In each window, word pairs that no key passage of its class has, one for each word that is missing at the end (a word
    left out makes one strange pair where it stood), and pairs that stood in it before and that no key passage has twice."""
    out = size - (stop - begin)
    for k in range(0, len(begin) if size > 1 else 0, 4096):
        b, e = begin[k : k + 4096, None], stop[k : k + 4096, None]
        at = b + np.arange(size - 1)
        window = np.sort(np.where(at < e - 1, grams[np.minimum(at, len(grams) - 1)], np.uint64(0)), axis=1)
        real = window != 0
        known = is_set(bit_map, pair_bits(window, size))
        again = np.zeros_like(real)
        again[:, 1:] = (window[:, 1:] == window[:, :-1]) & known[:, 1:] & ~is_set(bit_map, pair_bits(window[:, 1:], size + REPEATED))
        out[k : k + 4096] += ((~known | again) & real).sum(axis=1)
    return out


def candidate_windows(docs: DataFrame, classes: dict[int, int], pairs: np.ndarray, item_keys: np.ndarray, config: Leaks) -> DataFrame:
    """Windows that may match an item of their class: (window, doc_id, place, size, keys that an item may have, region)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"window long, doc_id {kind}, place int, size int, keys array<long>, region array<long>"
    known, wanted = (docs.sparkSession.sparkContext.broadcast(x) for x in (pairs, item_keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, _, words in lower_words(batch.column(1)):
                n = len(words.hash)
                grams = np.zeros(n, np.uint64)
                at, hashes = ngrams(words, 2)
                grams[at] = hashes
                place = np.arange(n) - words.bounds[words.row] if n else np.zeros(0, np.int64)
                foreign = np.zeros(n + 1, np.int64)
                np.cumsum(~is_set(known.value, pair_bits(grams, ANY)), out=foreign[1:])
                for size, edits in classes.items():
                    begin = hopeful(foreign, words, size, edits) if size >= config.min_words else words.bounds[:-1][words.counts == size]
                    stop = np.minimum(begin + size, words.bounds[words.row[begin] + 1])
                    strange = strangers(grams, begin, stop, size, known.value)
                    begin, stop = (x[strange <= 2 * edits] for x in (begin, stop))
                    for k in range(0, len(begin), 1024):
                        b, e = begin[k : k + 1024], stop[k : k + 1024]
                        inside = np.arange(size)[None, :] < (e - b)[:, None]
                        window = np.where(inside, words.hash[np.minimum(b[:, None] + np.arange(size), n - 1)], np.uint64(0))
                        keys = embedded(window, config)
                        met = is_set(wanted.value, key_bits(keys))
                        some = met.any(axis=1)
                        if not some.any():
                            continue
                        b, keys, met = b[some], keys[some], met[some]
                        row = words.row[b]
                        reach = size * 9 // 8 + 2 + 2 * edits
                        lo = np.maximum(words.bounds[row], b - 2 * edits)
                        hi = np.minimum(words.bounds[row + 1], b + reach + edits)
                        m = len(b)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(number + np.arange(m)),
                                batch.column(0).take(pa.array(first + row)),
                                pa.array(place[b].astype(np.int32)),
                                pa.array(np.full(m, size, np.int32)),
                                _lists(keys[met], met.sum(axis=1)),
                                _lists(words.hash[ramps(lo, hi - lo)], hi - lo),
                            ],
                            names=["window", "doc_id", "place", "size", "keys", "region"],
                        )
                        number += m

    return map_batches(docs, run, schema)


def passage_edits(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """Edit distance of each item to the best passage of its region, many at once."""
    n, deep, wide = len(items), max(map(len, items)), max(map(len, regions))
    text = np.zeros((n, wide), np.uint64)
    length = np.array([len(r) for r in regions])
    for i, r in enumerate(regions):
        text[i, : len(r)] = r
    slope, rows = np.arange(wide + 1), np.arange(n)
    inside = slope[None, :] <= length[:, None]
    before, out = np.zeros((n, wide + 1), np.int64), np.zeros(n, np.int64)
    sizes = np.array([len(x) for x in items])
    for i in range(deep):
        word = np.array([x[i] if i < len(x) else 0 for x in items], np.uint64)
        now = before + 1  # a word of the item left out
        now[:, 1:] = np.minimum(now[:, 1:], before[:, :-1] + (text != word[:, None]))
        now = np.minimum.accumulate(now - slope, axis=1) + slope  # words of the text left out
        before = np.where((i < sizes)[:, None], now, before)
    out[rows] = np.where(inside, before, 1 << 40).min(axis=1)
    return out


def alike(width: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Indexes of pairs of about the same width, so many together that widest times number is at most ``cells`` (or one)."""
    order = np.argsort(-width, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, cells // max(1, int(width[order[at]])))
        yield order[at : at + n]
        at += n


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", config: Leaks = Leaks()
) -> DataFrame:
    """Per (doc_id, item_id) with a match: n_words of the item, edits of the best passage, place (word) of the first such window."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    items = settle(items_of(benchmark, item_id, item_text, config))
    # The classes form a grid: a handful for each power of two of the longest item.
    found = items.groupBy("size").agg(F.max("n_words").alias("n_words")).collect()
    classes = {r["size"]: config.edits(r.n_words) for r in sorted(found)}
    item_bits = F.transform("keys", lambda k: F.shiftrightunsigned(k, 64 - MAP_BITS))
    windows = settle(candidate_windows(rows, classes, bit_map(items, F.col("bits")), bit_map(items, item_bits), config))
    keyed = windows.select("window", "size", F.explode("keys").alias("key"))
    item_keys = settle(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "n_words", "words", "size", "keys"))
    met = keyed.join(item_keys.select("item", "size", F.explode("keys").alias("key")), ["size", "key"])
    pairs = met.select("window", "item").distinct()
    full = pairs.join(windows.select("window", "doc_id", "place", "region"), "window").join(item_keys.select("item", "item_id", "n_words", "words"), "item")
    kinds = [full.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")]
    names = ["doc_id", "item_id", "n_words", "place", "edits"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.array(x, np.int64).view(np.uint64) for x in batch.column(c).to_pylist()] for c in ("words", "region"))
            edits = np.zeros(len(a), np.int64)
            for some in alike(np.array([len(x) for x in b]), CELLS_AT_ONCE):
                edits[some] = passage_edits([a[i] for i in some], [b[i] for i in some])
            allowed = np.array([config.edits(len(x)) for x in a])
            same_size = np.array([len(x) >= config.min_words or len(x) == len(y) for x, y in zip(a, b, strict=True)])
            keep = pa.array((edits <= allowed) & same_size)
            columns = [batch.column(c) for c in names[:-1]] + [pa.array(edits.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=names)

    matches = map_batches(full, verify, f"doc_id {kinds[0]}, item_id {kinds[1]}, n_words int, place int, edits int")
    best = matches.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.min(F.struct("edits", "place")).alias("best"))
    return best.select("doc_id", "item_id", "n_words", F.col("best.edits").alias("edits"), F.col("best.place").alias("place"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", config: Leaks = Leaks()) -> DataFrame:
    """The documents without a match, all columns as they were."""
    found = settle(leaks(docs, benchmark, doc_id, text, config=config).select(F.col("doc_id").alias("leaked")).distinct())
    rows = numbered(docs)
    return rows.join(found, same(F.col(f"c{position(docs, doc_id)}"), F.col("leaked")), "left_anti").toDF(*docs.columns)
