"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point.

Words come from maximal runs of letters with A-Z in lower case. Where the checksum of "<doc_id>:<run>" is a multiple of
``typo_every``, one code point of the run is left out (typos with a fixed place, to test against). Spark adds the
occurrences; words of ``min_chars`` code points and ``min_count`` occurrences form the vocabulary.

Near words come from a scan of the sorted vocabulary. The edit matrix between a word and the list is kept as a band of
three cells a row. Adjacent words of the list share the rows of their common prefix (LCP), so a row is computed once for
the whole range of words with that prefix, and a range is skipped as soon as all cells of its row exceed one edit. All words
that ask are scanned together, one row at a time.

Where the list is split: two words with one edit between them, the shorter one of m code points, share their first or their
last m // 2 code points. Words are sorted under both, and a group that shares them is scanned by itself, on what is left of
its words. A group of more than ``max_group`` words is split again by the same rule, applied to the rest, until it is small
enough or no more than two code points are left (then it has at most as many words as there are pairs of letters). So no
group grows with the corpus, and no pair is lost.

Null and empty texts have no words. A null id counts as "". Repeated rows count like others. Empty tables give an empty
result. A form is the near word with the largest count, ties to the smallest in code-point order. Texts are read whole;
bytes that are no UTF-8 end a word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from audira.llm.shared import map_batches, pick, settle, text_groups
from audira.llm.token_ids import ramps
from audira.llm.words import LOWER, hash_spans, lookup, spans

LETTERS = lookup(bytes(range(65, 91)) + bytes(range(97, 123)))
#: First byte of U+00C0 to U+00FF; the second may be any continuation byte.
LATIN = 0xC3
#: Words that ask at once.
ASKING = 1 << 14
TEXT_BYTES = 1 << 19


@dataclass(frozen=True)
class VariantPlan:
    min_chars: int = 5
    min_count: int = 3
    typo_every: int = 97
    max_group: int = 4096


@cache
def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def checksums(data: np.ndarray, first: np.ndarray, last: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of every span, carried on from the checksum that it begins with; a step for each place in a word."""
    order = np.argsort(first - last, kind="stable")  # longest first
    at, size = first[order], (last - first)[order]
    state, table = ~begun[order], crc_table()
    n = len(order)
    for k in range(min(int(size.max(initial=0)), 64)):
        n = int(np.searchsorted(-size, -k, "left"))  # spans longer than k
        state[:n] = table[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    state = ~state
    for i in range(int(np.searchsorted(-size, -64, "left"))):
        state[i] = zlib.crc32(data[at[i] + 64 : at[i] + size[i]].tobytes(), int(state[i]))
    out = np.empty(len(order), np.uint32)
    out[order] = state
    return out


def word_counts(data: np.ndarray, bounds: np.ndarray, ids: list, plan: VariantPlan) -> tuple[list[str], list[int]]:
    """Words of the texts of one group, each with its number, words may repeat."""
    tail = np.append(data[1:], np.uint8(0)) & 0xC0 == 0x80
    tail[bounds[1:][bounds[1:] > 0] - 1] = False  # a pair does not span two texts
    lead = (data == LATIN) & tail
    inside = LETTERS[data] | lead
    inside[1:] |= lead[:-1]
    low = LOWER[data]
    first, last = spans(inside, bounds)
    wide = np.concatenate([[0], np.cumsum(lead)])
    size = last - first - (wide[last] - wide[first])
    row = np.searchsorted(bounds, first, "right") - 1
    begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = checksums(low, first, last, begun[row])
    hit = crc % np.uint32(plan.typo_every) == 0
    typos: Counter[str] = Counter()
    for a, b, h, n in zip(first[hit].tolist(), last[hit].tolist(), crc[hit].tolist(), size[hit].tolist(), strict=True):
        if n > plan.min_chars:
            word, cut = low[a:b].tobytes().decode(), h % n
            typos[word[:cut] + word[cut + 1 :]] += 1
    long = ~hit & (size >= plan.min_chars)
    first, last = first[long], last[long]
    _, example, count = np.unique(hash_spans(low, first, last), return_index=True, return_counts=True)
    words = [low[a:b].tobytes().decode() for a, b in zip(first[example].tolist(), last[example].tolist(), strict=True)]
    return words + list(typos), count.tolist() + list(typos.values())


def vocabulary(docs: DataFrame, plan: VariantPlan = VariantPlan()) -> DataFrame:
    """(word, n) of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in text_groups(batch.column(1), TEXT_BYTES):
                words, counts = word_counts(data, bounds, batch.column(0).slice(first, last - first).to_pylist(), plan)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    counted = map_batches(docs.select("doc_id", "text"), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= plan.min_count)


def _with_keys(words: DataFrame, head: Column, rest: Column, tail: Column) -> DataFrame:
    """The words once for each way to share half of ``rest``; head and tail are shared already.

    A rest of m code points may be the shorter or the longer one of a pair, so halves of m and of m - 1 both count. A half of
    nothing leaves the word in its group, which is ``final``.
    """
    size = F.length(rest)

    def ways(half: Column) -> list[Column]:
        front = F.struct(
            F.concat(head, F.substring(rest, F.lit(1), half)).alias("head"), F.substring(rest, half + 1, size).alias("rest"), tail.alias("tail"), (half == 0).alias("final")
        )
        back = F.struct(
            head.alias("head"), F.substring(rest, F.lit(1), size - half).alias("rest"), F.concat(F.substring(rest, size - half + 1, half), tail).alias("tail"), (half == 0).alias("final")
        )
        return [front, back]

    halves = [F.floor(size / 2).cast("int"), F.floor(F.greatest(size - 1, F.lit(0)) / 2).cast("int")]
    every = F.array_distinct(F.array(*[w for h in halves for w in ways(h)]))
    return words.select("word", "n", F.explode(every).alias("k")).select("word", "n", "k.*")


GROUP = ["head", "tail"]


def grouped(words: DataFrame, plan: VariantPlan) -> DataFrame:
    """(word, n, head, tail, rest): groups that share head and tail, none of more than max_group words but final ones."""
    columns = ["word", "n", *GROUP, "rest"]
    todo, ready = settle(_with_keys(words, F.lit(""), F.col("word"), F.lit(""))), None
    while True:
        large = todo.where("not final").groupBy(*GROUP).count().where(F.col("count") > plan.max_group).drop("count")
        more = not large.isEmpty()
        if more:
            large = settle(large)
            split = todo.where("not final").join(large, GROUP, "left_semi")
            todo, done = split, todo.where("final").select(columns).union(todo.where("not final").join(large, GROUP, "left_anti").select(columns))
        else:
            done = todo.select(columns)
        ready = done if ready is None else ready.union(done)
        if not more:
            return ready
        again = todo.withColumnsRenamed({"head": "h", "rest": "r", "tail": "t"})
        todo = settle(_with_keys(again, F.col("h"), F.col("r"), F.col("t")).distinct())


def common_prefixes(codes: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common code points of each word and the one before it; -1 at the first word of a group."""
    lcp = np.full(len(start), -1, np.int64)
    alive = np.flatnonzero(group[1:] == group[:-1]) + 1
    depth = 0
    while len(alive):
        lcp[alive] = depth
        alive = alive[(size[alive] > depth) & (size[alive - 1] > depth)]
        alive = alive[codes[start[alive] + depth] == codes[start[alive - 1] + depth]]
        depth += 1
    return lcp


def near_in_groups(codes: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asking word, near word): all pairs with one edit between them within groups of sorted, distinct words.

    ``codes`` holds the words' code points one after another. A node is a range of words with a common prefix of ``depth``
    code points; the band of a node and an asking word q are the cells depth - 1, depth and depth + 1 of the row.
    """
    lcp = common_prefixes(codes, start, size, group)
    by_lcp = np.argsort(lcp, kind="stable")
    level = np.searchsorted(lcp[by_lcp], np.arange(int(lcp.max(initial=0)) + 2))
    opens = np.flatnonzero(lcp < 0)
    closes = np.append(opens[1:], len(start))
    which = np.cumsum(lcp < 0) - 1
    asked, found = [], []
    everyone = np.flatnonzero((closes - opens)[which] > 1) if len(start) else np.zeros(0, np.int64)
    for at in range(0, len(everyone), ASKING):
        q = everyone[at : at + ASKING]
        s, e = opens[which[q]], closes[which[q]]
        band = [np.full(len(q), 2, np.int8), np.zeros(len(q), np.int8), np.where(size[q] > 0, 1, 2).astype(np.int8)]
        depth = 0
        while len(q):
            ends = size[s] == depth  # the first word of the range is the prefix itself
            rest = size[q] - depth
            cell = np.select([rest == -1, rest == 0, rest == 1], band, 2)
            hit = ends & (cell == 1) & (q != s)
            asked.append(q[hit])
            found.append(s[hit])
            s = s + ends
            on = (s < e) & ~((e - s == 1) & (s == q))
            q, s, e, band = q[on], s[on], e[on], [b[on] for b in band]
            if not len(q):
                break
            # Children: the range is cut where adjacent words share no more than depth code points.
            cuts = by_lcp[level[depth] : level[depth + 1]] if depth + 1 < len(level) else by_lcp[:0]
            lo, hi = np.searchsorted(cuts, s, "right"), np.searchsorted(cuts, e, "left")
            n = hi - lo + 1
            pair = np.repeat(np.arange(len(q)), n)
            place = ramps(np.zeros(len(q), np.int64), n)
            inner = lo[pair] + place
            edge = np.append(cuts, len(start))
            child_s = np.where(place == 0, s[pair], edge[np.maximum(inner - 1, 0)])
            child_e = np.where(place == n[pair] - 1, e[pair], edge[np.minimum(inner, len(edge) - 1)])
            q, s, e, band = q[pair], child_s, child_e, [b[pair] for b in band]
            c = codes[start[s] + depth]
            new: list[np.ndarray] = []
            for x in (-1, 0, 1):  # cell depth + 1 + x of the next row
                column = depth + x  # the code point of q that this cell compares
                exists = (column >= 0) & (column < size[q])
                other = codes[np.where(exists, start[q] + column, 0)] != c
                value = band[x + 1] + other
                if x < 1:
                    value = np.minimum(value, band[x + 2] + 1)
                if new:
                    value = np.minimum(value, new[-1] + 1)
                first_column = (column + 1 == 0) & (depth + 1 < 2)
                new.append(np.where(exists, np.minimum(value, 2), np.where(first_column, depth + 1, 2)).astype(np.int8))
            on = np.minimum(np.minimum(new[0], new[1]), new[2]) < 2
            q, s, e, band = q[on], s[on], e[on], [b[on] for b in new]
            depth += 1
    if not asked:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(asked), np.concatenate(found)


def near_pairs(words: DataFrame, plan: VariantPlan = VariantPlan()) -> DataFrame:
    """(word, near, near_n) of rows (word, n): every two words with one edit between them, both ways round."""
    schema = "word string, near string, near_n long"

    def scan(rows: pa.Table) -> pa.RecordBatch:
        keys = list(zip(*(rows.column(c).to_pylist() for c in (*GROUP, "rest")), strict=True))
        new = [True, *(a != b for a, b in zip(keys[1:], keys[:-1], strict=True))]
        rows = rows.filter(pa.array(new))  # a word may come into its group in two ways
        keys = [k for k, first in zip(keys, new, strict=True) if first]
        group = np.cumsum([0, *(a[:2] != b[:2] for a, b in zip(keys[1:], keys[:-1], strict=True))])
        rest = [k[2] for k in keys]
        size = np.array([len(r) for r in rest], np.int64)
        codes = np.frombuffer("".join(rest).encode("utf-32-le") + bytes(4), np.uint32)
        asked, found = near_in_groups(codes, np.cumsum(size) - size, size, group)
        word = rows.column("word")
        return pa.RecordBatch.from_arrays([word.take(pa.array(asked)).combine_chunks(), word.take(pa.array(found)).combine_chunks(), rows.column("n").take(pa.array(found)).combine_chunks()], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = (batch.column(2)[-1].as_py(), batch.column(3)[-1].as_py())
            cut = batch.num_rows  # rows before the last group, which may go on in the next batch
            while cut and (batch.column(2)[cut - 1].as_py(), batch.column(3)[cut - 1].as_py()) == last:
                cut -= 1
            if cut or held and (held[0].column(2)[-1].as_py(), held[0].column(3)[-1].as_py()) != last:
                yield scan(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield scan(pa.Table.from_batches(held))

    dealt = grouped(words, plan).select("word", "n", "head", "tail", "rest").repartition("head", "tail")
    pairs = map_batches(dealt.sortWithinPartitions("head", "tail", "rest", "word"), run, schema)
    return pairs.repartition("word").distinct()  # a pair may share both its first and its last half


def with_roots(forms: DataFrame) -> DataFrame:
    """Add root to (word, form, ...): the last word when forms are followed. Steps double each round."""
    links = settle(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("at"), F.col("root").alias("further"))
        jumped = settle(links.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        links = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    found = links.select(F.col("word").alias("at"), "root")
    return forms.join(found, F.col("word") == F.col("at"), "left").withColumn("root", F.coalesce("root", "word")).drop("at")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: VariantPlan = VariantPlan()) -> DataFrame:
    """Per word of the vocabulary: word, n, n_near, form, form_n, root."""
    words = settle(vocabulary(pick(docs, doc_id, text).toDF("doc_id", "text"), plan))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_pairs(words, plan).groupBy(F.col("word").alias("of")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, F.col("word") == F.col("of"), "left")
    is_form = -F.col("best.less") >= 2 * F.col("n")
    forms = settle(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
        )
    )
    return with_roots(forms).select("word", "n", "n_near", "form", "form_n", "root")
