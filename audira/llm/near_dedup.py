"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, links confirmed on full sets.

1. Every text gives its set of 5-word shingles (64-bit hashes) and, from one hash per shingle, a signature: the hash's top
   bits choose one of ``bins`` bins, the smallest hash of a bin is its value. An empty bin takes over the value of another
   bin that a fixed random sequence for that bin finds (optimal densification), so short texts compare like long ones.
2. Documents with equal words are one class, represented by the smallest doc_id. Only representatives go on.
3. ``bands`` bands of the signature make buckets. With 32 bands of 4 bins a pair at similarity 0.75 shares no bucket with a
   chance of 5 in a million, at 0.8 of 5 in 10^8.
4. In each bucket one document is the hub; the candidates are the edges of the star around it. Each edge is checked on the
   full sets and components are merged, so a bucket of n copies costs n - 1 edges, not n^2 / 2.
5. Buckets left with several components hold chance meetings, documents that share a long passage, and copies that lie far
   from the hub. Their documents get new buckets by their rarest shingles: two sets of given sizes with the wanted
   similarity have so many shingles in common that one is among the first few of each in one order of all shingles. Common
   passages come last in that order, and shingles that one document has alone make no bucket. Stars are drawn again, hubs
   are taken out of their buckets, buckets left with one component are dropped, and each round takes 64 times as many
   hubs, until no bucket is left: every pair is checked, inside one component, or has too many shingles of its own.

Null, empty and blank texts have empty sets and link with nothing. A text with fewer than five words is one shingle.
Repeated doc_ids are one document whose texts may each link it; null doc_ids are left alone: they keep component null and
are kept. Empty tables give empty results. Nothing is cut, capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audira.llm.components import components
from audira.llm.shared import map_batches, numbered, pick, position, settle, text_groups
from audira.llm.words import LOWER, Words, mix, ngrams, words_of


@dataclass(frozen=True)
class MinHash:
    words: int = 5
    min_pct: int = 75
    bands: int = 32
    rows: int = 4

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def shingles(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, Words]:
    """(row, shingle hash) of the distinct shingles of each text, sorted by both, and the words."""
    words = words_of(LOWER[data], bounds)
    at, grams = ngrams(words, n)
    rows = words.row[at]
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([_sequence(words.hash[words.bounds[r] : words.bounds[r + 1]]) for r in short], np.uint64)
        rows, grams = np.concatenate([rows, short]), np.concatenate([grams, extra])
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[new], grams[new], words


def _sequence(hashes: np.ndarray) -> np.uint64:
    total = np.zeros(1, np.uint64)
    for h in hashes:
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + h + np.uint64(1))
    return mix(total + np.uint64(len(hashes)))[0]


@cache
def detours(bins: int, tries: int) -> np.ndarray:
    """For each bin the fixed random sequence of bins that it asks while it is empty."""
    return np.random.default_rng(bins).integers(0, bins, (tries, bins))


def signatures(rows: np.ndarray, grams: np.ndarray, n: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature of each text with a shingle: (n, bins) hashes, and which texts have one."""
    empty = np.uint64(2**64 - 1)
    sig = np.full((n, bins), empty, np.uint64)
    bin_of = ((grams >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig.reshape(-1), rows * bins + bin_of, mix(grams))
    has = np.zeros(n, bool)
    has[rows] = True
    filled = sig != empty
    values, open_ = sig.copy(), ~filled & has[:, None]
    tries = 0
    while open_.any():
        tries += 1
        source = detours(bins, max(64, 1 << (tries - 1).bit_length()))[tries - 1]
        take = open_ & filled[:, source]
        values[take] = sig[:, source][take]
        open_ &= ~take
    return values, has


def band_keys(values: np.ndarray, config: MinHash) -> np.ndarray:
    keys = np.empty((len(values), config.bands), np.uint64)
    for b in range(config.bands):
        total = np.full(len(values), b + 1, np.uint64)
        for r in range(config.rows):
            total = mix(total * np.uint64(0x9FB21C651E98DF25) + values[:, b * config.rows + r])
        keys[:, b] = total
    return keys


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_hi", T.LongType()),
        T.StructField("text_lo", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def signed(docs: DataFrame, config: MinHash) -> DataFrame:
    """Per row (doc_id, text): a 128-bit hash of its words, the size of its set, its band keys (null: no shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in text_groups(batch.column(1)):
                rows, grams, words = shingles(data, bounds, config.words)
                n = last - first
                values, has = signatures(rows, grams, n, config.bins)
                keys = band_keys(values, config).reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * config.bands), pa.array(keys))
                lists = pa.compute.if_else(pa.array(has), lists, pa.scalar(None, lists.type))
                hi, lo = _text_keys(words, n)
                ids = batch.column(0).slice(first, n)
                yield pa.RecordBatch.from_arrays([ids, _signed(hi), _signed(lo), pa.array(np.bincount(rows, minlength=n)), lists], names=SIGNED.names)

    return map_batches(docs, run, SIGNED)


def _text_keys(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's word sequence: sums of word hashes times powers of two random odd numbers."""
    place = np.arange(len(words.hash)) - words.bounds[words.row] if len(words.hash) else np.zeros(0, np.int64)
    out = []
    for seed in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
        part = mix(words.hash + mix(place.astype(np.uint64) * np.uint64(seed)))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        out.append(mix(total[words.bounds[1:]] - total[words.bounds[:-1]] + words.counts.astype(np.uint64)))
    return out[0], out[1]


def shingle_sets(docs: DataFrame, config: MinHash) -> DataFrame:
    """Per row (doc_id, text): doc_id and its sorted set of shingle hashes."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in text_groups(batch.column(1)):
                rows, grams, _ = shingles(data, bounds, config.words)
                n = last - first
                cuts = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), _signed(grams))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), lists], names=schema.names)

    return map_batches(docs, run, schema)


def confirmed(edges: DataFrame, sets: DataFrame, config: MinHash) -> DataFrame:
    """Candidate edges (a, b) whose full sets are similar enough. A hub's set is joined last, so its edges may be split."""
    left = edges.join(sets.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("shingles").alias("set_b")), "b")
    both = left.join(sets.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("shingles").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * common >= config.min_pct * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


#: What bounds the number of shingles that two rows of a bucket can have in common.
PAIR_COLUMNS = ("n_shingles", "n_common", "rank", "sketch", "side")
SKETCH = 64


def star_edges(buckets: DataFrame, hubs_per_bucket: int, config: MinHash) -> tuple[DataFrame, DataFrame]:
    """Hubs of each bucket (bucket, rep) and their edges (a, b) to the bucket's rows in other components.

    Documents without a link come first, as those are the ones still to be compared. A bucket's sizes are
    aggregates, so no bucket is gathered in one task. Pairs that cannot be similar enough are left out: ``n_common`` of a
    document's shingles occur in others at all, and ``rank`` of those stand before the bucket's shingle in the order of all
    shingles, so the two have at most so many in common before and behind it; nor can they have more in common than the
    smaller one of their counts in each class of the ``sketch``. Rows with a ``side`` meet those of the other side only.
    """
    # The order of the documents is the same in all buckets, so that a group of copies has few different hubs.
    order = F.struct(F.col("n_in"), F.xxhash64("rep"), F.col("rep"))
    stats = buckets.groupBy("bucket").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n_rows"))
    chance = (F.pmod(F.xxhash64("rep", "bucket", F.lit(hubs_per_bucket)), F.lit(1 << 20)) * F.col("n_rows")) < F.lit((hubs_per_bucket - 1) << 20)
    marked = buckets.join(stats, "bucket").withColumn("is_hub", (order == F.col("least")) | chance)
    hubs = settle(marked.where("is_hub").select("bucket", "rep", "component", *PAIR_COLUMNS))
    a, b = (t.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "component", *PAIR_COLUMNS)]) for t, x in ((hubs, "a"), (buckets, "b")))
    behind = F.least(F.col("n_common_a") - F.col("rank_a"), F.col("n_common_b") - F.col("rank_b"))
    most = F.least(F.least("rank_a", "rank_b") + behind, F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda total, x: total + x))
    enough = most * (100 + config.min_pct) >= config.min_pct * (F.col("n_shingles_a") + F.col("n_shingles_b"))
    meet = (F.col("component_a") != F.col("component_b")) & (F.col("side_a").isNull() | (F.col("side_a") != F.col("side_b")))
    pairs = b.join(a, "bucket").where(meet & enough)
    return hubs, pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def linked(rows: DataFrame, buckets: DataFrame, config: MinHash) -> DataFrame:
    """(id, component) of the representatives with a link, found from the buckets (bucket, rep and PAIR_COLUMNS)."""
    reps = settle(buckets.select("rep").distinct())
    sets = shingle_sets(rows.join(reps, rows["doc_id"] == reps["rep"], "left_semi"), config)
    sets = settle(sets.select(F.col("doc_id").alias("rep"), F.size("shingles").alias("n_shingles"), "shingles"))
    labels = reps.select(F.col("rep").alias("id"), F.col("rep").alias("component")).limit(0)
    buckets = buckets.withColumns({"component": F.col("rep"), "n_in": F.lit(0)})
    n_hubs = 0
    while True:
        hubs, edges = star_edges(buckets, max(n_hubs, 1), config)
        found = settle(confirmed(edges, sets, config))
        if not found.isEmpty():
            labels = settle(merged(labels, found))
        buckets = unfinished(buckets.join(hubs.select("bucket", "rep"), ["bucket", "rep"], "left_anti"), labels)
        if buckets.isEmpty():
            return labels
        if n_hubs == 0:
            reps = buckets.select("rep").distinct()
            buckets = unfinished(rare_shingle_buckets(sets.join(reps, "rep", "left_semi"), config), labels)
            if buckets.isEmpty():
                return labels
        n_hubs = max(n_hubs * 64, 1)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after some more links (a, b) between ids."""
    a, b = (labels.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    between = links.join(a, "a", "left").join(b, "b", "left")
    between = settle(between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct())
    roots = components(between)
    moved = labels.join(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
    moved = moved.select("id", F.coalesce("root", "component").alias("component"))
    fresh = roots.join(labels.select("id"), "id", "left_anti").select("id", "component")
    return moved.union(fresh)


def unfinished(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets that hold several components, with component and n_in (0: no link so far)."""
    of = labels.select(F.col("id").alias("rep"), "component", F.lit(1).alias("n_in"))
    rows = buckets.select("bucket", "rep", *PAIR_COLUMNS).join(of, "rep", "left")
    rows = settle(rows.withColumns({"component": F.coalesce("component", "rep"), "n_in": F.coalesce("n_in", F.lit(0))}))
    several = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return settle(rows.join(several.select("bucket"), "bucket", "left_semi"))


#: Ratio of the sizes of two neighbouring size bands.
BAND = 1.05


def rare_shingle_buckets(sets: DataFrame, config: MinHash) -> DataFrame:
    """(bucket, rep and PAIR_COLUMNS): each set's rarest shared shingles, for each size band of a partner.

    Sets of sizes n and m with the wanted similarity have at least (n + m) * pct / (100 + pct) shingles in common, so in any
    one order of all shingles their first common one is among the first n - that + 1 of the one and likewise of the other.
    The order is by frequency; the shingles that no other set has come first and need not be listed.
    """
    each = sets.select("rep", "n_shingles", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = each.join(often, "shingle").groupBy("rep", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("s"))
    n, pct, log = F.col("n_shingles"), config.min_pct, float(np.log(BAND))
    band = lambda x: F.floor(F.log(x) / F.lit(log)).cast("int")
    # Counts of the shared shingles by the low bits of their hashes; null, which bounds nothing, where a count is too large.
    counts = F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda k: F.size(F.filter("s", lambda x: F.pmod(x["shingle"], F.lit(SKETCH)) == k)))
    sketch = F.when(F.array_max(counts) < 1 << 15, counts.cast("array<smallint>"))
    shared = shared.withColumns({"own": band(n), "n_common": F.size("s"), "sketch": sketch})
    # One band more at both ends and one shingle less in each band, so that rounding loses no pair.
    partners = shared.withColumn("other", F.explode(F.sequence(band(F.greatest(n * pct / 100, F.lit(1.0))) - 1, band(n * 100 / pct) + 1)))
    least = F.greatest(F.floor(F.pow(F.lit(BAND), F.col("other"))) - 1, F.lit(1))
    first = n - F.ceil((n + least) * pct / (100 + pct)) + 1 - (n - F.col("n_common"))
    rows = partners.withColumn("first", first.cast("int")).where("first > 0")
    rows = rows.select("*", F.posexplode(F.slice("s", F.lit(1), F.col("first"))["shingle"]).alias("rank", "shingle"))
    bucket = F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") != F.col("other"), F.col("own"))
    return rows.select(bucket.alias("bucket"), "rep", "n_shingles", "n_common", "rank", "sketch", side.alias("side"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", config: MinHash = MinHash()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable, itself included), kept (doc_id = component_id)."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    all_signed = settle(signed(rows.withColumn("doc_id", F.col("doc_id").cast("long")), config))
    texts = all_signed.where("doc_id is not null and bands is not null")
    classes = settle(
        texts.groupBy("text_hi", "text_lo").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n_docs"))
    )
    buckets = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "rep", "n_shingles")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    bands = buckets.join(shared, "bucket").select("bucket", "rep", "n_shingles", F.col("n_shingles").alias("n_common"), F.lit(0).alias("rank"))
    bands = bands.withColumns({"sketch": F.lit(None).cast("array<smallint>"), "side": F.lit(None).cast("int")})
    labels = linked(rows, settle(bands), config)
    same_text = texts.join(classes.where("n_docs > 1").select("text_hi", "text_lo", "rep"), ["text_hi", "text_lo"]).where("doc_id <> rep")
    labels = merged(labels, same_text.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    out = all_signed.select("doc_id", "n_shingles").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", config: MinHash = MinHash()) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all columns as they were.

    Only the ids that go are joined back. Rows that repeat the doc_id of a kept document stay.
    """
    gone = settle(near_duplicates(docs, doc_id, text, config).where("not kept").select(F.col("doc_id").alias("gone")).distinct())
    rows = numbered(docs)
    key = F.col(f"c{position(docs, doc_id)}").cast("long")
    return rows.join(gone, key == F.col("gone"), "left_anti").toDF(*docs.columns)
