"""Toxicity: a linear classifier on character n-grams, whose features are scaled by naive Bayes log-count ratios.

A text's features are the character n-grams of its lower-cased words with one blank between them, hashed to 2^bits
buckets; a feature is there or not. Training uses a bounded sample of the labelled rows: of each class the
``max_fit_rows`` / 2 ids with the smallest hash. That is the only sample, and what reaches the driver is bounded by it. It
is also why the documents are not shuffled: the sample's ids and labels are broadcast to them.

1. Spark counts in how many of the sample's texts of each class each bucket occurs (combined before the shuffle, at most
   2^bits rows from a task). From it follows each bucket's log-count ratio r: the logarithm of its smoothed rate in toxic
   texts over that in others.
2. The ``max_features`` buckets that tell the classes apart best (by the G statistic of their counts) become features.
3. A logistic regression with an L2 penalty is fitted to the features times r; a row weighs as many labelled rows of its
   class as it stands for.

A text's score is the regression's probability. Each task needs one number per feature. Texts are read whole; long ones in
pieces that overlap, so no n-gram is lost.

Null texts count as empty; an empty text has no feature and its score is the regression's at none. Null labels teach
nothing. Labels of one id that agree count once, those that don't agree teach nothing; null ids have no label. Repeated
documents are scored row by row, and each teaches. Where only one class, or nothing, is labelled, the score of every text is the
smoothed share of toxic rows. Empty tables give empty results. Ties between buckets go to the smaller number. Bytes that
are no UTF-8 count as replacement characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audira.llm.shared import extended, map_batches, pick, settle, text_groups

#: Bytes of texts that are worked on at once; n-grams that are hashed at once.
TEXT_BYTES, PIECE = 1 << 18, 1 << 18


@dataclass(frozen=True)
class ToxicityPlan:
    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    max_features: int = 4096
    max_fit_rows: int = 30_000
    smoothing: float = 1.0
    penalty: float = 1.0
    steps: int = 300
    threshold: float = 0.7


@dataclass(frozen=True)
class LinearModel:
    buckets: np.ndarray
    weights: np.ndarray  # of the regression times the log-count ratio
    intercept: float


def gram_buckets(data: np.ndarray, bounds: np.ndarray, plan: ToxicityPlan, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) of the texts of one group, in order; with ``number``, (row, number of the bucket) where it has one."""
    size = 1 << plan.bits if number is None else int(number.max(initial=0)) + 1
    texts = [" ".join(data[a:b].tobytes().decode("utf-8", "replace").lower().split()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    codes = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    # Text i lies between the blanks i and i + 1 of the joined texts; each of them belongs to both sides.
    edge = np.zeros(len(codes), np.int64)
    edge[np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])] = 1
    after = np.cumsum(edge) - 1
    before = after - edge
    found = []
    for lo in range(0, len(codes), PIECE):
        h = codes[lo : lo + PIECE].astype(np.uint64)
        for k in range(1, max(plan.sizes)):
            last = codes[lo + k : lo + k + PIECE]
            h = (h[: len(last)] * np.uint64(0x9E3779B97F4A7C15)) ^ last
            if k + 1 not in plan.sizes:
                continue
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            bucket = (mixed >> np.uint64(64 - plan.bits)).astype(np.int64)
            row = after[lo : lo + len(h)]
            inside = row == before[lo + k : lo + k + len(h)]
            if number is not None:
                bucket = number[bucket]
                inside &= bucket >= 0
            found.append(row[inside] * size + bucket[inside])
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // size, keys % size


def bucket_counts(rows: DataFrame, plan: ToxicityPlan) -> DataFrame:
    """(bucket, n0, n1): texts of each class with the bucket, from rows (toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << plan.bits), np.int32)
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            for first, _, data, bounds in text_groups(batch.column(1), TEXT_BYTES):
                row, bucket = gram_buckets(data, bounds, plan)
                is_toxic = toxic[first + row] == 1
                for k, mine in enumerate((bucket[~is_toxic], bucket[is_toxic])):
                    totals[k] += np.bincount(mine, minlength=1 << plan.bits).astype(np.int32)
        used = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(t[used].astype(np.int64)) for t in totals]], names=["bucket", "n0", "n1"])

    counts = map_batches(rows.select("toxic", "text"), run, "bucket long, n0 long, n1 long")
    return counts.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def best_buckets(counts: DataFrame, n0: int, n1: int, plan: ToxicityPlan) -> DataFrame:
    """(bucket, ratio) of the features."""
    both, share = F.col("n0") + F.col("n1"), n1 / (n0 + n1)

    def part(n: Column, expected: Column) -> Column:
        return n * F.log(F.greatest(n, F.lit(0.5)) / F.greatest(expected, F.lit(0.5)))

    tells = F.round(part(F.col("n1"), both * share) + part(F.col("n0"), both * (1 - share)), 6)
    rate1 = (F.col("n1") + plan.smoothing) / (n1 + 2 * plan.smoothing)
    rate0 = (F.col("n0") + plan.smoothing) / (n0 + 2 * plan.smoothing)
    ranked = counts.select("bucket", F.log(rate1 / rate0).alias("ratio"), tells.alias("tells")).where("ratio <> 0")
    return ranked.orderBy(F.desc("tells"), "bucket").limit(plan.max_features).select("bucket", "ratio")


def sampled_features(rows: DataFrame, buckets: np.ndarray, plan: ToxicityPlan) -> list[tuple[int, np.ndarray]]:
    """(toxic, numbers of the features) of rows (toxic, hash, text), of each class at most half of max_fit_rows."""
    number = _numbers(buckets, plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in text_groups(batch.column(2), TEXT_BYTES):
                row, feature = gram_buckets(data, bounds, plan, number)
                cuts = np.searchsorted(row, np.arange(last - first + 1)) * 2
                raw = pa.py_buffer(feature.astype("<u2"))
                column = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(cuts.astype(np.int32)), raw])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), column], names=["toxic", "hash", "features"])

    features = settle(map_batches(rows.select("toxic", "hash", "text"), run, "toxic int, hash long, features binary"))
    out = []
    for k in (0, 1):  # repeated documents of one id may be more than the bound
        smallest = features.where(F.col("toxic") == k).orderBy("hash", "features").limit(plan.max_fit_rows // 2).select("features")
        out += [(k, np.frombuffer(r, "<u2").astype(np.int64)) for r in smallest.toArrow().column(0).to_pylist()]
    return out


def _numbers(buckets: np.ndarray, plan: ToxicityPlan) -> np.ndarray:
    number = np.full(1 << plan.bits, -1, np.int64)
    number[buckets] = np.arange(len(buckets))
    return number


def fit_linear(sample: list[tuple[int, np.ndarray]], ratios: np.ndarray, n: tuple[int, int], plan: ToxicityPlan) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised logistic regression, by accelerated gradient steps."""
    y = np.array([t for t, _ in sample], np.float64)
    row = np.repeat(np.arange(len(sample)), [len(f) for _, f in sample])
    col = np.concatenate([f for _, f in sample])
    value = ratios[col]
    stands = np.array([n[k] / max(1, (y == k).sum()) for k in (0, 1)])[y.astype(int)]
    stands = stands * (len(y) / stands.sum())

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=value * w[col], minlength=len(y))

    def back(z: np.ndarray) -> np.ndarray:
        return np.bincount(col, weights=value * z[row], minlength=len(ratios))

    top, probe = 1.0, np.ones(len(ratios))
    for _ in range(20):  # largest eigenvalue, for the length of a step
        probe = back(stands * times(probe))
        top = float(np.linalg.norm(probe)) or 1.0
        probe /= top
    step = 1 / (0.25 * (top + stands.sum()) + plan.penalty)
    w, ahead = np.zeros(len(ratios)), np.zeros(len(ratios))
    b = ahead_b = 0.0
    t = 1.0
    for _ in range(plan.steps):
        z = stands * (sigmoid(times(ahead) + ahead_b) - y)
        new, new_b = ahead - step * (back(z) + plan.penalty * ahead), ahead_b - step * float(z.sum())
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / grown * (new - w), new_b + (t - 1) / grown * (new_b - b)
        w, b, t = new, new_b, grown
    return w, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def learned(rows: DataFrame, totals: tuple[int, int], plan: ToxicityPlan) -> LinearModel:
    """The model from the sample's rows (toxic 0 or 1, hash, text); totals: all labelled ids of each class."""
    found = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = (found.get(0, 0), found.get(1, 0))
    nothing = LinearModel(np.zeros(0, np.int64), np.zeros(0), float(np.log((n[1] + 1) / (n[0] + 1))))
    if not all(n):
        return nothing
    best = best_buckets(bucket_counts(rows, plan), *n, plan).collect()
    if not best:
        return nothing
    buckets, ratios = np.array([r.bucket for r in best]), np.array([r.ratio for r in best])
    w, b = fit_linear(sampled_features(rows, buckets, plan), ratios, totals, plan)
    return LinearModel(buckets, w * ratios, b)


def scored(rows: DataFrame, model: LinearModel, plan: ToxicityPlan) -> DataFrame:
    """Add score and predicted to rows with a text column, and drop the text."""
    at = rows.columns.index("text")
    names = [*[c for c in rows.columns if c != "text"], "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers(model.buckets, plan)
        for batch in batches:
            for first, last, data, bounds in text_groups(batch.column(at), TEXT_BYTES):
                n = last - first
                row, feature = gram_buckets(data, bounds, plan, number)
                score = sigmoid(np.bincount(row, weights=model.weights[feature], minlength=n) + model.intercept)
                part = batch.slice(first, n)
                kept = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array((score >= plan.threshold).astype(np.int32))], names=names)

    return map_batches(rows, run, extended(rows.drop("text"), score=T.DoubleType(), predicted=T.IntegerType()))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def label_sample(labels: DataFrame, plan: ToxicityPlan) -> tuple[DataFrame, tuple[int, int]]:
    """(doc_id, toxic) of at most max_fit_rows ids that may be learned from, one label each; all such ids of each class."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    known = settle(known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("order")))
    found = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [known.where(F.col("toxic") == k).orderBy("order", "doc_id").limit(plan.max_fit_rows // 2) for k in (0, 1)]
    return settle(some[0].union(some[1]).select("doc_id", "toxic")), (found.get(0, 0), found.get(1, 0))


def toxicity_report(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", plan: ToxicityPlan = ToxicityPlan()
) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Learns from labels of documents that are not held out."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    sample, totals = label_sample(pick(labels, doc_id, label).toDF("doc_id", "toxic"), plan)
    # At most max_fit_rows ids and labels: broadcast, so that no text is shuffled.
    teaching = rows.join(F.broadcast(sample), "doc_id").select("toxic", F.xxhash64("doc_id", "text").alias("hash"), "text")
    model = learned(settle(teaching), totals, plan)
    return scored(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, plan)
