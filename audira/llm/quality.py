"""Quality rules with host verdicts: rule failures by host, rates shrunk by an empirical beta prior, joined back.

Base rules reject a document by itself: fewer than 50 words, or more than half of its words in repeated windows. Soft rules
(too many symbols, odd word lengths, too many repeated lines) alone say little; how many of them a document may fail
depends on its host. A host's rate of failing documents is shrunk to the mean of all hosts by a beta prior that is fitted to
all hosts, so that a host with three documents is not judged by them alone.

=====================  ==============================================
shrunk failure rate    soft failures that a document of the host may have
=====================  ==============================================
below ``strict``       1
from ``strict`` on     0
from ``blocked`` on    none: every document of the host goes
=====================  ==============================================

Null texts count as empty: no words, so they fail the base rule. Null hosts form a host of their own. Repeated rows are
judged row by row and count as often in their host. Empty tables give empty results. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audira.llm.shared import extended, map_batches, numbered, position, same, settle, text_groups
from audira.llm.words import IS_WORD, Words, hash_spans, lookup, mix, ngrams, words_of

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = lookup(b"#*$%&|<>")


@dataclass(frozen=True)
class HostRules:
    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbol_pct: int = 10  # symbols to words
    min_word_chars: int = 3  # mean
    max_word_chars: int = 10
    max_dup_line_pct: int = 30
    strict: float = 0.5
    blocked: float = 0.9
    min_strength: float = 2.0  # of the prior, in documents
    max_strength: float = 1000.0

    def base_failed(self) -> Column:
        few = F.col("n_words") < self.min_words
        return few | (100 * F.col("n_repeat_words") > self.max_repeat_pct * F.col("n_words"))

    def n_soft(self) -> Column:
        n, chars = F.col("n_words"), F.col("word_chars")
        failed = [
            100 * F.col("n_symbols") > self.max_symbol_pct * n,
            (chars < self.min_word_chars * n) | (chars > self.max_word_chars * n),
            100 * F.col("n_dup_lines") > self.max_dup_line_pct * F.col("n_lines"),
        ]
        return sum((f.cast("int") for f in failed[1:]), failed[0].cast("int"))


def _first_and_repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether an equal one stands before it, whether an equal one stands anywhere else."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first[inverse] != np.arange(len(keys)), counts[inverse] > 1


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def _lines(data: np.ndarray, bounds: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word and lines equal to an earlier one, by row."""
    n = len(bounds) - 1
    if not len(words.first):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    breaks = np.flatnonzero(data == 10)
    first = np.union1d(bounds[:-1], breaks + 1)
    first = first[first < len(data)]
    last = np.append(first[1:], len(data))
    last = last - ((data[last - 1] == 10) & (last > first))
    has = np.searchsorted(words.first, last) > np.searchsorted(words.first, first)
    first, last = first[has], last[has]
    row = np.searchsorted(bounds, first, "right") - 1
    again, _ = _first_and_repeats(mix(hash_spans(data, first, last) + mix(row.astype(np.uint64))))
    return np.bincount(row, minlength=n), np.bincount(row[again], minlength=n)


def measure(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the rules for the texts of one group."""
    words, n = words_of(data, bounds), len(bounds) - 1
    at, grams = ngrams(words, 3)
    _, repeated = _first_and_repeats(mix(grams + mix(words.row[at].astype(np.uint64))))
    covered = np.zeros(len(words.first), bool)
    for k in range(3):
        covered[at[repeated] + k] = True
    n_lines, n_dup = _lines(data, bounds, words)
    return {
        "n_words": words.counts,
        "word_chars": _sums(IS_WORD[data] & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": _sums(SYMBOLS[data], bounds),
        "n_dup_lines": n_dup,
        "n_repeat_words": np.bincount(words.row[covered], minlength=n),
        "n_lines": n_lines,
    }


def with_features(docs: DataFrame, text: str) -> DataFrame:
    """All columns and the counts of the rules."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in text_groups(batch.column(at)):
                found = measure(data, bounds)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(found[f], pa.int64()) for f in FEATURES]], names=[*part.schema.names, *FEATURES])

    return map_batches(docs, run, extended(docs, **{f: T.LongType() for f in FEATURES}))


def judged(features: DataFrame, rules: HostRules) -> DataFrame:
    return features.withColumns({"base_failed": rules.base_failed(), "n_soft": rules.n_soft()})


def host_verdicts(features: DataFrame, host: str, rules: HostRules = HostRules()) -> DataFrame:
    """Per host: n_docs, n_failed, shrunk_rate, allowed (soft failures a document may have; -1: blocked).

    Two aggregates: one row per host, then one row for all hosts, from which the beta prior follows by moments.
    """
    failed = F.col("base_failed") | (F.col("n_soft") > 0)
    hosts = settle(features.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed")))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.sum(rate * F.col("n_failed")).alias("q")).first()
    alpha, beta = beta_prior(moments.k, moments.n or 0, moments.f or 0, moments.q or 0.0, rules)
    shrunk = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    allowed = F.when(F.col("shrunk_rate") >= rules.blocked, -1).when(F.col("shrunk_rate") >= rules.strict, 0).otherwise(1)
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("allowed", allowed)


def beta_prior(k: int, n: int, f: int, q: float, rules: HostRules) -> tuple[float, float]:
    """Beta prior by moments. k hosts, n documents, f failed ones; q: sum of failed * rate over hosts."""
    if not n:
        return 1.0, 1.0
    mean = f / n
    spread = max(0.0, q / n - mean * mean)  # of the rates, hosts weighted by their documents
    noise = mean * (1 - mean) * k / n  # what chance alone makes of it
    between = spread - noise
    strength = mean * (1 - mean) / between - 1 if between > 0 else rules.max_strength
    strength = min(max(strength, rules.min_strength), rules.max_strength)
    return mean * strength, (1 - mean) * strength


def apply_verdicts(features: DataFrame, host: str, verdicts: DataFrame) -> DataFrame:
    """Join on the host, null-safe; a hot host is split by Spark's skew join unless the verdicts are small enough to be sent."""
    v = verdicts.select(F.col("host").alias("v_host"), "shrunk_rate", "allowed")
    joined = features.join(v, same(F.col(host), F.col("v_host")), "left").drop("v_host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("n_soft") <= F.col("allowed")))


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """Per row: doc_id, host, the counts, base_failed, n_soft, shrunk_rate, allowed, kept. Texts are read once."""
    c = [f"c{position(docs, n)}" for n in (doc_id, text, host)]
    narrow = numbered(docs).select(F.col(c[0]).alias("doc_id"), F.col(c[2]).alias("host"), F.col(c[1]).alias("text"))
    features = settle(judged(with_features(narrow, "text").drop("text"), rules))
    return apply_verdicts(features, "host", host_verdicts(features, "host", rules))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """The documents that pass, all columns as they were.

    The texts are read twice, once for the hosts and once for the verdicts; they are neither stored nor shuffled while the
    verdicts are small.
    """
    names, t, h = docs.columns, f"c{position(docs, text)}", f"c{position(docs, host)}"
    rows = numbered(docs)
    verdicts = settle(host_verdicts(judged(with_features(rows.select(t, h), t), rules), h, rules))
    kept = apply_verdicts(judged(with_features(rows, t), rules), h, verdicts).where("kept")
    return kept.select(*rows.columns).toDF(*names)
