"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters by multiplication, the first one
permuted (rotated) twice, the second once, so the order counts. A document's vector bundles (adds) the vectors of its
trigrams; a language's prototype bundles those of its documents. The language of a document is the one whose prototype has
the largest cosine with the document's vector.

Bundling is addition, so a prototype is the sum of its trigrams' vectors times their counts. Training counts trigrams by
language in Spark (at most 2^18 sums per language, combined before the shuffle), then bundles them. Prediction needs one
vector per language in each task, nothing else.

Letters are Unicode letters in lower case. a-z have slots of their own, other letters share the remaining 37; everything
between letters is one blank. Only text and language of training rows are learned from; a null or letterless text is
``und`` with score 0 and teaches nothing, and so are all texts when there is nothing to learn from. Ties go to the smaller
language name. Null ids count as the text "" for the split. Repeated rows are predicted row by row; empty tables give empty
results. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audira.llm.shared import extended, map_batches, pick, settle, text_groups

SLOT_BITS = 6
SLOTS = 1 << SLOT_BITS
N_CODES = 1 << 3 * SLOT_BITS
UNKNOWN = "und"
#: Texts of so many bytes share the vectors of their trigrams.
TEXT_BYTES = 1 << 20


@dataclass(frozen=True)
class Profile:
    dimensions: int = 1024
    seed: int = 7


@cache
def slots() -> np.ndarray:
    """Slot of every character: 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint8)
    letters = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()])
    out[letters] = 27 + letters % 37
    out[97:123] = np.arange(1, 27)
    return out


@cache
def letter_vectors(profile: Profile) -> np.ndarray:
    return np.random.default_rng(profile.seed).integers(0, 2, (SLOTS, profile.dimensions), dtype=np.int8) * 2 - 1


def trigram_vectors(codes: np.ndarray, profile: Profile) -> np.ndarray:
    """Bind the permuted letter vectors of each trigram code."""
    letters = letter_vectors(profile)
    twice, once = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return twice[codes >> 2 * SLOT_BITS] * once[codes >> SLOT_BITS & SLOTS - 1] * letters[codes & SLOTS - 1]


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code) of the trigrams of each text, and which texts have a letter. A text begins and ends with a blank."""
    n = len(bounds) - 1
    texts = [data[a:b].tobytes().decode("utf-8", "replace").lower() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    codes = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
    kinds = slots()[codes]
    # Text i lies between the blanks i and i + 1 of the joined texts; each blank belongs to both.
    row = np.repeat(np.arange(-1, n), [1, *[len(t) + 1 for t in texts]]) if n else np.zeros(0, np.int64)
    letters = np.zeros(n, bool)
    letters[row[kinds > 0]] = True
    keep = np.ones(len(kinds), bool)
    keep[1:] = (kinds[1:] > 0) | (kinds[:-1] > 0)  # runs of other characters are one blank
    kinds, row = kinds[keep].astype(np.int64), row[keep]
    if len(kinds) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    code = kinds[:-2] << 2 * SLOT_BITS | kinds[1:-1] << SLOT_BITS | kinds[2:]
    real = kinds[1:-1] > 0  # the middle is a letter: the trigram lies in its text
    return row[1:-1][real], code[real], letters


def learned(docs: DataFrame, profile: Profile) -> tuple[list[str], np.ndarray]:
    """Languages and prototypes from rows (text, lang). The driver gets one vector per language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for first, last, data, bounds in text_groups(batch.column(0), TEXT_BYTES):
                rows, codes, _ = trigrams(data, bounds)
                for lang in set(langs[first:last]):
                    mine = np.bincount(codes[(langs[first:last] == lang)[rows]], minlength=N_CODES)
                    totals[lang] = totals.get(lang, 0) + mine
        for lang, total in totals.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(total[found])], names=["lang", "code", "n"])

    counts = settle(map_batches(docs.select("text", "lang"), count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            codes, n = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.float64)
            for lang in set(langs):
                mine = langs == lang
                for k in range(0, int(mine.sum()), 4096):
                    part = n[mine][k : k + 4096] @ trigram_vectors(codes[mine][k : k + 4096], profile)
                    sums[lang] = sums.get(lang, 0.0) + part
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(vector)), pa.array(np.arange(len(vector))), pa.array(vector)], names=["lang", "i", "x"])

    sums = map_batches(counts, bundle, "lang string, i long, x double").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))  # as many as there are dimensions
    found = sorted((r.lang, [e.x for e in r.v]) for r in vectors.collect())
    return [lang for lang, _ in found], np.array([v for _, v in found], np.float64).reshape(len(found), profile.dimensions)


def predicted(rows: DataFrame, langs: list[str], prototypes: np.ndarray, profile: Profile) -> DataFrame:
    """Add lang_pred and score (the cosine, at least 0) to rows with a text column, and drop the text."""
    at = rows.columns.index("text")
    names = [*[c for c in rows.columns if c != "text"], "lang_pred", "score"]
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = rows.sparkSession.sparkContext.broadcast((prototypes / np.where(norms > 0, norms, 1)).astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in text_groups(batch.column(at), TEXT_BYTES):
                n = last - first
                name, score = np.array([UNKNOWN] * n, object), np.zeros(n)
                texts, codes, letters = trigrams(data, bounds)
                if len(langs) and len(codes):
                    best, cosine = nearest(texts, codes, n, unit.value, profile)
                    name[letters] = np.array(langs, object)[best[letters]]
                    score[letters] = np.clip(cosine[letters], 0.0, 1.0)
                part = batch.slice(first, n)
                kept = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(name, pa.string()), pa.array(score)], names=names)

    return map_batches(rows, run, extended(rows.drop("text"), lang_pred=T.StringType(), score=T.DoubleType()))


def nearest(texts: np.ndarray, codes: np.ndarray, n: int, unit: np.ndarray, profile: Profile) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts the nearest prototype and its cosine."""
    seen = np.zeros(N_CODES, bool)
    seen[codes] = True
    used = np.flatnonzero(seen)
    number = np.cumsum(seen) - 1
    vectors = trigram_vectors(used, profile)
    best, cosine = np.zeros(n, np.int64), np.zeros(n)
    for lo in range(0, n, 256):
        mine = slice(*np.searchsorted(texts, [lo, lo + 256]))
        m = min(256, n - lo)
        counts = np.bincount((texts[mine] - lo) * len(used) + number[codes[mine]], minlength=m * len(used)).reshape(m, len(used))
        exact = np.float32 if counts.sum(axis=1).max() < 1 << 24 else np.float64  # whole numbers in either
        bundled = (counts.astype(exact) @ vectors.astype(exact)).astype(np.float64)
        dots = bundled @ unit.T
        lengths = np.linalg.norm(bundled, axis=1)
        best[lo : lo + m] = dots.argmax(axis=1)
        cosine[lo : lo + m] = dots.max(axis=1) / np.where(lengths > 0, lengths, 1)
    return best, cosine


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def language_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", profile: Profile = Profile()) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Rows that are not held out and have a language are learned from."""
    rows = pick(docs, doc_id, text, lang).toDF("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    langs, prototypes = learned(rows.where("not held_out and lang is not null"), profile)
    return predicted(rows.select("doc_id", "held_out", "text"), langs, prototypes, profile)
