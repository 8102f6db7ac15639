import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from audira.llm import toxicity
from audira.llm.toxicity import ToxicityPlan

LABELS = "doc_id long, quality int, toxic int"


def plain_buckets(text, plan):
    """Buckets of a text's n-grams, one window at a time."""
    padded, out = " " + " ".join(text.lower().split()) + " ", set()
    for n in plan.sizes:
        for i in range(len(padded) - n + 1):
            h = ord(padded[i])
            for c in padded[i + 1 : i + n]:
                h = (h * 0x9E3779B97F4A7C15 ^ ord(c)) % 2**64
            out.add((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 64 - plan.bits)
    return out


def groups_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_grams_against_plain_code(monkeypatch):
    plan, texts = ToxicityPlan(), ["", " ", "a", "Ab  cÜ\n中 x", "a", "some words here, " * 30, "İß"]
    want = [(i, b) for i, t in enumerate(texts) for b in sorted(plain_buckets(t, plan))]
    for piece in (1 << 18, 5):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        row, bucket = toxicity.gram_buckets(*groups_of(texts), plan)
        assert list(zip(row.tolist(), bucket.tolist(), strict=True)) == want


def made(n, seed=1):
    pick = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(pick.choice(["ka", "lo", "mi", "ter", "sun"]) for _ in range(pick.randrange(1, 4))) for _ in range(pick.randrange(10, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(pick.randrange(len(words)), "vex" + pick.choice(["om", "ard", "ulo", "ine"]))
        docs.append((i, " ".join(words), None, None))
        labels.append((i, None, int(toxic)))
    return docs, labels


def test_held_out_documents(spark, docs_of, clashing):
    docs, labels = made(900)
    got = toxicity.toxicity_report(clashing(docs_of(docs)), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 900 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    test = [r for r in got if r.held_out]
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted != (r.doc_id % 6 == 0) for r in test) <= 0.02 * len(test)


def test_scores_of_plain_code(spark, docs_of):
    """The whole chain on one machine: counts, ratios, features, regression, scores."""
    docs, labels = made(240, 7)
    plan = ToxicityPlan(max_features=300, steps=40)
    teach = [(i, t, y) for (i, t, *_), (_, _, y) in zip(docs, labels, strict=True) if zlib.crc32(str(i).encode()) % 3 != 1]
    grams = {i: plain_buckets(t, plan) for i, t, *_ in docs}
    n = [sum(y == k for *_, y in teach) for k in (0, 1)]
    counts = {}
    for i, _, y in teach:
        for b in grams[i]:
            counts.setdefault(b, [0, 0])[y] += 1
    share, ranked = n[1] / sum(n), []
    for b, (c0, c1) in counts.items():
        both = c0 + c1
        tells = sum(c * np.log(max(c, 0.5) / max(e, 0.5)) for c, e in ((c1, both * share), (c0, both * (1 - share))))
        ranked.append((-round(tells, 6), b, float(np.log((c1 + 1) / (n[1] + 2) / ((c0 + 1) / (n[0] + 2))))))
    best = sorted(r for r in ranked if r[2] != 0)[:300]
    number = {b: k for k, (_, b, _) in enumerate(best)}
    ratios = np.array([r for *_, r in best])
    sample = [(y, np.array(sorted(number[b] for b in grams[i] if b in number), np.int64)) for i, _, y in teach]
    w, b = toxicity.fit_linear(sample, ratios, tuple(n), plan)
    want = {i: float(toxicity.sigmoid(np.array(sum((w * ratios)[number[g]] for g in grams[i] if g in number) + b))) for i, *_ in docs}
    got = toxicity.toxicity_report(docs_of(docs), spark.createDataFrame(labels, LABELS), plan=plan).collect()
    assert max(abs(r.score - want[r.doc_id]) for r in got) < 1e-6


def test_labels_that_disagree_and_odd_rows(spark, docs_of):
    docs, labels = made(300)
    odd = [(None, "vexom vexard", None, None), (5000, None, None, None), (5001, "", None, None), (5002, "x" * 400_000 + " vexom vexard vexulo " + "y " * 200_000, None, None), (5002, "again", None, None)]
    more = [(7, None, 1), (None, None, 1), (6000, None, None), (0, None, 1), (8, None, 5)]
    report = lambda d, t: {(r.doc_id, r.predicted): r.score for r in toxicity.toxicity_report(docs_of(d), spark.createDataFrame(t, LABELS)).collect()}
    got = report(docs + odd, labels + more)
    assert got[5000, 0] == got[5001, 0] and (None, 1) in got and (5002, 1) in got and (5002, 0) in got
    agreeing = [r for r in labels if r[0] not in (7,)]
    assert report(docs + odd, agreeing) == got


def test_nothing_or_one_class_to_learn_from(spark, docs_of):
    docs = [(i, f"text {i}", None, None) for i in range(12)]
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.toxicity_report(docs_of(docs), none).collect()} == {0.5}
    good = spark.createDataFrame([(i, None, 0) for i in range(12)], LABELS)
    assert all(r.score < 0.2 and r.predicted == 0 for r in toxicity.toxicity_report(docs_of(docs), good).collect())
    assert toxicity.toxicity_report(docs_of([]), good).collect() == []


def test_the_sample_is_bounded(spark, docs_of):
    docs, labels = made(300)
    plan = ToxicityPlan(max_fit_rows=40)
    sample, totals = toxicity.label_sample(spark.createDataFrame(labels, LABELS).select("doc_id", "toxic"), plan)
    teach = [t for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    assert totals == (teach.count(0), teach.count(1))
    ids = {r.doc_id: r.toxic for r in sample.collect()}
    assert [list(ids.values()).count(k) for k in (0, 1)] == [20, 20]
    rows = docs_of(docs * 3).join(sample, "doc_id").select("toxic", F.xxhash64("doc_id", "text").alias("hash"), "text")
    features = toxicity.sampled_features(rows, np.arange(100), plan)
    assert [sum(t == k for t, _ in features) for k in (0, 1)] == [20, 20]
    got = toxicity.toxicity_report(docs_of(docs), spark.createDataFrame(labels, LABELS), plan=plan).where("held_out").collect()
    assert sum(r.predicted != (r.doc_id % 6 == 0) for r in got) <= 0.1 * len(got)
