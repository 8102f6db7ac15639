"""Registered queries against their SQL, and the pipeline against plain code."""

import zlib

import brute
import corpus_pipeline
import numpy as np
import oracle
import pytest
from tokenizers import Tokenizer

from audira.llm.queries import QUERIES


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_matches_sql(spark, con, sf_dir, name):
    assert oracle.differences(spark, con, QUERIES[name], sf_dir) is None


def test_there_is_one_query_for_each_operator():
    import __spark_entry__ as contract

    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2:3].isdigit()) == list(range(1, 14))
    assert "pipeline" in contract.queries()


def test_stages_one_after_the_other(spark, sf_dir):
    """Each stage on its own input, against plain versions; the last one against the tokenizers library."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "token_files"]

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    good = stages["quality_rules"](spark, docs, sf_dir).cache()
    assert good.columns == docs.columns
    kept = {r[0] for r in rows(good)}
    for i, text, *_ in rows(docs):
        q = brute.quality(text)
        if q["n_words"] < 50 or 100 * q["n_repeat_words"] > 50 * q["n_words"]:
            assert i not in kept
    assert len(kept) > 0.5 * docs.count()

    single = stages["near_dedup"](spark, good, sf_dir).cache()
    want = brute.components({i: brute.shingles(t) for i, t, *_ in rows(good)})
    assert [r[0] for r in rows(single)] == sorted(i for i, c in want.items() if i == c)

    clean = stages["decontaminate"](spark, single, sf_dir).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {i for i, _ in brute.leaks([(r[0], r[1]) for r in rows(single) if any(brute.LETTERS.findall(t.lower())[3:6] and " ".join(t.split()[3:6]) in r[1] for _, t in items)], items)}
    assert {r[0] for r in rows(clean)} == {r[0] for r in rows(single)} - leaked

    mixed = stages["mix_sources"](spark, clean, sf_dir).cache()
    sizes = {}
    for r in rows(clean):
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.WORD.findall(r[1] or ""))
    taken = dict.fromkeys(sizes, 0)
    for r in rows(mixed):
        taken[r[3]] += len(brute.WORD.findall(r[1] or ""))
    largest = max(len(brute.WORD.findall(r[1] or "")) for r in rows(clean))
    for s, target in brute.mix_targets(sizes).items():
        assert abs(taken[s] - target) <= largest

    library = Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json"))
    got = rows(stages["token_files"](spark, mixed, sf_dir))
    ids = sorted((r[0], len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for r in rows(mixed) for e in [[*library.encode(r[1], add_special_tokens=False).ids, 1]])
    assert sorted((g[0], g[2], g[3]) for g in got) == ids
    assert sorted(rows(corpus_pipeline.run(spark, sf_dir))) == sorted(got)
