import random

import brute
import numpy as np
import pytest

from audira.llm import near_dedup as nd
from audira.llm.components import components


def corpus(seed=1):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    base = [[pick.choice(vocabulary) for _ in range(pick.randrange(3, 120))] for _ in range(40)]
    rows = []
    for b in base:
        for _ in range(pick.randrange(1, 9)):
            words = list(b)
            for _ in range(pick.randrange(0, 4)):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
            rows.append(" ".join(words))
    passage = " ".join(pick.choice(vocabulary) for _ in range(60))  # shared, but not enough for a link
    rows += [passage + " " + " ".join(pick.choice(vocabulary) for _ in range(60)) for _ in range(40)]
    long = [pick.choice(vocabulary) for _ in range(150)]  # a large group around one text
    for _ in range(150):
        words = list(long)
        for _ in range(4):
            words[pick.randrange(150)] = pick.choice(vocabulary)
        rows.append(" ".join(words))
    rows += [None, "", "  \n", "one two", "ONE  two", "one two three", "É a", "é a", "A\tb c d e", "a b c d e", rows[0].upper()]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_plain_code(docs_of, clashing, seed):
    rows = [(i * 7 + 3, t, None, None) for i, t in enumerate(corpus(seed))]
    got = {r.doc_id: r for r in nd.near_duplicates(clashing(docs_of(rows))).collect()}
    sets = {i: brute.shingles(t) for i, t, _, _ in rows}
    want = brute.components(sets)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_similarity_of_exactly_the_limit_links(docs_of):
    words = [f"v{i}" for i in range(19)]  # 15 shingles; 20 with 5 more words: 15 / 20
    rows = [(2, " ".join(words), None, None), (1, " ".join(words + [f"x{i}" for i in range(5)]), None, None), (3, " ".join(words + [f"y{i}" for i in range(6)]), None, None)]
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs_of(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_nulls_and_repeated_rows(docs_of):
    t = " ".join(f"v{i}" for i in range(30))
    rows = [(5, t, None, None)] * 3 + [(None, t, None, None), (4, t, None, None), (9, "else entirely", None, None), (9, t, None, None)]
    got = nd.near_duplicates(docs_of(rows)).collect()
    assert len(got) == 7
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 4, False), (None, None, True), (4, 4, True), (9, 4, False)}
    docs = docs_of(rows)
    left = nd.without_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 4]


def test_empty_and_single(docs_of):
    assert nd.near_duplicates(docs_of([])).collect() == []
    assert [tuple(r) for r in nd.near_duplicates(docs_of([(1, None, None, None)])).collect()] == [(1, 0, 1, True)]


def test_long_text(docs_of):
    pick = random.Random(3)
    words = [str(pick.randrange(10**9)) for _ in range(300_000)]
    rows = [(1, " ".join(words), None, None), (2, " ".join(words[:290_000]), None, None), (3, "x" * 5_000_000, None, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs_of(rows)).collect()}
    assert got == {1: (299_996, 1), 2: (289_996, 1), 3: (1, 3)}


def test_stars_bound_the_pairs(spark, docs_of, monkeypatch):
    """A group of n copies must not make n^2 candidates."""
    pick = random.Random(4)
    base = [f"w{pick.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(300):
        words = list(base)
        words[pick.randrange(400)] = "other"
        rows.append((i, " ".join(words), None, None))
    seen = []
    plain = nd.star_edges

    def counted(*args):
        hubs, edges = plain(*args)
        seen.append(edges.count())
        return hubs, edges

    monkeypatch.setattr(nd, "star_edges", counted)
    got = nd.near_duplicates(docs_of(rows)).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(seen) < 300 * 16


def test_densified_signatures_estimate_similarity():
    random_ = np.random.default_rng(1)
    for size in (4, 20, 2000):
        shared = random_.integers(1, 2**64, size, dtype=np.uint64)
        a, b = (np.concatenate([shared, random_.integers(1, 2**64, size // 2, dtype=np.uint64)]) for _ in range(2))
        values, has = nd.signatures(np.repeat([0, 1], len(a)), np.concatenate([a, b]), 3, 4096)
        assert has.tolist() == [True, True, False]
        assert (values[0] == values[1]).mean() == pytest.approx(0.5, abs=0.25 if size == 4 else 0.1)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(50, 90)] + [(7, 1000 + i) for i in range(300)] + [(3, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 50 for i in range(50, 91)} | {1000 + i: 7 for i in range(300)} | {7: 7, 3: 3}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
