import random

import brute
import pytest
from pyspark.sql import functions as F

from audira.llm import mixing
from audira.llm.mixing import Mix, mix_report, mixed
from audira.llm.quality import HostRules, beta_prior, keep_good, quality_report

ODD = [None, "", " \t\n", "one", "a b\nc d\n\na b\n", "x\x00y \x1c é ü # ## <b>", "a b c a b c", "w " * 60, "é" * 3000000 + " end", "\n".join(f"l {i} {i}" for i in range(20000)), "a b a b a b"]


def texts(n, seed):
    pick = random.Random(seed)
    words = ["the", "of", "x", "Häuser", "###", "a\nb", "a", "\n", "\r\n", "z&z"]
    return ODD + ["".join(pick.choice(words) + pick.choice([" ", "  ", "\n", "\t"]) for _ in range(pick.randrange(90))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, None, [None, "s1", "s2", "é"][i % 4]) for i, t in enumerate(texts(150, 3))]


def test_counts_match_plain_code(docs_of, rows, clashing):
    got = {r.doc_id: r.asDict() for r in quality_report(clashing(docs_of(rows))).collect()}
    assert len(got) == len(rows)
    for i, text, _, _ in rows:
        want = brute.quality(text)
        assert {k: got[i][k] for k in want} == want, i
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def test_kept_rows_are_those_of_the_report(docs_of, rows, clashing):
    docs = clashing(docs_of(rows + rows[:20]))
    good = keep_good(docs)
    assert good.columns == docs.columns
    want = sorted(r.doc_id for r in quality_report(docs).where("kept").collect())
    assert sorted(r[0] for r in good.select("doc_id").collect()) == want


def test_host_rates_decide_about_soft_failures(docs_of):
    plain = " ".join(f"word{i}" for i in range(80))
    symbols = " ".join(f"word{i}###" for i in range(80))
    short = "too short"
    rows = [(i, plain, None, "good") for i in range(40)] + [(100, symbols, None, "good"), (101, symbols, None, "tiny")]
    rows += [(200 + i, short, None, "poor") for i in range(40)] + [(300 + i, plain, None, "poor") for i in range(20)] + [(400, symbols, None, "poor")]
    rows += [(1000 + i, short, None, None) for i in range(400)] + [(1500, plain, None, None)]
    got = {r.doc_id: r for r in quality_report(docs_of(rows)).collect()}
    assert got[0].kept and got[100].kept, "one soft failure is borne on a good host"
    assert got[300].kept and not got[400].kept, "on a poor host it is not"
    assert not got[1500].kept and got[1500].shrunk_rate > 0.9, "a null host is a host; a blocked one keeps nothing"
    assert got[101].shrunk_rate < 1, "a single document does not make a rate of 1"


def test_prior_is_bounded():
    rules = HostRules()
    assert beta_prior(0, 0, 0, 0.0, rules) == (1.0, 1.0)
    alpha, beta = beta_prior(10, 1000, 100, 10.0, rules)  # no spread beyond chance: as strong as allowed
    assert alpha + beta == pytest.approx(rules.max_strength)
    alpha, beta = beta_prior(2, 1000, 500, 500.0, rules)  # one host all bad, one all good
    assert alpha + beta == pytest.approx(rules.min_strength)


def test_empty_tables(docs_of):
    empty = docs_of([])
    assert quality_report(empty).collect() == [] and keep_good(empty).collect() == []
    assert mix_report(empty).collect() == [] and mixed(empty).collect() == []


def test_mix_meets_its_targets(docs_of, clashing):
    pick = random.Random(5)
    rows = [(i, " ".join(["w"] * pick.randrange(1, 40)), None, pick.choice(["a"] * 60 + ["b"] * 20 + ["c", "d", None])) for i in range(3000)]
    rows += [(9000, None, None, "a"), (9001, "", None, "zero"), (9002, None, None, "zero")]
    docs = clashing(docs_of(rows))
    got = mix_report(docs).collect()
    size = {i: len(brute.WORD.findall(t or "")) for i, t, _, _ in rows}
    by_source = {}
    for i, _, _, s in rows:
        by_source[s] = by_source.get(s, 0) + size[i]
    want = brute.mix_targets(by_source)
    source = {i: s for i, _, _, s in rows}
    taken = dict.fromkeys(by_source, 0)
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == by_source[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= 40, s
    assert sum(taken.values()) == pytest.approx(sum(by_source.values()), rel=0.01)
    assert sorted(mix_report(docs).collect()) == sorted(got), "reruns agree"
    copies = {r.doc_id: r.n for r in mixed(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in got:
        if r["size"]:
            assert copies.get(r.doc_id, 0) * r["size"] == r.taken
    assert mixed(docs).columns == docs.columns


def test_smaller_budgets_nest(docs_of):
    rows = [(i, "w " * (i % 17 + 1), None, "ab"[i % 2]) for i in range(800)]
    few, many = ({r.doc_id: r.taken for r in mix_report(docs_of(rows), mix=Mix(share=s)).collect()} for s in (0.3, 0.6))
    assert all(few[i] <= many[i] for i in few)


def test_repeated_rows_go_together(docs_of):
    rows = [(1, "a b c", None, "s")] * 5 + [(None, "x y", None, "t")] * 3
    got = mix_report(docs_of(rows)).collect()
    assert len({r.taken for r in got if r.doc_id == 1}) == 1 and len(got) == 8


def test_no_row_is_taken_more_often_than_allowed(docs_of):
    """A source at its cap has nothing left: empty texts, which fit in nothing, get no further copy."""
    rows = [(i, None if i % 3 else "", None, "small") for i in range(30)] + [(100 + i, "a b c", None, "small") for i in range(5)] + [(200 + i, "w " * 50, None, "large") for i in range(40)]
    copies = {r.doc_id: r.n for r in mixed(docs_of(rows)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert max(copies.values()) <= Mix().max_copies
    assert all(copies.get(100 + i) == 3 for i in range(5))


def test_sources_are_not_numbered_in_one_task(spark, monkeypatch):
    """Sources may be domains: weights follow their order without a window over all of them."""
    plans, settle = [], mixing.settle
    monkeypatch.setattr(mixing, "settle", lambda df: plans.append(df._jdf.queryExecution().toString()) or settle(df))
    names = [f"s{k:04}" for k in range(2000)] + [None]
    rows = spark.createDataFrame([(s, 5) for s in reversed(names)], "source string, size long").repartition(5)
    got = {r.source: r.weight for r in mixing.targets(rows).collect()}
    assert got == {s: mixing.Mix().weights[k % 3] for k, s in enumerate(names)}
    assert plans and not any("row_number" in p for p in plans)
