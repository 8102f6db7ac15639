"""Work that must not grow faster than the tables: ranges, timers, scans and shuffled rows."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audira.operators import cutoffs, ordering, persons
from audira.sources import bindings as b
from audira.sources import tables
from audira.specs import MetricSpec, ViewRouting
from audira.streaming import jobs
from test_plans import plan_of


@pytest.mark.parametrize("kind", ["ranks", "positions"])
def test_each_range_is_one_task(spark, kind):
    """AQE may not merge ranges: it would leave about one for each core, however large the table."""
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    out = ordering.with_ranks(rows, "v", ["g"]) if kind == "ranks" else ordering.with_position(rows, ["g"], [F.col("v"), F.col("id")])
    n = spark.conf.get("spark.sql.shuffle.partitions")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "direct_shuffle_partition_id(_range" in plan and f", {n}), REPARTITION_BY_NUM" in plan
    assert out.count() == 500


class Held:
    """A state value or list, in memory."""

    def __init__(self):
        self.rows = None

    def exists(self):
        return self.rows is not None

    def get(self):
        return self.rows

    def update(self, value):
        self.rows = value

    def put(self, values):
        self.rows = values

    def appendList(self, values):  # noqa: N802
        self.rows = [*(self.rows or []), *values]

    def clear(self):
        self.rows = None


class Handle:
    def __init__(self):
        self.timers, self.registered = set(), 0

    def getValueState(self, *_):  # noqa: N802
        return Held()

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.registered += 1

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def test_one_timer_decides_all_rows_behind_the_watermark():
    handle, start = Handle(), dt.datetime(2024, 1, 1)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("t", T.TimestampType())])
    job = jobs.FirstInHorizon(dt.timedelta(days=2), schema, "t")
    job.init(handle)
    rows = [Row(id=1, n=k, t=start + dt.timedelta(hours=6 * k)) for k in range(100)]
    list(job.handleInputRows((1,), iter(rows[::-1]), None))
    assert len(handle.timers) == 1 and handle.registered == 1
    (at,) = handle.timers
    handle.timers.clear()
    upto = jobs._millis(rows[80].t)
    out = list(job.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: upto), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    assert [r.n for r in out] == list(range(0, 80, 8))
    assert handle.timers == {upto + 1} and len(job.waiting.get()) == 20


def test_prelaunch_features_come_from_stored_cells(spark, sf_dir):
    """One scan of the fact, then only cells: before, features, launch week and launch scores each joined and shuffled it."""
    for name in ("prelaunch_features_full", "prelaunch_features_cutoff", "ridge_all_features"):
        assert "lineitem.parquet" not in plan_of(spark, sf_dir, name)


def test_kpis_of_a_cell_share_a_row(spark, sf_dir):
    fact = b.metric_long(spark, sf_dir, ["rating", "home", "audience"])
    sums = cutoffs.kpi_sums(fact, list(b.DETAIL[:4]), b.ROUTING)
    keys = ["entity_id", "step_no", "week_no"]
    assert sums.count() == fact.select(*keys).distinct().count()
    cells = cutoffs.kpi_cells(sums, ["entity_id"], list(b.DETAIL[:4]))
    got = {r.kpi: (r.s, r.n) for r in cells.groupBy("kpi").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    want = fact.where("metric = 'audience' AND media = 'LIVE' AND value <> 0").agg(F.sum("value"), F.count("value")).first()
    assert got["live_uv"] == tuple(want) and set(got) == {s.kpi for s in b.DETAIL[:4]}


@pytest.mark.parametrize("kind", ["ranks", "positions"])
def test_rows_meet_the_totals_of_ranges_without_a_shuffle(spark, kind):
    """The totals are stored, so Spark knows that they are small; before, all rows were shuffled to meet them."""
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    out = ordering.with_ranks(rows, "v", ["g"]) if kind == "ranks" else ordering.with_position(rows, ["g"], [F.col("v"), F.col("id")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange") - plan.count("BroadcastExchange") == 1


def test_a_record_reads_one_table_of_pairs(spark, sf_dir, monkeypatch):
    from audira.plans import person_queries

    calls, pairs = [], b.work_person
    monkeypatch.setattr(person_queries.b, "work_person", lambda *a: calls.append(a) or pairs(*a))
    plan_of(spark, sf_dir, "person_record_json")
    assert len(calls) == 1
    first = persons.person_work_summary(pairs(spark, sf_dir), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in first and "_salt" not in first


def test_weeks_of_a_pair_are_counted_in_one_shuffle(spark, tmp_path):
    line = [(1, 1, 10.0, dt.datetime(2024, 1, 1)), (1, 2, 5.5, dt.datetime(2024, 1, 7)), (2, 1, 1.25, dt.datetime(2024, 1, 8)), (2, 1, 2.0, None), (3, 1, 4.0, None)]
    full = [(o, p, 1, i, 1.0, price, 0.0, 0.0, "A", "F", day) for i, (o, p, price, day) in enumerate(line)]
    orders = [(1, 7, "F", 1.0, None, "1"), (2, 7, "F", 1.0, None, "1"), (3, None, "F", 1.0, None, "1")]
    parts = [(1, "n", "x", "t", 1, 1.0), (2, "n", None, "t", 1, 1.0)]
    for name, rows in (("lineitem", full), ("orders", orders), ("part", parts)):
        spark.createDataFrame(rows, b.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.person, r.work): (r.person_buzz, r.weeks_ranked, r.rank_in_work, r.persons_ranked, r.work_buzz) for r in b.work_person(spark, str(tmp_path)).collect()}
    assert got == {(7, "x"): (13.25, 2.0, 1.0, 2.0, 17.25), (None, "x"): (4.0, 0.0, 2.0, 2.0, 17.25), (7, None): (5.5, 1.0, 1.0, 1.0, 5.5)}


def test_places_of_similar_persons_are_stored(spark, sf_dir):
    """Asks and answers both read them; before, each cut the ranges' rows again."""
    assert "direct_shuffle_partition_id" not in plan_of(spark, sf_dir, "similar_persons")


def test_best_persons_are_shuffled_once(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "top_n_per_group")
    assert "_salt" not in plan and plan.count("hashpartitioning(gender") == 1


def test_peers_are_met_without_sorting_the_fact(spark, sf_dir):
    for name in ("peer_group", "peer_group_variants"):
        plan = plan_of(spark, sf_dir, name)
        semi = [line for line in plan.splitlines() if "LeftSemi" in line]
        assert semi and all("ShuffledHashJoin" in line for line in semi)


def test_lines_are_split_once_whatever_is_asked(spark, tmp_path):
    for i, text in enumerate(["\n", " \n\n", "", "person,work\np,w\n", "person,work\nq,w\n,w\n"]):
        (tmp_path / f"{i} a.csv").write_text(text)
    raw, _ = tables.read_ragged(spark, str(tmp_path / "*.csv"))
    rows = raw.where("person <> '' AND work <> ''")
    assert sorted(map(tuple, rows.collect())) == [("p", "w"), ("q", "w")]
    assert rows._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1


PEER_SPECS = [
    MetricSpec("mean", "a"),
    MetricSpec("step_sum", "a", "step_sum", ("X",)),
    MetricSpec("vod", "b", "vod", ("Y", "X")),
    MetricSpec("step_least", "b", "min", high_is_good=False),
    MetricSpec("least", "C-c", "min", cutoff="week", high_is_good=False, normalized=True),
    MetricSpec("sum", "b", "sum", cutoff="week"),
    MetricSpec("views", "v", "sum", views="total", cutoff="week"),
    MetricSpec("flat", "b", "flat_mean", ("X",), cutoff="week"),
    MetricSpec("buzz", "B!", cutoff="week", keep_zero=True, normalized=True, group_mode="rows"),
]
PEER_ROUTING = ViewRouting("v", "ko", "en", "X", ("PGC",))


def peers_of(rows, dim):
    """Each entity against the rows of its peers up to its own cutoff, pair by pair."""

    def clean(name):
        return "".join(x for x in name if x.isalnum()).lower()

    def chosen(s, r):
        if s.views:
            ok = r["metric"] == "v" and (r["attr3"] == "en" or (r["attr3"] == "ko" and (r["media"] != "X" or r["attr1"] == "PGC")))
        elif s.normalized:
            ok = clean(r["metric"] or "") == clean(s.metric)
        else:
            ok = r["metric"] == s.metric
        return ok and (not s.media or r["media"] in s.media)

    def value(s, some):
        known = [r for r in some if r["value"] is not None and (s.keep_zero or r["value"] != 0)]
        nums = [r["value"] for r in known]
        if s.mode not in cutoffs.STEPPED:
            out = {"sum": sum, "min": min, "flat_mean": lambda x: sum(x) / len(x)}[s.mode](nums) if nums else None
        else:
            steps = {}
            for r in known:
                if r["step_no"] is not None:
                    steps.setdefault(r["step_no"], []).append(r)
            if s.mode == "vod":
                steps = {k: x for k, x in steps.items() if any(r["media"] == s.media[0] for r in x)}
            means = [sum(r["value"] for r in x) / (len(x) if s.mode == "mean" else 1) for x in steps.values()]
            out = sum(means) / len(means) if means else None
        return None if out is None else round(out, 6)

    out = {}
    for s in PEER_SPECS:
        mine = {e: [r for r in rows if r["entity_id"] == e and chosen(s, r)] for e in dim}
        for e, some in mine.items():
            whole = value(s, some)
            if whole is None:
                continue
            weeks = [r["week_no"] for r in some if s.cutoff == "week" and r["week_no"] is not None]
            steps = [r["step_no"] for r in some if r["step_no"] is not None]
            kind, name, cut = ("week", "week_no", max(weeks)) if weeks else ("step", "step_no", max(steps)) if steps else ("all", None, None)
            until = {p: [r for r in x if not name or (r[name] is not None and r[name] <= cut)] for p, x in mine.items() if dim[p] == dim[e]}
            at = {p: value(s, x) for p, x in until.items()}
            known = [x for x in at.values() if x is not None]
            mean = sum(known) / len(known) if known else None
            if s.group_mode == "rows":
                mean = value(s, [r for x in until.values() for r in x])
            better = None if at[e] is None else 1 + sum(x > at[e] if s.high_is_good else x < at[e] for x in known)
            out[e, s.kpi] = (dim[e], kind, cut, whole, mean, better, len(known))
    return out


@pytest.mark.parametrize("word", [31, 2])
def test_peers_at_own_cutoffs_match_pairs(spark, monkeypatch, word):
    """Entities without weeks, without steps and without either; null groups, metrics and values; KPIs in several words of bits."""
    monkeypatch.setattr(cutoffs, "WORD", word)
    pick = random.Random(4)
    dim = {e: pick.choice(["g", "g", "h", None]) for e in range(60)}
    rows = []
    for e in dim:
        first, last, shape = pick.choice([1, 1, 3]), pick.choice([4, 4, 5, 7]), pick.random()
        for _ in range(pick.choice([1, 4, 25])):
            rows.append(
                {
                    "entity_id": e,
                    "step_no": None if shape < 0.1 or pick.random() < 0.1 else pick.randint(first, last),
                    "week_no": None if shape > 0.8 or shape < 0.05 or pick.random() < 0.5 else pick.randint(-2, last - 3),
                    "metric": pick.choice(["a", "b", "c c", "CC", "v", "b!", "other", None]),
                    "media": pick.choice(["X", "Y", None]),
                    "attr1": pick.choice(["PGC", "ETC"]),
                    "attr3": pick.choice(["ko", "en", None]),
                    "value": pick.choice([None, 0.0, 1.0, 2.0, 0.25 * pick.randint(-4, 40)]),
                }
            )
    rows += [dict(rows[0], entity_id=None), dict(rows[0], entity_id=999)]
    schema = "entity_id int, step_no int, week_no int, metric string, media string, attr1 string, attr3 string, value double"
    fact = spark.createDataFrame([Row(**r) for r in rows], schema)
    groups = spark.createDataFrame([*dim.items(), (None, "g"), (1000, "h")], "entity_id int, slot string")
    got = cutoffs.kpi_vs_group(fact, PEER_SPECS, groups, "slot", PEER_ROUTING).collect()
    want = peers_of(rows, dim)
    assert {r.kind for r in got} == {"week", "step", "all"} and len(got) == len(want)
    for r in got:
        *exact, mean, rank, size = want[r.entity_id, r.kpi]
        assert [r.slot, r.kind, r.cutoff, r.value] == exact and (r.rank, r.group_size) == (rank, size)
        assert r.group_value == (None if mean is None else pytest.approx(mean, abs=2e-6))
        assert r.ratio == (pytest.approx(r.value * 100 / r.group_value) if r.group_value else None)


def test_peers_are_ranked_where_their_rows_are(spark, sf_dir):
    """Only values between the splits of a cutoff are shuffled; before, all were, and the ranks were joined back by entity."""
    assert "hashpartitioning(entity_id" not in plan_of(spark, sf_dir, "kpi_vs_group")


def test_an_entity_is_moved_to_its_task_once(spark, sf_dir):
    """Once for its steps and once for its rows with a week; before, a row went several ways for each KPI and kind of cutoff."""
    specs = list(b.DETAIL_PAGE)
    sums = cutoffs.kpi_sums(b.metric_long(spark, sf_dir, ["rating", "buzz"], title=True), specs, b.ROUTING).withColumn("slot", F.lit("s"))
    plan = cutoffs.entity_curves(ordering.settle(sums), "slot", specs, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity_id") == plan.count("Exchange") == 2
