"""Ranks, positions and group values against DuckDB: null groups, heavy ties, null values, no groups."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from audira.operators import ordering


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(1)
    groups = ["a"] * 300 + ["b"] * 20 + [None] * 120 + ["c"]
    return pd.DataFrame([(i, g, pick.choice([1.0] * 8 + [None, 2.0, 3.0, float(i)])) for i, g in enumerate(groups)], columns=["id", "g", "v"])


@pytest.fixture(scope="module")
def df(spark, rows):
    clean = [(int(i), g, None if pd.isna(v) else float(v)) for i, g, v in rows.itertuples(index=False)]
    return spark.createDataFrame(clean, "id long, g string, v double").repartition(4).cache()


def same(got, sql, rows):
    names = sorted(got.columns)
    want = duckdb.sql(sql.replace("FROM t", "FROM rows")).df()[names]

    def cells(frame):
        return sorted((tuple(None if x is None or x != x else round(float(x), 9) if not isinstance(x, str) else x for x in r) for r in frame), key=repr)

    assert cells(tuple(r[n] for n in names) for r in got.collect()) == cells(want.astype(object).where(want.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("groups", [["g"], []])
def test_every_function_matches_sql(df, rows, groups):
    by, only = ("PARTITION BY g", "g") if groups else ("", "1")
    got = ordering.with_group_values(df, groups, {"m": F.avg("v"), "n": F.count("*")})
    same(got, f"SELECT *, avg(v) OVER ({by}) AS m, count(*) OVER ({by}) AS n FROM t", rows)
    got = ordering.running_sums(df, groups, [F.col("id")], F.coalesce("v", F.lit(0.0)), "before", "total")
    same(
        got,
        f"SELECT *, coalesce(sum(coalesce(v, 0)) OVER ({by} ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,"
        f" sum(coalesce(v, 0)) OVER ({by}) AS total FROM t",
        rows,
    )
    got = ordering.with_position(df, groups, [F.col("id").desc()], size="n")
    same(got, f"SELECT *, row_number() OVER ({by} ORDER BY id DESC) AS position, count(*) OVER ({by}) AS n FROM t", rows)
    got = ordering.with_ranks(df, "v", groups)
    known = "CASE WHEN v IS NOT NULL THEN"
    same(
        got,
        f"SELECT *, count(v) OVER ({by}) AS n, {known} rank() OVER ({by} ORDER BY v NULLS LAST) END AS rank_asc,"
        f" {known} rank() OVER ({by} ORDER BY v DESC NULLS LAST) END AS rank_desc,"
        f" {known} count(v) OVER (PARTITION BY {only}, v) END AS ties FROM t",
        rows,
    )
    got = ordering.with_percentrank_inc(df, {"v": "p"}, groups)
    same(
        got,
        f"SELECT *, CASE WHEN count(*) OVER ({by}) <= 1 THEN 1.0 {known[5:]} (rank() OVER ({by} ORDER BY v NULLS LAST) - 1) / (count(*) OVER ({by}) - 1) END AS p FROM t",
        rows,
    )
    got = ordering.keep_top(df, groups, [F.col("v").desc_nulls_last(), F.col("id")], 3, salts=4)
    same(got, f"SELECT * FROM t QUALIFY row_number() OVER ({by} ORDER BY v DESC NULLS LAST, id) <= 3", rows)


def test_ranks_of_several_columns_side_by_side(df, rows):
    both = df.withColumn("u", F.col("id") % 7)
    got = ordering.with_percentrank_inc(both, {"v": "p", "u": "q"}, ["g"], key="id")
    rows = rows.assign(u=rows["id"] % 7)
    pct = "CASE WHEN count(*) OVER (PARTITION BY g) <= 1 THEN 1.0 WHEN {0} IS NOT NULL THEN (rank() OVER (PARTITION BY g ORDER BY {0} NULLS LAST) - 1) / (count(*) OVER (PARTITION BY g) - 1) END"
    want = duckdb.sql(f"SELECT *, {pct.format('v')} AS p, {pct.format('u')} AS q FROM rows").fetchall()
    key = lambda r: r[0]
    flat = [tuple(None if x is None or x != x else round(float(x), 9) if not isinstance(x, str) else x for x in r) for r in sorted(want, key=key)]
    mine = [tuple(None if x is None else round(float(x), 9) if not isinstance(x, str) else x for x in r) for r in sorted(got.select("id", "g", "v", "u", "p", "q").collect(), key=key)]
    assert mine == flat


def test_weights_of_smaller_and_equal_values(spark):
    """Weights may be negative or 0; ties run over many partitions."""
    pick = random.Random(2)
    rows = [(i, pick.choice("ab"), pick.choice([1, 1, 1, 2, 5, None]), pick.choice([-1, 0, 1, 3])) for i in range(600)]
    got = ordering.weights_around(spark.createDataFrame(rows, "i int, g string, v int, w int").repartition(6), ["g"], "v", F.col("w"))
    for r in got.collect():
        known = [x for x in rows if x[1] == r.g and x[2] is not None]
        assert r.total == sum(x[3] for x in known)
        if r.v is not None:
            assert (r.less, r.equal) == (sum(x[3] for x in known if x[2] < r.v), sum(x[3] for x in known if x[2] == r.v))
    assert got.count() == len(rows)


def test_a_hot_tie_is_spread_over_the_tasks(spark):
    """Half of the rows share one value: in no stage of the plan does a partition hold much more than the others."""
    n, parts = 40_000, 8
    rows = spark.range(n, numPartitions=parts).withColumn("v", F.when(F.col("id") % 2 == 0, F.lit(0.5)).otherwise(F.rand(3)))
    ranked = ordering.with_ranks(rows, "v", [])
    text = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in text and "_range" in text
    joins = [line for line in text.splitlines() if "Join " in line]
    assert joins and all("_range" in line and "(v#" not in line for line in joins)
    sizes = [len(p) for p in ranked.select("rank_asc").rdd.glom().collect() if p]
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2] or len(sizes) == 1
    assert {r.ties for r in ranked.where("v = 0.5").select("ties").distinct().collect()} == {n // 2}


def test_smaller_values_of_a_key(spark):
    """Keys with few asks, with many, and with values that many share; asks without a value, asks beyond all values."""
    pick = random.Random(3)
    draw = {0: lambda: pick.choice([-1.5, 0.0, 2.0]), 1: lambda: pick.gauss(0, 1), 2: lambda: pick.choice([0.0, pick.random()]), 3: lambda: pick.random()}
    values = [(k, draw[k]()) for k in draw for _ in range(900)] + [(4, 1.0)]
    asks = [(i, k, pick.choice([None, draw[k](), draw[k](), draw[k](), 9.0, -9.0])) for i, k in enumerate([0, 1, 2] * 400 + [3] * 5)] + [(-1, 4, None)]
    parts = [spark.createDataFrame(rows, t).repartition(5).cache() for rows, t in ((asks, "id int, k int, v double"), (values, "k int, v double"))]
    got, sums = ordering.smaller_values(*parts, "k", "v", "less", {"n": F.count("v"), "s": F.sum(F.col("v").cast("decimal(30,12)"))})
    want = {(i, k, v, None if v is None else sum(x < v for q, x in values if q == k)) for i, k, v in asks}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(asks)
    for k, n, s in sums.collect():
        mine = [x for q, x in values if q == k]
        assert n == len(mine) and abs(float(s) - sum(mine)) < 1e-8
    assert {r.k for r in sums.collect()} == {0, 1, 2, 3, 4}


def test_only_values_between_splits_are_shuffled(spark):
    """Half of the values are shared, and a key has few asks: what its counts answer is not moved."""
    values = spark.range(4000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 4 == 0, F.lit(0.5)).otherwise(F.rand(3)).alias("v")).cache()
    asks = values.where("k = 0 OR v < 0.01")
    got, _ = ordering.smaller_values(asks, values, "k", "v", "less", {"n": F.count("v")})
    moved = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == asks.count() and "LeftSemi" in moved
    placed = ordering._in_buckets(values.where("k = 0"), asks.groupBy("k").agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000).alias("_splits")), "k", "v")
    open_rows = placed.where("_bucket % 2 = 0").groupBy("_bucket").count().collect()
    assert sum(r["count"] for r in open_rows) < 1000 and max(r["count"] for r in open_rows) < 100
