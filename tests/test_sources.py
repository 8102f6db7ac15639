"""Loaders, storage and nested pages."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from audira.operators import ordering
from audira.sources import catalog, tables


def test_sheet_round_trip(spark, tmp_path):
    (tmp_path / "fact.csv").write_text(
        "entity_id,slot,step_text,week_label,week_start,metric,value\n"
        ' a , 월화,12화,W-6,2024. 1. 5,views,"1,234"\n'
        "b,수목,last,W+1,soon,rating,3.5%\n"
        "c,토일,3화\n"
    )
    df = tables.load_metric_long(tables.read_sheet(spark, str(tmp_path / "fact.csv")))
    rows = {r.entity_id: r for r in df.collect()}
    assert df.columns == tables.METRIC_LONG.names
    assert (rows["a"].step_no, rows["a"].week_no, rows["a"].week_start, rows["a"].value) == (12, -6, dt.date(2024, 1, 5), 1234.0)
    assert (rows["b"].step_no, rows["b"].week_start, rows["b"].value) == (None, None, 3.5)
    assert rows["c"].value == 0.0 and rows["c"].start_date is None


def test_ragged_table(spark, tmp_path):
    head = " person ,work,work_buzz,person_buzz,weeks_ranked,persons_ranked,rank_in_work,"
    (tmp_path / "t.csv").write_text(f'{head}\np,w,"1,000",x,2,3,1,extra,cut\n ,w,1,1,1,1,1\nq,v,5\n')
    df = tables.load_ragged_table(tables.read_sheet(spark, str(tmp_path / "t.csv")))
    rows = {r.person: r for r in df.collect()}
    assert set(rows) == {"p", "q"}
    assert rows["p"].work_buzz == 1000.0 and rows["p"].person_buzz is None and rows["q"].weeks_ranked is None


def test_blank_headers_get_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" a ", " ", "_c2"])
    assert tables.named_header(df).columns == ["a", "unnamed_2", "unnamed_3"]


def test_missing_column_fails_before_any_job(spark):
    with pytest.raises(ValueError, match="work_buzz"):
        tables.load_ragged_table(spark.createDataFrame([("p", "w")], ["person", "work"]))


def test_person_dim_first_row_wins(spark):
    rows = [("p", "여성", "1990", 2), ("p ", "M", "1980", 1), ("", "M", "1980", 3), ("q", "?", "x", 4)]
    raw = spark.createDataFrame(rows, "person string, gender_text string, birth_year string, line int")
    got = {r.person: r for r in tables.load_person_dim(raw, 2026, order="line").collect()}
    assert set(got) == {"p", "q"}
    assert (got["p"].gender, got["p"].age, got["p"].age_group) == ("남", 47, "40대")
    assert (got["q"].gender, got["q"].age_group) == ("미상", "미상")


def video(i, source="s", title="t", day=1):
    return (str(i), title, "d", dt.datetime(2024, 1, day), source)


def test_sync_is_idempotent(spark):
    cached = spark.createDataFrame([video(1), video(2)], catalog.VIDEO)
    last = spark.createDataFrame([("s", dt.datetime(2024, 1, 10))], "source_file string, updated_at timestamp_ntz")
    new = spark.createDataFrame([video(2, title="changed", day=9), video(3, day=9), video(4, day=2), video(5, "other", day=2)], catalog.VIDEO)
    new = new.withColumns({"upload_at": F.col("published_at"), "privacy": F.lit("public")})
    as_of = dt.datetime(2024, 1, 12)
    once = catalog.incremental_catalog_sync(new, cached, last, as_of)
    rows = {(r.source_file, r.id): r.title for r in once.collect()}
    assert rows == {("s", "1"): "t", ("s", "2"): "t", ("s", "3"): "t", ("other", "5"): "t"}
    twice = catalog.incremental_catalog_sync(new, once, last, as_of)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_overwrite_touches_only_its_partitions(spark, tmp_path):
    path, meta = str(tmp_path / "v"), str(tmp_path / "m")
    when = dt.datetime(2024, 1, 1)
    catalog.overwrite_partition(spark.createDataFrame([video(1, "a"), video(2, "b")], catalog.VIDEO), path, meta, when, "first")
    later = when + dt.timedelta(days=1)
    catalog.overwrite_partition(spark.createDataFrame([video(3, "a")], catalog.VIDEO), path, meta, later, "second")
    table = catalog.read_catalog(spark, path)
    assert sorted((r.source_file, r.id) for r in table.collect()) == [("a", "3"), ("b", "2")]
    latest = {r.source_file: (r["count"], r.last_source) for r in catalog.latest_metadata(spark.read.parquet(meta)).collect()}
    assert latest == {"a": (1, "second"), "b": (1, "first")}
    plan = catalog.scan_catalog_partition(table, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_file" in plan


def test_capped_append(spark, tmp_path):
    rows = [(v, f"{v}-{i}", i) for v in (1, 2, 3) for i in range(4)]
    df = spark.createDataFrame(rows, "video_id int, comment_id string, turn int")
    path = str(tmp_path / "c")
    kept = catalog.append_capped_csv(df, [F.col("turn")], per_video=3, total=4, path=path)
    assert sorted(r.comment_id for r in kept.collect()) == ["1-0", "1-1", "1-2", "2-0", "2-1", "2-2"]
    assert spark.read.option("header", True).csv(path).count() == 6


def test_pages_with_missing_parts(spark):
    thread = {
        "snippet": {"videoId": "v", "totalReplyCount": 1, "topLevelComment": {"id": "t", "snippet": {"textDisplay": "hi", "likeCount": 3}}},
        "replies": {"comments": [{"id": "r", "snippet": {"authorDisplayName": "a", "textDisplay": "yo"}}]},
    }
    quiet = {"snippet": {"videoId": "v", "totalReplyCount": 0, "topLevelComment": {"id": "q", "snippet": {}}}}
    df = spark.createDataFrame([(json.dumps({"items": [thread, quiet]}),)], "body string")
    got = {r.comment_id: r for r in catalog.flatten_comment_threads(df).collect()}
    assert set(got) == {"t", "r", "q"}
    assert (got["r"].parent_id, got["r"].isReply, got["r"].likeCount) == ("t", 1, 0)
    assert (got["t"].likeCount, got["q"].text) == (3, "")
    assert catalog.flatten_comment_threads(df, include_replies=False).count() == 2
    video_page = {"items": [{"id": "x", "statistics": {"viewCount": "7"}, "snippet": {"title": "T", "publishedAt": "odd"}, "contentDetails": {}}]}
    row = catalog.flatten_video_statistics(spark.createDataFrame([(json.dumps(video_page),)], "body string")).first()
    assert (row.viewCount, row.likeCount, row.publishedAt, row.duration, row.shortType) == (7, 0, "odd", "0:00", "Shorts")


def test_search_pushes_columns_and_dates(spark, sf_dir, tmp_path):
    from audira.sources import bindings

    path = str(tmp_path / "catalog")
    bindings.catalog(spark, sf_dir).write.parquet(path)
    hits = catalog.search_catalog_pushdown(catalog.read_catalog(spark, path), ["the"], dt.datetime(2024, 1, 5), None)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(published_at" in plan and "source_file" not in plan.split("ReadSchema")[1]


def test_period_labels(spark):
    labels = ["2024년 12월 1주차", "2024년 2월 4주차", " ", "misc"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    assert tuple(tables.period_bounds(df).first()) == ("2024년 2월 4주차", "2024년 12월 1주차")
    assert tuple(tables.period_bounds(df.where("label = 'misc'")).first()) == ("misc", "misc")


def test_ragged_lines(spark, tmp_path):
    """Short rows are padded, long ones cut, repeated headers and blank lines left out, unreadable lines set aside."""
    (tmp_path / "a.csv").write_text(' name ,,"x, y"\n1,2,3\n4\n\n5,6,7,8,9\n"q ""u""", 7 ,"a,b"\n"open,1,2\n,,\n', newline="\n")
    (tmp_path / "b.csv").write_text(' name ,,"x, y"\n10,11,12\n', newline="\n")
    rows, quarantine = tables.read_ragged(spark, str(tmp_path / "*.csv"))
    assert rows.columns == [" name ", "", "x, y"]
    assert tables.named_header(rows).columns == ["name", "unnamed_2", "x, y"]
    got = sorted((tuple(r) for r in rows.collect()), key=repr)
    want = [("1", "2", "3"), ("4", None, None), ("5", "6", "7"), ('q "u"', " 7 ", "a,b"), ("", "", ""), ("10", "11", "12")]
    assert got == sorted(want, key=repr)
    assert [(r.file[-5:], r.value) for r in quarantine.collect()] == [("a.csv", '"open,1,2')]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no header"):
        tables.read_ragged(spark, str(tmp_path / "none"))


def test_latest_rows_in_two_phases(spark):
    rows = [(i % 7 if i % 11 else None, i % 5, "text %d" % (i % 13), i % 3) for i in range(400)] * 3
    df = spark.createDataFrame(rows, "k int, o int, t string, x int").repartition(5)
    out = ordering.latest_per_key(df, ["k"], [F.col("o"), F.col("t")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan
    got = {r.k: (r.o, r.t) for r in out.collect()}
    want = {k: max((o, t) for kk, o, t, _ in rows if kk == k) for k in {r[0] for r in rows}}
    assert got == want and out.count() == len(want) and out.columns == df.columns


def test_indexed_search(spark, tmp_path):
    """The same rows as the scan; files out of the date range and row groups of other grams are not read."""
    words = ["alpha", "beta", "gamma", "delta", "Größe"]
    rows = [(str(i), f"{words[i % 5]} no {i}", None if i % 9 == 0 else f"the {words[i % 3].upper()}mix", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), f"s{i % 4}") for i in range(600)]
    videos = spark.createDataFrame(rows, catalog.VIDEO)
    path = str(tmp_path / "c")
    catalog.write_searchable(videos, path, files=6)
    start, end = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 14)
    for asked in (["alphamix"], ["betam", " gr öße "], ["no 1"], ["ma", "gamma"], ["nothing"], [], ["mix", "no"]):
        want = sorted(map(tuple, catalog.search_catalog_pushdown(videos, asked, start, end).collect()))
        got = catalog.search_indexed(spark, path, catalog.VIDEO, asked, start, end)
        assert sorted(map(tuple, got.collect())) == want
    got = catalog.search_indexed(spark, path, catalog.VIDEO, ["alphamix"], start, end)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(published_at" in plan and "In(gram" in plan
    # Files hold separate ranges of time, so the range lies in few of them.
    ranges = spark.read.parquet(f"{path}/rows").groupBy("file").agg(F.min("published_at").alias("a"), F.max("published_at").alias("b")).collect()
    assert len(ranges) == 6 and sum(r.a <= end and r.b >= start for r in ranges) <= 2
    assert {r.file for r in spark.read.parquet(f"{path}/postings").where("gram = 'pha'").select("file").distinct().collect()} == set(range(6))


def test_postings_lie_with_their_rows(spark, tmp_path):
    """One task takes the pieces of a file's rows and writes them: no shuffle of postings, no second pass for its ranges."""
    texts = ["One  two\nthree", "aaaa", "ab", None, "xÄyZ 한글", "Größe " * 3]
    rows = [(str(i), texts[i % 6], texts[(i + 1) % 6], dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "s") for i in range(120)]
    catalog.write_searchable(spark.createDataFrame(rows, catalog.VIDEO), str(tmp_path), files=5)
    stored = spark.read.parquet(f"{tmp_path}/postings").select("*", F.col("_metadata.file_path").alias("at")).collect()
    assert len({r.at for r in stored}) == 5 and len({(r.at, r.file) for r in stored}) == 5
    where = {r.id: (r.file, r.place) for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    pieces = lambda t: {t.lower()[i : i + 3] for i in range(len(t) - 2)} if t else set()
    want = sorted((g, *where[i]) for i, title, description, *_ in rows for g in pieces(title) | pieces(description))
    assert sorted((r.gram, r.file, r.place) for r in stored) == want


def test_a_bucketed_cache_is_not_shuffled(spark, tmp_path):
    rows = [(str(i), f"t{i}", "d", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), f"s{i % 3}") for i in range(300)]
    videos = spark.createDataFrame(rows, catalog.VIDEO)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    catalog.store_bucketed(videos.where("published_at < '2024-01-10'"), "cached_side", n, str(tmp_path / "t"))
    incoming = videos.withColumns({"upload_at": F.col("published_at"), "privacy": F.lit("public")})
    last = videos.groupBy("source_file").agg(F.lit(dt.datetime(2024, 1, 9)).cast("timestamp_ntz").alias("updated_at"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        out = catalog.incremental_catalog_sync(incoming, spark.table("cached_side"), last, dt.datetime(2024, 2, 1))
        lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
        assert len(out.collect()) == 300
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE cached_side")
    scans = [i for i, line in enumerate(lines) if "cached_side" in line and "Bucketed: true" in line and "isnotnull" in line]
    assert len(scans) >= 2  # the rows and their keys
    for i in scans:  # from the scan up to the join, nothing is an exchange
        depth = len(lines[i]) - len(lines[i].lstrip(" :+-"))
        for line in reversed(lines[:i]):
            here = len(line) - len(line.lstrip(" :+-"))
            if here < depth:
                depth = here
                assert "Exchange" not in line, "\n".join(lines)
                if "Join" in line:
                    break


def test_stored_sketches(spark):
    rows = spark.range(60_000).select((F.col("id") % 5).cast("string").alias("p"), F.when(F.col("id") % 97 > 0, F.col("id") % 20_011).alias("u"))
    stored = tables.distinct_sketches(rows, ["p"], {"users": F.col("u")})
    whole = tables.united_counts(stored, ["users"]).first()
    exact = rows.agg(F.count_distinct("u")).first()[0]
    assert whole.total_rows == 60_000 and abs(whole.users - exact) <= 0.03 * exact
    each = {r.p: r.users for r in tables.united_counts(stored, ["users"], ["p"]).collect()}
    for r in rows.groupBy("p").agg(F.count_distinct("u").alias("n")).collect():
        assert abs(each[r.p] - r.n) <= 0.03 * r.n
