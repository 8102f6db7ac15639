"""Streams replayed from files, with rows out of order and late."""

import datetime as dt

from pyspark.sql import functions as F

from audira.streaming import jobs


def write_batches(spark, folder, batches):
    """One file per batch, in order of arrival."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(n, t, u, k, v, None) for n, t, u, k, v in rows], jobs.EVENT)
        df.coalesce(1).write.parquet(f"{folder}/b{i}")
    return f"{folder}/b*"


def replay(spark, pattern):
    return spark.readStream.schema(jobs.EVENT).option("maxFilesPerTrigger", 1).parquet(pattern)


def run(stream, folder):
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    writer.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day - 1, hours=hour, minutes=minute)


def test_daily_views_equal_the_batch_on_confirmed_days(spark, tmp_path):
    batches = [
        [(1, at(1, 5), 1, "a", 1.0), (2, at(2, 5), 1, "a", 2.0)],
        [(3, at(1, 9), 1, "a", 4.0), (4, at(3, 5), 1, "b", 8.0)],  # day 1 again, still inside 48 hours
        [(5, at(6, 5), 1, "a", 16.0)],
        [(7, at(6, 6), 1, "a", 64.0)],
        [(6, at(1, 7), 1, "a", 32.0)],  # far too late: dropped
    ]
    pattern = write_batches(spark, tmp_path / "in", batches)
    got = run(jobs.stream_daily_views(replay(spark, pattern), "event_type"), tmp_path)
    rows = {(r.day.day, r.event_type): r.views for r in got.collect()}
    assert rows == {(1, "a"): 5.0, (2, "a"): 2.0, (3, "b"): 8.0}
    on_time = spark.read.schema(jobs.EVENT).parquet(pattern).where("event_id <> 6")
    batch = jobs.confirmed_days(jobs.stream_daily_views(on_time, "event_type"), at(6, 6))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, got.collect()))


def test_dedup_within_the_rescan_period(spark, tmp_path):
    batches = [[(1, at(1), 1, "a", 1.0)], [(1, at(3), 1, "a", 1.0), (2, at(3), 1, "a", 1.0)], [(2, at(4), 1, "a", 1.0)]]
    pattern = write_batches(spark, tmp_path / "in", batches)
    stream = replay(spark, pattern).select(F.col("event_id").alias("id"), F.col("ts").alias("published_at"))
    got = run(jobs.stream_catalog_dedup(stream), tmp_path)
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_sessions_end_after_idle_time(spark, tmp_path):
    batches = [
        [(1, at(1, 1), 7, "a", 0.0), (2, at(1, 2, 30), 7, "a", 0.0)],
        [(3, at(1, 2), 7, "a", 0.0), (4, at(1, 8), 7, "a", 0.0)],
        [(5, at(2), 8, "a", 0.0)],
        [(6, at(2, 1), 8, "a", 0.0)],
    ]
    got = run(jobs.stream_user_sessions(replay(spark, write_batches(spark, tmp_path / "in", batches))), tmp_path)
    rows = sorted((r.session_start, r.session_end, r.events) for r in got.collect())
    assert rows == [(at(1, 1), at(1, 4, 30), 3), (at(1, 8), at(1, 10), 1)]


def test_ingest_stops_at_the_cap(spark, tmp_path):
    batches = [[(b * 10 + i, at(1), 1, "a", 0.0) for i in range(4)] for b in range(4)]
    stream = replay(spark, write_batches(spark, tmp_path / "in", batches)).select("event_id")
    out = str(tmp_path / "out")
    jobs.stream_capped_ingest(stream, out, str(tmp_path / "cp"), 6, ["event_id"]).awaitTermination()
    assert spark.read.parquet(out).count() == 8


REFRESH = "id long, source_file string, title string, updated_at timestamp_ntz"


def test_refresh_merges_changed_rows(spark, tmp_path):
    """New and changed rows replace those of their key; other hours, runs without arrivals and replays change nothing."""
    out, ledger, state = (str(tmp_path / x) for x in ("out", "ledger", "cp"))

    def arrive(rows):
        spark.createDataFrame(rows, REFRESH).write.mode("append").parquet(str(tmp_path / "in"))

    def run(hour, checkpoint=state):
        stream = spark.readStream.schema(REFRESH).parquet(str(tmp_path / "in"))
        started = jobs.scheduled_refresh(stream, out, ledger, checkpoint, at(1, hour))
        if started is not None:
            started.awaitTermination()
        return started

    def held():
        return sorted((r.id, r.source_file, r.title) for r in jobs.read_refreshed(spark, out, ledger, spark.createDataFrame([], REFRESH).schema).collect())

    arrive([(1, "a", "old", at(1)), (1, "a", "newer", at(2)), (2, "a", "two", at(1)), (1, "b", "other", at(1))])
    assert run(10) is None and run(9) is not None
    assert held() == [(1, "a", "newer"), (1, "b", "other"), (2, "a", "two")]
    arrive([(1, "a", "changed", at(3)), (3, "c", "three", at(3))])
    run(12)
    want = [(1, "a", "changed"), (1, "b", "other"), (2, "a", "two"), (3, "c", "three")]
    assert held() == want
    run(18)  # nothing arrived
    assert held() == want and jobs.read_ledger(spark, ledger).count() == 2
    run(18, str(tmp_path / "again"))  # a lost checkpoint replays batch 0: its ledger row keeps it out
    assert held() == want and jobs.read_ledger(spark, ledger).count() == 2
    assert jobs.is_refresh_hour(at(1, 9)) and not jobs.is_refresh_hour(at(1, 10))


def first_in_horizon(rows, known, days=7):
    """Plain code: of each id the rows at least ``days`` after the last one let through."""
    out, last = [], dict(known)
    for t, i, n in sorted((t, i, n) for n, t, i in rows):
        if i not in last or t >= last[i] + dt.timedelta(days=days):
            out.append((i, n))
            last[i] = t
    return sorted(out)


def test_news_do_not_depend_on_the_batches(spark, tmp_path):
    """One batch and one file per batch give the same rows; known ids are repeats until their horizon has passed."""
    rows = [(n, at(1 + (n * 7) % 23, n % 24, n), n % 5) for n in range(40)]
    rows.sort(key=lambda r: r[1])
    batches = [[(n, t, i, "a", 0.0) for n, t, i in rows[k : k + 8]] for k in range(0, 40, 8)]
    batches[1], rows = batches[1][::-1], rows  # out of order inside a batch
    end = [(99, at(60), 9, "a", 0.0)]  # moves the watermark past all others
    pattern = write_batches(spark, tmp_path / "in", [*batches, end])
    known = [(0, at(1)), (1, at(3))]
    cached = spark.createDataFrame(known, "id long, last timestamp_ntz")
    want = first_in_horizon(rows, known)
    for k, files in enumerate((1, 100)):
        stream = spark.readStream.schema(jobs.EVENT).option("maxFilesPerTrigger", files).parquet(pattern)
        stream = stream.select(F.col("user_id").alias("id"), F.col("event_id").alias("n"), F.col("ts").alias("published_at"))
        got = run(jobs.stream_catalog_news(stream, cached, lag="1 hour"), tmp_path / f"r{k}").where("n <> 99")
        assert sorted((r.id, r.n) for r in got.collect()) == want
