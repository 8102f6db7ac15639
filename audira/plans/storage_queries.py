"""Queries that write and read back: catalogue partitions, logs and streaming jobs.

Everything is written below the shared checkpoint folder of the session, in a new folder per run.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from audira.operators import ordering
from audira.plans.registry import query
from audira.session import ensure_checkpoint_dir
from audira.sources import bindings as b
from audira.sources import catalog
from audira.sources.bindings import AS_OF, CATALOG_SQL, COMMENTS_SQL, with_ctes
from audira.streaming import jobs


def run_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/audira-{name}-{uuid.uuid4().hex}"


@query(
    "overwrite_partition",
    with_ctes(CATALOG_SQL)
    + """SELECT id, CASE WHEN source_file = 'src5' THEN 'new ' || title ELSE title END AS title, source_file FROM catalog
WHERE source_file <> 'src5' OR privacy = 'public'""",
)
def overwrite_partition(spark, d):
    folder = run_folder(spark, "catalog")
    path, meta = f"{folder}/videos", f"{folder}/meta"
    rows = b.catalog(spark, d).select("id", "title", "published_at", "source_file", "privacy")
    catalog.overwrite_partition(rows, path, meta, AS_OF, "first")
    newer = rows.where((F.col("source_file") == "src5") & (F.col("privacy") == "public"))
    newer = newer.withColumn("title", F.concat(F.lit("new "), "title"))
    catalog.overwrite_partition(newer, path, meta, AS_OF + dt.timedelta(hours=1), "second")
    return spark.read.parquet(path).select("id", "title", F.col("source_file").cast("string").alias("source_file"))


@query(
    "partition_metadata",
    with_ctes(CATALOG_SQL)
    + """SELECT source_file, count(*) FILTER (WHERE source_file <> 'src5' OR privacy = 'public') AS count,
  CASE WHEN source_file = 'src5' THEN TIMESTAMP '2024-01-30 13:00:00' ELSE TIMESTAMP '2024-01-30 12:00:00' END AS updated_at,
  CASE WHEN source_file = 'src5' THEN 'second' ELSE 'first' END AS last_source FROM catalog GROUP BY 1""",
)
def partition_metadata(spark, d):
    folder = run_folder(spark, "catalog")
    path, meta = f"{folder}/videos", f"{folder}/meta"
    rows = b.catalog(spark, d).select("id", "title", "published_at", "source_file", "privacy")
    catalog.overwrite_partition(rows, path, meta, AS_OF, "first")
    newer = rows.where((F.col("source_file") == "src5") & (F.col("privacy") == "public"))
    catalog.overwrite_partition(newer, path, meta, AS_OF + dt.timedelta(hours=1), "second")
    return catalog.latest_metadata(spark.read.parquet(meta))


@query(
    "append_log",
    "WITH "
    + COMMENTS_SQL
    + "\nSELECT comment_id, author AS user_id, 'drama,' || author AS keywords FROM comments",
)
def append_log(spark, d):
    path = run_folder(spark, "log")
    rows = b.comments(spark, d)
    log = rows.select(
        "comment_id", F.col("author").alias("user_id"), F.array(F.lit("drama"), F.col("author")).alias("keywords"), "turn"
    )
    catalog.append_log(log.where(F.col("turn") == 0).drop("turn"), path)
    catalog.append_log(log.where(F.col("turn") > 0).drop("turn"), path)
    return spark.read.parquet(path).withColumn("keywords", F.array_join("keywords", ","))


# ---- streaming: the event file is replayed as a stream -------------------------------------------------------


def event_stream(spark, sf_dir: str):
    reader = spark.readStream.schema(jobs.EVENT).option("pathGlobFilter", "events.parquet")
    return reader.parquet(sf_dir)


def run_append(stream, folder: str):
    """Run an append-mode stream over everything available and read its sink."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    running = writer.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(
    "stream_daily_views",
    """SELECT CAST(ts AS DATE) AS day, event_type, sum(value) AS views, count(*) AS events FROM events
WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR GROUP BY 1, 2""",
    {"views": 2},
)
def stream_daily_views(spark, d):
    return run_append(jobs.stream_daily_views(event_stream(spark, d), "event_type"), run_folder(spark, "daily"))


@query("stream_catalog_dedup", "SELECT DISTINCT user_id FROM events")
def stream_catalog_dedup(spark, d):
    stream = event_stream(spark, d).select("user_id", F.col("ts").alias("published_at"))
    return run_append(jobs.stream_catalog_dedup(stream, "user_id").select("user_id"), run_folder(spark, "dedup"))


@query(
    "stream_catalog_news",
    """WITH RECURSIVE r AS (SELECT user_id, event_id, ts FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
known AS (SELECT user_id, min(ts) AS last FROM events WHERE user_id % 4 = 0 GROUP BY 1),
start AS (SELECT user_id, coalesce(last + INTERVAL 2 DAY, TIMESTAMP '1900-01-01') AS since FROM (SELECT DISTINCT user_id FROM r) LEFT JOIN known USING (user_id)),
first AS (SELECT r.user_id, min(struct_pack(ts := ts, event_id := event_id)) AS x FROM r JOIN start ON start.user_id = r.user_id AND ts >= since GROUP BY 1),
later AS (SELECT a.user_id, a.event_id, min(struct_pack(ts := b.ts, event_id := b.event_id)) AS y FROM r a JOIN r b ON b.user_id = a.user_id AND b.ts >= a.ts + INTERVAL 2 DAY GROUP BY 1, 2),
e AS (SELECT user_id, x.ts AS ts, x.event_id AS event_id FROM first
  UNION ALL SELECT later.user_id, y.ts, y.event_id FROM e JOIN later ON later.user_id = e.user_id AND later.event_id = e.event_id)
SELECT user_id, event_id, ts FROM e""",
)
def stream_catalog_news(spark, d):
    """Ids come out again two days after they were last let through; a quarter of them is known from the start."""
    events = b.table(spark, d, "events")
    known = events.where(F.col("user_id") % 4 == 0).groupBy("user_id").agg(F.min("ts").alias("last"))
    stream = event_stream(spark, d).select("user_id", "event_id", "ts")
    out = jobs.stream_catalog_news(stream, known, "user_id", "ts", dt.timedelta(days=2))
    return run_append(out, run_folder(spark, "news")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "stream_user_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER u < INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS first FROM events
  WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
w AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 120 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, k)
SELECT * FROM w WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stream_user_sessions(spark, d):
    return run_append(jobs.stream_user_sessions(event_stream(spark, d)), run_folder(spark, "sessions"))


@query(
    "stream_capped_ingest",
    """WITH s AS (SELECT event_id % 4 AS batch, count(*) AS n FROM events GROUP BY 1),
held AS (SELECT batch, coalesce(sum(n) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT event_id, user_id, event_type FROM events JOIN held ON held.batch = event_id % 4 WHERE before < 300""",
)
def stream_capped_ingest(spark, d):
    """The events arrive in four runs, one batch each; the cap of 300 rows leaves the later ones out."""
    folder = run_folder(spark, "ingest")
    rows = b.table(spark, d, "events").select("event_id", "user_id", "event_type")
    for k in range(4):  # what has arrived since the last run is one batch, in as many files as it takes
        rows.where(F.pmod("event_id", F.lit(4)) == k).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        jobs.stream_capped_ingest(stream, f"{folder}/out", f"{folder}/state", 300, ["event_id"]).awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query(
    "scheduled_refresh",
    """SELECT id, source_file, title, updated_at FROM (SELECT user_id AS id, event_type AS source_file, event_type || event_id AS title, ts AS updated_at,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY (event_id % 3 > 0) DESC, ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""",
)
def scheduled_refresh(spark, d):
    """Two arrivals, the second one with changed rows; a run at another hour and one without arrivals change nothing."""
    folder = run_folder(spark, "refresh")
    events = b.table(spark, d, "events")
    ids = [F.col("user_id").alias("id"), F.col("event_type").alias("source_file"), F.concat("event_type", F.col("event_id").cast("string")).alias("title"), F.col("ts").alias("updated_at")]
    late, schema = F.col("event_id") % 3 > 0, events.select(*ids).schema
    out, ledger, state = (f"{folder}/{x}" for x in ("out", "ledger", "state"))
    for part, hours in ((~late, (9,)), (late, (10, 12, 18))):
        # Of rows with one time the later event counts; a microsecond per arrival would do the same in a real feed.
        ordering.latest_per_key(events.where(part), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select(*ids).write.mode("append").parquet(f"{folder}/in")
        for hour in hours:
            stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
            run = jobs.scheduled_refresh(stream, out, ledger, state, AS_OF.replace(hour=hour))
            if run is not None:
                run.awaitTermination()
    return jobs.read_refreshed(spark, out, ledger, schema)
