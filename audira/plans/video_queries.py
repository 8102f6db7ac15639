"""Queries on the video catalogue, channel statistics, comments and accounts."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from audira.functions import text
from audira.operators import accounts, comments, ordering, videos
from audira.plans.registry import query
from audira.session import ensure_checkpoint_dir
from audira.sources import bindings as b
from audira.sources import catalog
from audira.sources.bindings import (
    AS_OF, CATALOG_SQL, COMMENTS_SQL, DEMO_SQL, DIMS_SQL, LIST_SQL, MAIN_SQL, SESSIONS_SQL, USERS_SQL, with_ctes,
)

CAT = with_ctes(CATALOG_SQL)
START, END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)
START_SQL, END_SQL = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-20 00:00:00'"


# ---- catalogue -----------------------------------------------------------------------------------------------


@query(
    "scan_catalog_partition",
    CAT + "SELECT id, title, md5(description) AS digest, published_at FROM catalog WHERE source_file = 'src3'",
)
def scan_catalog_partition(spark, d):
    rows = catalog.scan_catalog_partition(b.catalog(spark, d), "src3")
    return rows.select("id", "title", F.md5("description").alias("digest"), "published_at")


@query(
    "search_catalog_pushdown",
    CAT
    + f"""SELECT id, title, published_at FROM catalog WHERE published_at BETWEEN {START_SQL} AND {END_SQL}
AND (contains(lower(title), 'the') OR contains(lower(description), 'the') OR contains(lower(title), 'que')
  OR contains(lower(description), 'que'))""",
)
def search_catalog_pushdown(spark, d):
    return catalog.search_catalog_pushdown(b.catalog(spark, d), ["The", " q ue "], START, END)


@query(
    "search_catalog_index",
    CAT
    + f"""SELECT id, title, published_at FROM catalog WHERE published_at BETWEEN {START_SQL} AND {END_SQL}
AND (contains(lower(title), 'onthe') OR contains(lower(description), 'onthe') OR contains(lower(title), 'idiot')
  OR contains(lower(description), 'idiot'))""",
)
def search_catalog_index(spark, d):
    """The catalogue is stored with its postings, then searched through them."""
    rows = b.catalog(spark, d).select(*[f.name for f in catalog.VIDEO])
    path = f"{ensure_checkpoint_dir(spark)}/audira-search-{uuid.uuid4().hex}"
    catalog.write_searchable(rows, path)
    return catalog.search_indexed(spark, path, catalog.VIDEO, ["On the", " idiot "], START, END)


@query(
    "catalog_keyword_filter",
    CAT
    + """SELECT id, title, published_at FROM catalog
WHERE (contains(lower(regexp_replace(title, '[^a-zA-Z0-9가-힣]', '', 'g')), 'andthe')
  OR contains(lower(regexp_replace(description, '[^a-zA-Z0-9가-힣]', '', 'g')), 'andthe'))
AND CAST(published_at + INTERVAL 9 HOUR AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)
def catalog_keyword_filter(spark, d):
    return videos.catalog_keyword_filter(b.catalog(spark, d), "And the!", dt.date(2024, 1, 5), dt.date(2024, 1, 20))


@query(
    "playlist_period_keyword_filter",
    CAT
    + f""", h AS (SELECT source_file, id, title, published_at, row_number() OVER (PARTITION BY source_file
  ORDER BY published_at DESC, id) AS k FROM catalog WHERE published_at BETWEEN {START_SQL} AND {END_SQL}
  AND contains(regexp_replace(lower(title || ' ' || description), '[\\s\\x0B\\x1C-\\x1F\\p{{Z}}]', '', 'g'), 'andthe'))
SELECT source_file, id, title, published_at FROM h WHERE k <= 5""",
)
def playlist_period_keyword_filter(spark, d):
    return videos.playlist_period_keyword_filter(b.catalog(spark, d), "source_file", ["#And the"], START, END, 5)


@query(
    "exclude_title_regex",
    CAT + "SELECT id, title FROM catalog WHERE NOT regexp_matches(title, '(?i)\\bthe\\b')",
)
def exclude_title_regex(spark, d):
    return videos.exclude_title_regex(b.catalog(spark, d), word="the").select("id", "title")


@query(
    "latest_sync_status",
    CAT
    + """SELECT source_file, count(*) AS cached_videos, strftime(max(published_at) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS last_update
FROM catalog GROUP BY 1""",
)
def latest_sync_status(spark, d):
    return catalog.latest_sync_status(b.catalog(spark, d))


def _sync_inputs(spark, d):
    """The later part of the catalogue arrives as new; the earlier part is cached, one partition was never synced."""
    rows = b.catalog(spark, d)
    day = F.to_date("published_at")
    cached = rows.where((day < F.lit("2024-01-20").cast("date")) & (F.col("source_file") != "src1"))
    incoming = rows.where(day >= F.lit("2024-01-10").cast("date")).withColumn("upload_at", F.col("published_at"))
    last = cached.groupBy("source_file").agg(F.max("published_at").alias("updated_at"))
    return incoming, cached, last


SYNC_SQL = (
    CAT
    + """, cached AS (SELECT * FROM catalog WHERE CAST(published_at AS DATE) < DATE '2024-01-20' AND source_file <> 'src1'),
last AS (SELECT source_file, max(published_at) AS updated_at FROM cached GROUP BY 1),
fresh AS (SELECT c.* FROM catalog c LEFT JOIN last USING (source_file) WHERE CAST(published_at AS DATE) >= DATE '2024-01-10'
  AND privacy = 'public' AND published_at >= coalesce(updated_at - INTERVAL 7 DAY, TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 730 DAY)
  AND NOT EXISTS (SELECT 1 FROM cached k WHERE k.source_file = c.source_file AND k.id = c.id))
SELECT id, title, published_at, source_file FROM fresh UNION ALL SELECT id, title, published_at, source_file FROM cached"""
)


@query("incremental_catalog_sync", SYNC_SQL)
def incremental_catalog_sync(spark, d):
    incoming, cached, last = _sync_inputs(spark, d)
    out = catalog.incremental_catalog_sync(incoming, cached, last, AS_OF)
    return out.select("id", "title", "published_at", "source_file")


@query("incremental_catalog_sync_bucketed", SYNC_SQL)
def incremental_catalog_sync_bucketed(spark, d):
    """The cached side is a stored table, bucketed by partition and id: only the incoming rows move."""
    incoming, cached, last = _sync_inputs(spark, d)
    name = f"audira_cached_{uuid.uuid4().hex}"
    catalog.store_bucketed(cached.select(*[f.name for f in catalog.VIDEO]), name, 16, f"{ensure_checkpoint_dir(spark)}/{name}")
    out = catalog.incremental_catalog_sync(incoming, spark.table(name), last, AS_OF)
    return out.select("id", "title", "published_at", "source_file")


@query(
    "dedup_latest",
    "SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,"
    " event_id DESC) AS k FROM events) WHERE k = 1",
)
def dedup_latest(spark, d):
    events = b.table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return ordering.latest_per_key(events, ["user_id"], [F.col("ts"), F.col("event_id")])


# ---- nested pages: the tables are folded into response pages and flattened again ------------------------------


@query(
    "flatten_playlist_items",
    CAT
    + """SELECT id, title, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS date, md5(description) AS digest FROM catalog
WHERE privacy = 'public' AND n_chars >= 300""",
)
def flatten_playlist_items(spark, d):
    rows = b.catalog(spark, d)
    number = F.col("id").cast("bigint")
    stamp = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct(
        F.struct(F.col("privacy").alias("privacyStatus")).alias("status"),
        F.struct(
            "title", "description", stamp.alias("publishedAt"), F.struct(F.col("id").alias("videoId")).alias("resourceId")
        ).alias("snippet"),
        F.struct(F.when(F.col("n_chars") >= 300, stamp).alias("videoPublishedAt")).alias("contentDetails"),
    )
    # Pages of fifty items, as the service returns them.
    pages = rows.groupBy(F.floor(number / 50)).agg(F.collect_list(item).alias("items"))
    pages = pages.select(F.to_json(F.struct("items")).alias("body"))
    out = catalog.flatten_playlist_items(pages)
    return out.select("id", "title", "date", F.md5("description").alias("digest"))


def _statistics_pages(spark, d):
    stats = b.realtime(spark, d)
    item = F.struct(
        F.col("video_id").cast("string").alias("id"),
        F.struct(
            F.col("viewCount").cast("string").alias("viewCount"),
            F.when(F.col("video_id") % 4 != 0, F.col("likeCount").cast("string")).alias("likeCount"),
        ).alias("statistics"),
        F.struct(
            F.concat(F.lit("video "), F.col("video_id").cast("string")).alias("title"),
            F.lit("2024-01-01T20:30:00Z").alias("publishedAt"),
        ).alias("snippet"),
        F.struct("duration").alias("contentDetails"),
    )
    pages = stats.groupBy(F.floor(F.col("video_id") / 50)).agg(F.collect_list(item).alias("items"))
    return pages.select(F.to_json(F.struct("items")).alias("body"))


@query(
    "flatten_video_statistics",
    with_ctes(LIST_SQL)
    + """SELECT CAST(video_id AS VARCHAR) AS video_id, 'https://www.youtube.com/watch?v=' || video_id AS video_url,
  'video ' || video_id AS title, '' AS channelTitle, '2024-01-02 05:30:00' AS publishedAt,
  (seconds // 60) || ':' || lpad(CAST(seconds % 60 AS VARCHAR), 2, '0') AS duration,
  CASE WHEN seconds <= 60 THEN 'Shorts' ELSE 'Clip' END AS shortType, rt_views AS viewCount,
  CASE WHEN video_id % 4 = 0 THEN 0 ELSE rt_likes END AS likeCount, 0 AS commentCount FROM all_realtime""",
)
def flatten_video_statistics(spark, d):
    return catalog.flatten_video_statistics(_statistics_pages(spark, d))


@query(
    "flatten_comment_threads",
    COMMENTS_SQL.join(["WITH ", "\n"])
    + """SELECT CAST(video_id AS VARCHAR) AS video_id, comment_id, CASE WHEN turn % 2 = 1 THEN video_id || '-' || (turn - 1) ELSE '' END AS parent_id,
  CAST(turn % 2 AS INTEGER) AS isReply, author, text, likeCount FROM comments""",
)
def flatten_comment_threads(spark, d):
    rows = b.comments(spark, d)
    body = F.struct(
        F.col("author").alias("authorDisplayName"), F.col("text").alias("textDisplay"),
        F.col("likeCount").cast("string").alias("likeCount"),
    )
    entry = F.struct(F.col("comment_id").alias("id"), body.alias("snippet"))
    # Every even turn opens a thread and the next odd turn answers it, so a thread holds at most one reply.
    tops = rows.where(F.col("turn") % 2 == 0).select("video_id", "turn", entry.alias("topLevelComment"))
    answers = rows.where(F.col("turn") % 2 == 1).select("video_id", (F.col("turn") - 1).alias("turn"), entry.alias("reply"))
    threads = tops.join(answers, ["video_id", "turn"], "left")
    threads = threads.withColumn("comments", F.array_compact(F.array("reply")))
    thread = F.struct(
        F.struct(
            F.col("video_id").cast("string").alias("videoId"), F.size("comments").alias("totalReplyCount"), "topLevelComment"
        ).alias("snippet"),
        F.struct("comments").alias("replies"),
    )
    pages = threads.select(F.to_json(F.struct(F.array(thread).alias("items"))).alias("body"))
    out = catalog.flatten_comment_threads(pages)
    return out.select("video_id", "comment_id", "parent_id", "isReply", "author", "text", "likeCount")


# ---- channel statistics --------------------------------------------------------------------------------------

PERIOD_SQL = """period AS (SELECT channel, video_id, sum(views) AS views, sum(likes) AS likes, avg(avg_pct) AS avg_pct FROM main GROUP BY 1, 2)"""
WEIGHTED_SQL = """weighted AS (SELECT d.channel, d.video_id, age_group || '_' || gender AS key, views * viewer_pct / 100 AS views
  FROM demo d JOIN period p ON p.video_id = d.video_id)"""


@query(
    "video_demo_weighted",
    with_ctes(MAIN_SQL, PERIOD_SQL, DEMO_SQL, WEIGHTED_SQL) + "SELECT channel, key, sum(views) AS views FROM weighted GROUP BY 1, 2",
    {"views": 4},
)
def video_demo_weighted(spark, d):
    return videos.video_demo_weighted(b.video_main(spark, d), b.video_demo(spark, d))


@query(
    "video_demo_map",
    with_ctes(MAIN_SQL, PERIOD_SQL, DEMO_SQL, WEIGHTED_SQL)
    + "SELECT video_id, key, sum(views) AS views FROM weighted GROUP BY 1, 2",
    {"views": 4},
)
def video_demo_map(spark, d):
    per_video = videos.video_demo_weighted(b.video_main(spark, d), b.video_demo(spark, d), per_video=True)
    return videos.demo_map(per_video).select("video_id", F.explode("demo_stats").alias("key", "views"))


@query(
    "video_enriched",
    with_ctes(MAIN_SQL, PERIOD_SQL, LIST_SQL)
    + """SELECT v.channel, v.video_id, title, coalesce(views, 0.0) AS period_views, coalesce(likes, 0.0) AS period_likes,
  coalesce(avg_pct, 0.0) AS avg_pct, coalesce(rt_views, 0) AS rt_views, coalesce(rt_likes, 0) AS rt_likes,
  round(coalesce(seconds, 0) / 60.0, 1) AS duration_min
FROM videos v LEFT JOIN period USING (video_id) LEFT JOIN realtime USING (video_id)
WHERE coalesce(views, 0) > 0 OR coalesce(rt_views, 0) > 0""",
    {"period_views": 2, "avg_pct": 6, "duration_min": 1},
)
def video_enriched(spark, d):
    return videos.video_enriched(b.video_list(spark, d), b.video_main(spark, d), b.realtime(spark, d, recent_only=True))


@query(
    "channel_totals",
    with_ctes(MAIN_SQL, PERIOD_SQL, LIST_SQL)
    + """SELECT v.channel, count(*) AS video_count, sum(coalesce(views, 0.0)) AS total_views, sum(coalesce(likes, 0.0)) AS total_likes,
  sum(views * avg_pct) FILTER (WHERE views > 0 AND avg_pct > 0) / sum(views) FILTER (WHERE views > 0 AND avg_pct > 0) AS avg_view_pct,
  CAST(sum(coalesce(rt_views, 0)) AS BIGINT) AS rt_total_views, CAST(sum(coalesce(rt_likes, 0)) AS BIGINT) AS rt_total_likes,
  count(*) FILTER (WHERE rt_views >= 100000) AS at_least_100000, count(*) FILTER (WHERE rt_views >= 500000) AS at_least_500000,
  count(*) FILTER (WHERE rt_views >= 1000000) AS at_least_1000000
FROM videos v LEFT JOIN period USING (video_id) LEFT JOIN realtime USING (video_id) GROUP BY 1""",
    {"total_views": 2, "avg_view_pct": 6},
)
def channel_totals(spark, d):
    return videos.channel_totals(b.video_list(spark, d), b.video_main(spark, d), b.realtime(spark, d, recent_only=True))


@query(
    "multi_channel_merge",
    with_ctes(MAIN_SQL, PERIOD_SQL, DEMO_SQL, WEIGHTED_SQL, DIMS_SQL)
    + """SELECT dim, key, sum(views) AS views FROM (SELECT 'demo' AS dim, key, views FROM weighted UNION ALL
  SELECT dim, key, views FROM dims) GROUP BY 1, 2""",
    {"views": 3},
)
def multi_channel_merge(spark, d):
    demo = videos.video_demo_weighted(b.video_main(spark, d), b.video_demo(spark, d))
    return videos.multi_channel_merge(demo, b.video_dims(spark, d))


@query(
    "views_by_dimension",
    with_ctes(DIMS_SQL)
    + """SELECT dim, key, CASE WHEN dim = 'traffic' THEN CASE key WHEN 'YT_SEARCH' THEN '유튜브 검색' WHEN 'RELATED_VIDEO' THEN '추천 동영상'
    WHEN 'EXT_URL' THEN '외부 링크' WHEN 'PLAYLIST' THEN '재생목록' ELSE key END
  WHEN dim = 'country' THEN CASE key WHEN 'US' THEN 'USA' WHEN 'JP' THEN 'JPN' WHEN 'VN' THEN 'VNM' WHEN 'TH' THEN 'THA'
    WHEN 'ID' THEN 'IDN' ELSE key END ELSE key END AS label, sum(views) AS views
FROM dims WHERE dim = 'traffic' OR (dim = 'keyword' AND key <> 'GOOGLE_SEARCH') OR (dim = 'country' AND key <> 'KR') GROUP BY 1, 2""",
    {"views": 2},
)
def views_by_dimension(spark, d):
    return videos.views_by_dimension(b.video_dims(spark, d))


def case_sql(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {column} END"


@query(
    "survey_label_lookup",
    f"""SELECT user_id, key, {case_sql("key", videos.SURVEY_NAMES)} AS label
FROM (SELECT DISTINCT user_id, list_value({", ".join(f"'{k}'" for k in videos.SURVEY_NAMES)}, 'other')[event_id % 8 + 1] AS key FROM events)""",
)
def survey_label_lookup(spark, d):
    keys = F.array(*[F.lit(k) for k in (*videos.SURVEY_NAMES, "other")])
    rows = b.table(spark, d, "events").select("user_id", F.element_at(keys, (F.col("event_id") % 8 + 1).cast("int")).alias("key"))
    return videos.code_label_lookup(rows.distinct(), "key", videos.SURVEY_NAMES)


@query(
    "code_label_lookup",
    with_ctes(DIMS_SQL)
    + f"""SELECT channel, key, {case_sql("key", videos.TRAFFIC_NAMES)} AS label FROM dims WHERE dim = 'traffic'""",
)
def code_label_lookup(spark, d):
    rows = b.video_dims(spark, d).where(F.col("dim") == "traffic").select("channel", "key")
    return videos.code_label_lookup(rows, "key", videos.TRAFFIC_NAMES)


@query(
    "daily_views",
    with_ctes(DIMS_SQL)
    + "SELECT CAST(key AS DATE) AS day, sum(views) AS views FROM dims WHERE dim = 'day' AND key <> 'unknown' GROUP BY 1",
    {"views": 2},
)
def daily_views(spark, d):
    return videos.daily_views(b.video_dims(spark, d))


@query(
    "confirmed_window",
    with_ctes(MAIN_SQL)
    + "SELECT channel, video_id, day, views FROM main WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-28'",
    {"views": 2},
)
def confirmed_window(spark, d):
    main = b.video_main(spark, d)
    out = videos.confirmed_window(main, "day", dt.date(2024, 1, 10), dt.date(2024, 1, 31), AS_OF)
    return out.select("channel", "video_id", "day", "views")


SHARE_SQL = """, s AS (SELECT split_part(key, '_', 1) AS age, split_part(key, '_', 2) AS gender, sum(views) AS views FROM weighted GROUP BY 1, 2),
t AS (SELECT sum(views) AS total FROM period),
c AS (SELECT age, gender, views, views * 100 / total AS share FROM s, t)
SELECT replace(age, 'age', '') AS age, gender, views, share, sum(share) OVER (PARTITION BY gender) AS gender_share,
  CASE age WHEN 'age13-17' THEN 1 WHEN 'age18-24' THEN 2 WHEN 'age25-34' THEN 3 WHEN 'age35-44' THEN 4 WHEN 'age45-54' THEN 5
  WHEN 'age55-64' THEN 6 ELSE 7 END AS age_order FROM c"""


@query(
    "demographic_share",
    with_ctes(MAIN_SQL, PERIOD_SQL, DEMO_SQL, WEIGHTED_SQL) + SHARE_SQL,
    {"views": 3, "share": 6, "gender_share": 6},
)
def demographic_share(spark, d):
    main = b.video_main(spark, d)
    demo = videos.video_demo_weighted(main, b.video_demo(spark, d))
    return videos.demographic_share(demo, main.agg(F.sum("views").alias("total_views")))


@query(
    "view_threshold_counts",
    with_ctes(LIST_SQL)
    + """SELECT count(*) FILTER (WHERE rt_views >= 100000) AS at_least_100000, count(*) FILTER (WHERE rt_views >= 500000)
  AS at_least_500000, count(*) FILTER (WHERE rt_views >= 1000000) AS at_least_1000000 FROM all_realtime""",
)
def view_threshold_counts(spark, d):
    return videos.view_threshold_counts(b.realtime(spark, d), "viewCount")


@query(
    "weighted_watch_pct",
    with_ctes(MAIN_SQL)
    + "SELECT channel, sum(views * avg_pct) / sum(views) AS avg_view_pct FROM main WHERE views > 0 AND avg_pct > 0 GROUP BY 1",
    {"avg_view_pct": 6},
)
def weighted_watch_pct(spark, d):
    return videos.weighted_watch_pct(b.video_main(spark, d), ("channel",))


@query(
    "top_videos",
    with_ctes(MAIN_SQL, PERIOD_SQL)
    + "SELECT video_id, 'video ' || video_id AS title, round(views, 2) AS period_views FROM period ORDER BY 3 DESC, 1 LIMIT 100",
    {"period_views": 2},
)
def top_videos(spark, d):
    rows = b.video_main(spark, d).groupBy("video_id").agg(F.round(F.sum("views"), 2).alias("period_views"))
    title = F.concat(F.lit("video "), F.col("video_id").cast("string")).alias("title")
    return videos.top_videos(rows.select("video_id", title, "period_views"))


@query(
    "top_keywords",
    with_ctes(DIMS_SQL)
    + "SELECT key, sum(views) AS views FROM dims WHERE dim = 'keyword' AND key <> 'GOOGLE_SEARCH' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    {"views": 2},
)
def top_keywords(spark, d):
    return videos.top_keywords(b.video_dims(spark, d))


@query(
    "top_k_with_others",
    with_ctes(DIMS_SQL)
    + """, s AS (SELECT key, sum(views) AS views, row_number() OVER (ORDER BY sum(views) DESC, key) AS k FROM dims WHERE dim = 'keyword' GROUP BY 1)
SELECT CASE WHEN k <= 5 THEN key ELSE '기타' END AS key, sum(views) AS views, k > 5 AS is_other FROM s
GROUP BY CASE WHEN k <= 5 THEN key ELSE '기타' END, k > 5""",
    {"views": 2},
)
def top_k_with_others(spark, d):
    rows = b.video_dims(spark, d).where(F.col("dim") == "keyword")
    return videos.top_k_with_others(rows.groupBy("key").agg(F.sum("views").alias("views")), "key", "views")


# ---- comments ------------------------------------------------------------------------------------------------

CO = "WITH " + COMMENTS_SQL + "\n"
LINE_SQL = """'[' || CASE WHEN isReply = 1 THEN 'R' ELSE 'T' END || '|♥' || likeCount || '] ' || author || ': ' ||
  CASE WHEN length(replace(text, chr(10), ' ')) > 280 THEN substr(replace(text, chr(10), ' '), 1, 280) || '…'
  ELSE replace(text, chr(10), ' ') END"""


@query("comment_line", CO + f"SELECT comment_id, {LINE_SQL} AS line FROM comments")
def comment_line(spark, d):
    return b.comments(spark, d).select("comment_id", comments.comment_line().alias("line"))


def sample_sql(top: int, drawn: int, budget: int) -> str:
    return f""", a AS (SELECT *, row_number() OVER (ORDER BY likeCount DESC, comment_id) AS k FROM comments),
r AS (SELECT *, row_number() OVER (ORDER BY md5(comment_id || '|42'), comment_id) AS j FROM a WHERE k > {top}),
s AS (SELECT 1 AS part, k AS o, * EXCLUDE (k) FROM a WHERE k <= {top}
  UNION ALL SELECT 2, j, * EXCLUDE (k, j) FROM r WHERE j <= {drawn}),
l AS (SELECT part, comment_id, {LINE_SQL} AS line, o FROM s),
c AS (SELECT row_number() OVER (ORDER BY part, o) AS line_no, part, comment_id, line,
  CAST(coalesce(sum(length(line) + 1) OVER (ORDER BY part, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
  AS chars_before FROM l),
sampled AS (SELECT * FROM c WHERE chars_before < {budget})"""


SAMPLE = dict(top_n=150, random_n=120, max_total=40_000)


@query("comment_sample", CO + sample_sql(150, 120, 40_000) + " SELECT * FROM sampled")
def comment_sample(spark, d):
    return comments.comment_sample(b.comments(spark, d), **SAMPLE)


@query(
    "comment_sample_meta",
    CO
    + sample_sql(150, 120, 40_000)
    + """ SELECT (SELECT count(*) FROM comments) AS total_rows, (SELECT count(DISTINCT trim(text)) FROM comments WHERE trim(text) <> '')
  AS unique_rows, (SELECT least(count(*), 150) FROM comments) AS used_top,
  (SELECT least(greatest(count(*) - 150, 0), 120) FROM comments) AS used_random, (SELECT least(count(*), 270) FROM comments) AS sampled_target,
  count(*) AS lines, CAST(sum(length(line) + 1) AS BIGINT) AS chars FROM sampled""",
)
def comment_sample_meta(spark, d):
    rows = b.comments(spark, d)
    return comments.sample_meta(rows, comments.comment_sample(rows, **SAMPLE), SAMPLE["top_n"], SAMPLE["random_n"])


@query(
    "except_selected",
    CO
    + """SELECT comment_id, likeCount FROM comments WHERE comment_id NOT IN
  (SELECT comment_id FROM comments ORDER BY likeCount DESC, comment_id LIMIT 20)""",
)
def except_selected(spark, d):
    rows = b.comments(spark, d)
    best = rows.orderBy(F.col("likeCount").desc(), "comment_id").limit(20)
    return comments.except_selected(rows, best, "comment_id").select("comment_id", "likeCount")


@query(
    "append_capped_csv",
    CO
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY turn) AS r FROM comments),
z AS (SELECT video_id, count(*) AS n FROM k WHERE r <= 2 GROUP BY 1),
p AS (SELECT video_id, coalesce(sum(n) OVER (ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z)
SELECT k.video_id, comment_id FROM k JOIN p ON p.video_id = k.video_id WHERE r <= 2 AND before < 101""",
)
def append_capped_csv(spark, d):
    kept = catalog.append_capped_csv(b.comments(spark, d), [F.col("turn")], per_video=2, total=101)
    return kept.select("video_id", "comment_id")


@query(
    "ordered_distinct",
    CAT
    + """, u AS (SELECT id, 0 AS search, row_number() OVER (ORDER BY published_at DESC, id) AS place FROM catalog WHERE contains(lower(title), 'the')
  UNION ALL SELECT id, 1, row_number() OVER (ORDER BY published_at DESC, id) FROM catalog WHERE contains(lower(title), 'le'))
SELECT id, search, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY search, place) AS k FROM u) WHERE k = 1""",
)
def ordered_distinct(spark, d):
    rows = b.catalog(spark, d)
    parts = []
    for word in ("the", "le"):
        hits = rows.where(F.lower("title").contains(word)).select("id", "published_at")
        parts.append(ordering.with_position(hits, [], [F.col("published_at").desc(), F.col("id")], "place"))
    return comments.ordered_distinct(parts, "id")


@query(
    "union_distinct_keys",
    "SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start FROM lineitem WHERE l_returnflag IN ('A', 'N')",
)
def union_distinct_keys(spark, d):
    fact = b.metric_long(spark, d, ["audience"])
    live, quick = fact.where(F.col("media") == "LIVE"), fact.where(F.col("media") == "QUICK")
    return comments.union_distinct_keys(live, quick, ["week_start"])


URL_PARTS_SQL = """'see https://youtu.be/' || lpad(CAST(page_id AS VARCHAR), 11, 'a') || ' and https://www.youtube.com/watch?x=1&v='
  || lpad(CAST(page_id * 3 AS VARCHAR), 11, 'b') || ' or http://youtube.com/shorts/' || lpad(CAST(page_id AS VARCHAR), 11, 'a') || ' ' || url || ' ' || html"""


def _page_texts(spark, d):
    page = F.col("page_id").cast("string")
    other = (F.col("page_id") * 3).cast("string")
    body = F.concat(
        F.lit("see https://youtu.be/"), F.lpad(page, 11, "a"), F.lit(" and https://www.youtube.com/watch?x=1&v="),
        F.lpad(other, 11, "b"), F.lit(" or http://youtube.com/shorts/"), F.lpad(page, 11, "a"), F.lit(" "), F.col("url"),
        F.lit(" "), F.col("html"),
    )
    return b.table(spark, d, "pages").select("page_id", body.alias("body"))


@query(
    "extract_video_ids",
    f"""WITH t AS (SELECT page_id, {URL_PARTS_SQL} AS body FROM pages)
SELECT DISTINCT page_id, unnest(regexp_extract_all(body, 'https?://youtu\\.be/([A-Za-z0-9_-]{{11}})', 1)
  || regexp_extract_all(body, 'https?://(?:www\\.)?youtube\\.com/shorts/([A-Za-z0-9_-]{{11}})', 1)
  || regexp_extract_all(body, 'https?://(?:www\\.)?youtube\\.com/watch\\?(?:[^ \\n?]*&)?v=([A-Za-z0-9_-]{{11}})', 1)) AS video_id FROM t""",
)
def extract_video_ids(spark, d):
    return comments.extracted_ids(_page_texts(spark, d), "body", "page_id")


@query(
    "strip_urls",
    f"""SELECT page_id,
  md5(trim(regexp_replace(regexp_replace({URL_PARTS_SQL}, 'https?://\\S+', ' ', 'g'), '[\\s\\x0B\\x1C-\\x1F\\p{{Z}}]+', ' ', 'g'))) AS digest FROM pages""",
)
def strip_urls(spark, d):
    return _page_texts(spark, d).select("page_id", F.md5(text.strip_urls("body")).alias("digest"))


@query(
    "extract_query_schema",
    CO
    + """SELECT comment_id, CASE WHEN turn % 2 = 0 THEN '2024-01-01T00:00:00+09:00' ELSE '2024-06-01' END AS range_start,
  CASE WHEN turn % 2 = 0 THEN '2024-01-31T23:59:59+09:00' ELSE '2024-06-02' END AS range_end,
  CASE WHEN turn % 2 = 0 THEN 'drama,' || author ELSE CASE WHEN regexp_extract(text, '([가-힣A-Za-z0-9]{2,})', 1) <> '' THEN
    regexp_extract(text, '([가-힣A-Za-z0-9]{2,})', 1) ELSE '유튜브' END END AS keywords,
  turn % 2 = 0 AS include_replies, CASE WHEN turn % 2 = 0 THEN 'official' ELSE 'any' END AS channel_filter, 'auto' AS lang
FROM comments""",
)
def extract_query_schema(spark, d):
    rows = b.comments(spark, d)
    block = F.concat(
        F.lit("기간(KST): 2024-01-01T00:00:00+09:00 ~ 2024-01-31T23:59:59+09:00\n키워드: [drama, "), F.col("author"),
        F.lit(', ]\n옵션: { include_replies: TRUE, channel_filter: "official" }'),
    )
    log = rows.select("comment_id", F.when(F.col("turn") % 2 == 0, F.concat(block, F.lit("\n"), F.col("text"))).otherwise(F.col("text")).alias("raw_query"))
    out = comments.extract_query_schema(log, "raw_query", "2024-06-01", "2024-06-02")
    return out.drop("raw_query").withColumn("keywords", F.array_join("keywords", ","))


# ---- accounts ------------------------------------------------------------------------------------------------


@query(
    "multi_column_search",
    with_ctes(USERS_SQL)
    + """SELECT id, name, department, email FROM users WHERE contains(lower(name), '11') OR contains(lower(id), '11')
OR contains(lower(department), '11') OR contains(lower(email), '11')""",
)
def multi_column_search(spark, d):
    return accounts.multi_column_search(b.users(spark, d), " 11 ").select("id", "name", "department", "email")


@query(
    "stored_plus_seed_users",
    with_ctes(USERS_SQL)
    + """SELECT id, name, created_at, CASE WHEN stored THEN 0 ELSE 1 END AS part FROM users""",
)
def stored_plus_seed_users(spark, d):
    # Every customer is a seed user; those with a balance are stored.
    seed = b.users(spark, d)
    return accounts.stored_plus_seed_users(seed.where("stored"), seed, ["id", "name", "created_at"])


@query(
    "intersect_allowed",
    with_ctes(USERS_SQL)
    + """SELECT id, concat_ws(',', CASE WHEN app1 IN ('app1', 'app2', 'app5') THEN app1 END,
  CASE WHEN app2 IN ('app1', 'app2', 'app5') THEN app2 END) AS apps FROM users""",
)
def intersect_allowed(spark, d):
    out = accounts.intersect_allowed(b.users(spark, d), "allowed_apps", ["app1", "app2", "app5"])
    return out.select("id", F.array_join("allowed_apps", ",").alias("apps"))


@query(
    "session_activity",
    with_ctes(SESSIONS_SQL)
    + """, a AS (SELECT user_id, count(*) FILTER (WHERE is_active AND revoked_at IS NULL AND expires_at >= TIMESTAMP '2024-01-30 12:00:00'
    AND (last_seen_at >= TIMESTAMP '2024-01-30 10:00:00' OR (last_seen_at IS NULL AND created_at >= TIMESTAMP '2024-01-30 10:00:00')))
  AS active_session_count FROM sessions GROUP BY 1),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_seen_at DESC NULLS LAST, created_at DESC, source_app DESC) AS k
  FROM sessions)
SELECT a.user_id, active_session_count, coalesce(last_seen_at, created_at) AS last_seen_at, source_app AS last_source_app
FROM a JOIN l ON l.user_id = a.user_id AND k = 1""",
)
def session_activity(spark, d):
    return accounts.session_activity(b.sessions(spark, d), AS_OF)


@query(
    "pending_requests",
    """SELECT event_id AS login_id, ts AS requested_at, 'pending' AS status, 'password_reset' AS type
FROM events WHERE event_type = 'signup' AND value >= 20""",
)
def pending_requests(spark, d):
    requests = b.table(spark, d, "events").select(
        F.col("event_id").alias("login_id"),
        F.col("ts").alias("requested_at"),
        F.when(F.col("event_type") == "signup", F.lit("pending")).otherwise(F.lit("approved")).alias("status"),
        F.when(F.col("value") >= 20, F.lit("password_reset")).otherwise(F.lit("signup")).alias("type"),
    )
    return accounts.pending_requests(requests, "pending", "password_reset")


