"""Multi-channel video statistics.

Inputs: a video list (channel, video_id, title), a main report (channel, video_id, views, likes, avg_pct), a
demographic report (channel, video_id, age_group, gender, viewer_pct), a dimension report (channel, dim, key,
views), optional shares per channel and real-time statistics per video.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from audira.functions import dates, grades, text
from audira.operators import ordering

# Code names used by the reports.
TRAFFIC_NAMES = {
    "YT_SEARCH": "유튜브 검색",
    "RELATED_VIDEO": "추천 동영상",
    "BROWSE_FEATURES": "탐색 기능",
    "EXT_URL": "외부 링크",
    "NO_LINK_OTHER": "기타",
    "PLAYLIST": "재생목록",
    "VIDEO_CARD": "카드/최종화면",
    "NOTIFICATION": "알림",
}
COUNTRY_ISO3 = {
    "KR": "KOR",
    "US": "USA",
    "JP": "JPN",
    "VN": "VNM",
    "TH": "THA",
    "ID": "IDN",
    "TW": "TWN",
    "PH": "PHL",
    "MY": "MYS",
    "IN": "IND",
    "BR": "BRA",
    "MX": "MEX",
    "RU": "RUS",
    "GB": "GBR",
    "DE": "DEU",
    "FR": "FRA",
    "CA": "CAN",
    "AU": "AUS",
    "HK": "HKG",
    "SG": "SGP",
}
HOME_COUNTRY = "KR"
SURVEY_NAMES = {
    "시사지표_장르": "장르 및 소재",
    "시사지표_캐릭터": "캐릭터 및 캐스팅",
    "시사지표_전개": "전개와 구성",
    "시사지표_공감": "공감성",
    "시사지표_개연성": "개연성",
    "시사지표_대사": "대사 및 표현",
    "시사지표_연출": "연출 및 완성도",
}
AGE_ORDER = ["age13-17", "age18-24", "age25-34", "age35-44", "age45-54", "age55-64", "age65-"]
GENDERS = ["male", "female"]
VIEW_THRESHOLDS = (100_000, 500_000, 1_000_000)
NOT_A_KEYWORD = "GOOGLE_SEARCH"


def code_label_lookup(df: DataFrame, column: str, names: dict[str, str], out: str = "label") -> DataFrame:
    """Label of a code; an unknown code stays as it is. The table is a constant map."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn(out, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column)))


def confirmed_end(requested_end: Column, as_of: Column, lag_hours: int = 48) -> Column:
    """Analysis end date: the requested one, but not later than the confirmed day."""
    return F.least(requested_end, F.to_date(as_of - F.expr(f"INTERVAL {lag_hours} HOURS")))


def confirmed_window(df: DataFrame, day: str, start: dt.date, end: dt.date, as_of: dt.datetime, lag: int = 48) -> DataFrame:
    """Rows of the requested days that are confirmed as of a moment."""
    last = min(end, (as_of - dt.timedelta(hours=lag)).date())
    return df.where(F.col(day).between(F.lit(start), F.lit(last)))


def catalog_keyword_filter(videos: DataFrame, keyword: str, start: dt.date, end: dt.date) -> DataFrame:
    """Ids whose normalised title or description holds the normalised keyword, published in the local date range."""
    word = text.normalize_text(F.lit(keyword))
    hit = text.normalize_text("title").contains(word) | text.normalize_text("description").contains(word)
    day = F.to_date(dates.to_local("published_at"))
    kept = videos.where(hit & day.between(F.lit(start), F.lit(end)))
    return ordering.latest_per_key(
        kept.select("id", "title", "published_at"), ["id"], [F.col("published_at"), F.col("title")]
    )


def playlist_period_keyword_filter(
    videos: DataFrame,
    channel: str,
    keywords: list[str],
    start: dt.datetime | None,
    end: dt.datetime | None,
    limit: int,
) -> DataFrame:
    """First ``limit`` unique videos per channel, newest first, in a period and with any keyword.

    An unknown publish time passes the period.
    """
    unknown = F.col("published_at").isNull()
    rows = videos
    if start is not None:
        rows = rows.where(unknown | (F.col("published_at") >= F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        rows = rows.where(unknown | (F.col("published_at") <= F.lit(end).cast("timestamp_ntz")))
    words = [w for w in ("".join(k.lower().lstrip("#").split()) for k in keywords) if w]
    if words:
        hay = text.squash_keyword(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
        rows = rows.where(text.contains_any(hay, words))
    one = ordering.latest_per_key(
        rows.select(channel, "id", "title", "published_at"), [channel, "id"], [F.col("published_at"), F.col("title")]
    )
    return ordering.keep_top(one, [channel], [F.col("published_at").desc_nulls_last(), F.col("id")], limit)


def exclude_title_regex(df: DataFrame, column: str = "title", word: str = "OST") -> DataFrame:
    """Drop titles with the word on its own, ignoring case; a missing title stays."""
    return df.where(~F.coalesce(F.col(column).rlike(rf"(?i)\b{word}\b"), F.lit(False)))


def demo_views(main: DataFrame, demo: DataFrame) -> DataFrame:
    """Views behind each demographic row: the video's period views times the viewer percent."""
    views = main.groupBy("channel", "video_id").agg(F.sum("views").alias("_v"))
    rows = demo.groupBy("channel", "video_id", "age_group", "gender").agg(F.sum("viewer_pct").alias("viewer_pct"))
    joined = rows.join(views, ["channel", "video_id"], "left")
    weighted = F.coalesce("_v", F.lit(0.0)) * F.col("viewer_pct") / 100
    key = F.concat_ws("_", "age_group", "gender")
    return joined.select("channel", "video_id", key.alias("key"), weighted.alias("views"))


def video_demo_weighted(main: DataFrame, demo: DataFrame, per_video: bool = False) -> DataFrame:
    """Weighted views by demographic key, per channel or per video."""
    keys = ["channel", "video_id", "key"] if per_video else ["channel", "key"]
    return demo_views(main, demo).groupBy(*keys).agg(F.sum("views").alias("views"))


def demo_map(per_video: DataFrame) -> DataFrame:
    """Per video a map of demographic key to views (at most age groups x genders entries)."""
    entry = F.struct("key", "views")
    return per_video.groupBy("channel", "video_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("demo_stats")
    )


def video_enriched(videos: DataFrame, main: DataFrame, realtime: DataFrame) -> DataFrame:
    """Video list with period and real-time numbers, missing as 0; kept when either has views."""
    period = main.groupBy("video_id").agg(
        F.sum("views").alias("period_views"), F.sum("likes").alias("period_likes"), F.avg("avg_pct").alias("avg_pct")
    )
    live = realtime.groupBy("video_id").agg(
        F.max("viewCount").alias("rt_views"), F.max("likeCount").alias("rt_likes"), F.max("duration").alias("duration")
    )
    out = videos.join(period, "video_id", "left").join(live, "video_id", "left")
    out = out.fillna(0.0, subset=["period_views", "period_likes", "avg_pct"]).fillna(0, subset=["rt_views", "rt_likes"])
    out = out.withColumn("duration_min", dates.iso_duration_minutes("duration")).drop("duration")
    return out.where((F.col("period_views") > 0) | (F.col("rt_views") > 0))


def view_threshold_counts(df: DataFrame, views: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Videos at or above each threshold; a video of the top class counts in all."""
    return df.groupBy(*groups).agg(*[F.count_if(F.col(views) >= t).alias(f"at_least_{t}") for t in VIEW_THRESHOLDS])


def weighted_watch_pct(df: DataFrame, groups: tuple[str, ...] = (), views: str = "views", pct: str = "avg_pct") -> DataFrame:
    """View-weighted watch percent over rows where both are positive; 0 when there are none."""
    both = (F.col(views) > 0) & (F.col(pct) > 0)
    top = F.sum(F.when(both, F.col(views) * F.col(pct)))
    ratio = F.try_divide(top, F.sum(F.when(both, F.col(views))))
    return df.groupBy(*groups).agg(F.coalesce(ratio, F.lit(0.0)).alias("avg_view_pct"))


def channel_totals(videos: DataFrame, main: DataFrame, realtime: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Per channel: videos, period totals, weighted watch percent, real-time totals and threshold counts."""
    period = main.groupBy("channel", "video_id").agg(
        F.sum("views").alias("views"), F.sum("likes").alias("likes"), F.avg("avg_pct").alias("avg_pct")
    )
    live = realtime.groupBy("video_id").agg(F.max("viewCount").alias("rt_views"), F.max("likeCount").alias("rt_likes"))
    one = videos.select("channel", "video_id").distinct()
    rows = one.join(period, ["channel", "video_id"], "left").join(live, "video_id", "left")
    rows = rows.fillna(0.0, subset=["views", "likes", "avg_pct"]).fillna(0, subset=["rt_views", "rt_likes"])
    both = (F.col("views") > 0) & (F.col("avg_pct") > 0)
    watch = F.try_divide(
        F.sum(F.when(both, F.col("views") * F.col("avg_pct"))), F.sum(F.when(both, F.col("views")))
    )
    out = rows.groupBy("channel").agg(
        F.count("*").alias("video_count"),
        F.sum("views").alias("total_views"),
        F.sum("likes").alias("total_likes"),
        F.coalesce(watch, F.lit(0.0)).alias("avg_view_pct"),
        F.sum("rt_views").alias("rt_total_views"),
        F.sum("rt_likes").alias("rt_total_likes"),
        *[F.count_if(F.col("rt_views") >= t).alias(f"at_least_{t}") for t in VIEW_THRESHOLDS],
    )
    if shares is None:
        return out
    added = shares.groupBy("channel").agg(F.sum("shares").alias("total_shares"))
    return out.join(added, "channel", "left").fillna(0.0, subset=["total_shares"])


def multi_channel_merge(demo: DataFrame, dims: DataFrame) -> DataFrame:
    """Sum of all channels' counts by kind and key; Spark's partial sums are the per-channel step."""
    parts = demo.select(F.lit("demo").alias("dim"), "key", "views").unionByName(dims.select("dim", "key", "views"))
    return parts.groupBy("dim", "key").agg(F.sum("views").alias("views"))


def views_by_dimension(dims: DataFrame) -> DataFrame:
    """Views by traffic source, keyword and country in one pass, with labels.

    The catch-all search key is no keyword, and the home country is left out for the map.
    """
    wanted = (
        (F.col("dim") == "traffic")
        | ((F.col("dim") == "keyword") & (F.col("key") != NOT_A_KEYWORD))
        | ((F.col("dim") == "country") & ~F.col("key").isin(HOME_COUNTRY, COUNTRY_ISO3[HOME_COUNTRY]))
    )
    out = dims.where(wanted).groupBy("dim", "key").agg(F.sum("views").alias("views"))
    out = code_label_lookup(out, "key", TRAFFIC_NAMES, "_t")
    out = code_label_lookup(out, "key", COUNTRY_ISO3, "_c")
    label = F.when(F.col("dim") == "traffic", F.col("_t")).when(F.col("dim") == "country", F.col("_c"))
    return out.select("dim", "key", label.otherwise(F.col("key")).alias("label"), "views")


def daily_views(dims: DataFrame) -> DataFrame:
    """Views by day; keys that are no date are skipped."""
    day = F.when(F.col("key").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.to_date(F.try_to_timestamp("key", F.lit("yyyy-M-d"))))
    rows = dims.where(F.col("dim") == "day").select(day.alias("day"), F.coalesce("views", F.lit(0.0)).alias("views"))
    return rows.where(F.col("day").isNotNull()).groupBy("day").agg(F.sum("views").alias("views"))


def demographic_share(demo: DataFrame, total: DataFrame) -> DataFrame:
    """Views and percent of the total per age and gender, with the gender's total percent and the fixed age place.

    ``total`` is one row with total_views; a total of 0 or less counts as 1.
    """
    parts = F.split("key", "_")
    split = demo.where(F.size(parts) == 2).select(parts[0].alias("age"), parts[1].alias("gender"), "views")
    kept = split.where(F.col("age").isin(AGE_ORDER) & F.col("gender").isin(GENDERS))
    cells = kept.groupBy("age", "gender").agg(F.sum("views").alias("views"))
    base = F.when(F.col("total_views") > 0, F.col("total_views")).otherwise(F.lit(1.0))
    out = ordering.with_scalars(cells, total.select("total_views"))
    out = out.withColumn("share", F.col("views") * 100 / base)
    # 14 cells at most.
    by_gender = F.sum("share").over(Window.partitionBy("gender"))
    return out.select(
        F.regexp_replace("age", "age", "").alias("age"),
        "gender",
        "views",
        "share",
        by_gender.alias("gender_share"),
        grades.order_in("age", AGE_ORDER).cast("int").alias("age_order"),
    )


# ---- top-k ---------------------------------------------------------------------------------------------------


def top_videos(videos: DataFrame, n: int = 100) -> DataFrame:
    """One row per video, then the first ``n`` by period views."""
    one = ordering.latest_per_key(videos, ["video_id"], [F.col("period_views"), F.col("title")])
    return one.orderBy(F.col("period_views").desc(), "video_id").limit(n)


def top_keywords(dims: DataFrame, n: int = 10) -> DataFrame:
    rows = dims.where((F.col("dim") == "keyword") & (F.col("key") != NOT_A_KEYWORD))
    sums = rows.groupBy("key").agg(F.sum("views").alias("views"))
    return sums.orderBy(F.col("views").desc(), "key").limit(n)


def top_k_with_others(sums: DataFrame, key: str, value: str, k: int = 5, other: str = "기타") -> DataFrame:
    """The first ``k`` keys and one row with the rest.

    The k-th row comes from a top-k; the rest is one more sum, so no global window is needed.
    """
    order = [F.col(value).desc(), F.col(key)]
    best = sums.orderBy(*order).limit(k).withColumn("is_other", F.lit(False))
    # At most k rows are broadcast.
    rest = sums.join(F.broadcast(best.select(key)), key, "left_anti")
    added = rest.agg(F.lit(other).alias(key), F.sum(value).alias(value), F.count("*").alias("_n"))
    added = added.where(F.col("_n") > 0).select(key, value, F.lit(True).alias("is_other"))
    return best.select(key, value, "is_other").unionByName(added)
