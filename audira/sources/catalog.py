"""Video catalogue storage: partitioned scan and overwrite, incremental sync, capped appends and logs."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audira.functions import dates, text
from audira.operators.ordering import keep_top, latest_per_key, running_sums
from audira.session import cut_lineage

VIDEO = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("published_at", T.TimestampNTZType()),
        T.StructField("source_file", T.StringType()),
    ]
)
HIDDEN = ("_id", "source_file")
PARTITION = "source_file"

PLAYLIST_ITEMS = (
    "struct<items:array<struct<"
    "status:struct<privacyStatus:string>,"
    "snippet:struct<title:string,description:string,publishedAt:string,resourceId:struct<videoId:string>>,"
    "contentDetails:struct<videoId:string,videoPublishedAt:string>>>>"
)
VIDEO_LIST = (
    "struct<items:array<struct<id:string,"
    "statistics:struct<viewCount:string,likeCount:string,commentCount:string>,"
    "snippet:struct<title:string,channelTitle:string,publishedAt:string>,"
    "contentDetails:struct<duration:string>>>>"
)
_COMMENT = "struct<authorDisplayName:string,textDisplay:string,publishedAt:string,likeCount:string>"
COMMENT_THREADS = (
    "struct<items:array<struct<snippet:struct<videoId:string,totalReplyCount:int,"
    f"topLevelComment:struct<id:string,snippet:{_COMMENT}>>,"
    f"replies:struct<comments:array<struct<id:string,snippet:{_COMMENT}>>>>>>"
)


def scan_catalog_partition(catalog: DataFrame, source_file: str) -> DataFrame:
    """Rows of one partition without the two storage fields. On a partitioned table only that folder is read."""
    kept = [c for c in catalog.columns if c not in HIDDEN]
    return catalog.where(F.col(PARTITION) == source_file).select(*kept)


def search_catalog_pushdown(
    catalog: DataFrame, keywords: list[str], start: dt.datetime | None, end: dt.datetime | None
) -> DataFrame:
    """Date range and any keyword in title or description, ignoring case; three columns come back.

    Keywords lose their white space and are matched as they are otherwise; texts keep theirs.
    """
    hits = catalog
    if start is not None:
        hits = hits.where(F.col("published_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        hits = hits.where(F.col("published_at") <= F.lit(end).cast("timestamp_ntz"))
    words = ["".join(k.split()).lower() for k in keywords if k.strip()]
    if words:
        title = F.lower(F.coalesce("title", F.lit("")))
        description = F.lower(F.coalesce("description", F.lit("")))
        hits = hits.where(text.contains_any(title, words) | text.contains_any(description, words))
    return hits.select("id", "title", "published_at")


#: Code points of an index entry.
GRAM = 3


def write_searchable(catalog: DataFrame, path: str, files: int | None = None) -> None:
    """Store the catalogue for searches: ``rows``, dealt by publish time, and ``postings`` beside them.

    A row of ``rows`` has its file number (a partition folder) and its place in the file; files hold separate ranges of
    publish times, in order, so a date range reads few of them. ``postings`` has (gram, file, place) for every distinct
    three-letter piece of the lower-cased title and description. The task that holds a file's rows writes its postings, sorted
    by gram, so pieces are taken once and not shuffled, and a search reads only the pages that hold its grams. Without
    ``files`` there are as many as shuffle partitions, and three for each core at least: AQE would leave one for each.
    """
    spark = catalog.sparkSession
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    key = [F.col("published_at"), F.xxhash64("id", "title")]
    dealt = catalog.repartitionByRange(files, *key)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = dealt.sortWithinPartitions("published_at").select("*", F.spark_partition_id().alias("file"), place.alias("place"))
    stored = cut_lineage(numbered)
    stored.write.partitionBy("file").parquet(f"{path}/rows")
    grams = F.concat(*[_grams(F.lower(F.coalesce(c, F.lit("")))) for c in ("title", "description")])
    postings = stored.select(F.explode(F.array_distinct(grams)).alias("gram"), "file", "place")
    postings.sortWithinPartitions("gram").write.parquet(f"{path}/postings")


def _grams(value: Column) -> Column:
    """All overlapping pieces, in one pass over the text: a look-ahead takes each without moving past it."""
    return F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1)


def search_indexed(
    spark: SparkSession, path: str, schema: T.StructType, keywords: list[str], start: dt.datetime | None, end: dt.datetime | None
) -> DataFrame:
    """The rows of :func:`search_catalog_pushdown`, found in a stored catalogue by its postings.

    A keyword's candidates are the rows that hold all its grams; only their files and row groups are read, and each candidate
    is then checked for the keyword itself. A keyword shorter than a gram has no postings: then the rows are scanned, with
    the date range pushed down as always.
    """
    place = T.StructType([T.StructField("place", T.LongType()), T.StructField("file", T.IntegerType())])
    rows = spark.read.schema(T.StructType([*schema.fields, *place.fields])).parquet(f"{path}/rows")
    words = sorted({"".join(k.split()).lower() for k in keywords if k.strip()})
    if words and all(len(w) >= GRAM for w in words):
        postings = spark.read.schema("gram string, file int, place long").parquet(f"{path}/postings")
        pairs = [(w, w[i : i + GRAM]) for w in words for i in range(len(w) - GRAM + 1)]
        asked = sorted({g for _, g in pairs})
        needs = {w: len({g for v, g in pairs if v == w}) for w in words}
        hit = postings.where(F.col("gram").isin(asked)).groupBy("file", "place").agg(
            *[F.count(F.when(F.col("gram").isin(sorted({g for v, g in pairs if v == w})), 1)).alias(f"_n{i}") for i, w in enumerate(words)]
        )
        every = [F.col(f"_n{i}") == needs[w] for i, w in enumerate(words)]
        candidates = hit.where(reduce(lambda a, b: a | b, every)).select("file", "place")
        rows = rows.join(candidates, ["file", "place"], "left_semi")
    return search_catalog_pushdown(rows, keywords, start, end)


def overwrite_partition(videos: DataFrame, path: str, meta_path: str, updated_at: dt.datetime, source: str) -> None:
    """Replace the partitions present in ``videos`` and record count, time and source of each.

    Only the touched partition folders are rewritten. The metadata table is append-only; its latest row counts.
    """
    writer = videos.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(PARTITION).parquet(path)
    touched = videos.groupBy(PARTITION).agg(F.count("*").alias("count"))
    meta = touched.select(
        PARTITION,
        "count",
        F.lit(updated_at).cast("timestamp_ntz").alias("updated_at"),
        F.lit(source).alias("last_source"),
    )
    meta.write.mode("append").parquet(meta_path)


def latest_metadata(meta: DataFrame) -> DataFrame:
    return latest_per_key(meta, [PARTITION], [F.col("updated_at"), F.col("last_source")])


def store_bucketed(videos: DataFrame, table: str, buckets: int, path: str) -> None:
    """Store the cached side at ``path`` as a table bucketed by partition and id.

    A sync that reads it meets it bucket by bucket: only the incoming rows are shuffled, as long as the session's number of
    shuffle partitions is not above ``buckets``.
    """
    videos.write.bucketBy(buckets, PARTITION, "id").sortBy(PARTITION, "id").mode("overwrite").option("path", path).saveAsTable(table)


def incremental_catalog_sync(
    incoming: DataFrame,
    cached: DataFrame,
    last_update: DataFrame,
    as_of: dt.datetime,
    rescan_days: int = 7,
    first_load_days: int = 730,
) -> DataFrame:
    """New public videos inside the look-back of their partition plus the cached ones, one row per id.

    ``incoming`` has upload_at and privacy besides the video columns; ``last_update`` has one row per partition.
    A cached row wins over a new one of the same id; among new rows the latest upload wins.
    """
    first = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {first_load_days} DAYS")
    rescan = F.col("updated_at") - F.expr(f"INTERVAL {rescan_days} DAYS")
    dated = incoming.join(last_update.select(PARTITION, "updated_at"), PARTITION, "left")
    fresh = dated.where(
        (F.col("privacy") == "public")
        & F.col("published_at").isNotNull()
        & (F.col("upload_at") >= F.coalesce(rescan, first))
    )
    fresh = fresh.join(cached.select(PARTITION, "id"), [PARTITION, "id"], "left_anti")
    fresh = latest_per_key(fresh, [PARTITION, "id"], [F.col("upload_at"), F.col("title")])
    cols = [f.name for f in VIDEO]
    newest = [F.col("published_at"), F.col("title"), F.col("description")]
    # A stored cache is met by its keys as it lies; the rows without a key, which no bucket tells apart, are few.
    keyed = latest_per_key(cached.select(*cols), [PARTITION, "id"], newest, null_keys=False)
    keyless = cached.select(*cols).where(F.col(PARTITION).isNull() | F.col("id").isNull())
    return fresh.select(*cols).unionByName(keyed).unionByName(latest_per_key(keyless, [PARTITION, "id"], newest))


def latest_sync_status(catalog: DataFrame, time_column: str = "published_at") -> DataFrame:
    """Cached rows and last update (local time) of each partition."""
    grouped = catalog.groupBy(PARTITION).agg(F.count("*").alias("cached_videos"), F.max(time_column).alias("_u"))
    return grouped.select(
        PARTITION, "cached_videos", F.date_format(dates.to_local("_u"), "yyyy-MM-dd HH:mm").alias("last_update")
    )


def append_capped_csv(
    comments: DataFrame, order: list[Column], per_video: int, total: int, path: str | None = None
) -> DataFrame:
    """At most ``per_video`` comments of each video, whole videos until ``total`` is reached.

    The video that crosses the total is kept whole, as the check runs between videos. Videos go in id order.
    With ``path`` the rows are appended there as CSV.
    """
    capped = keep_top(comments, ["video_id"], order, per_video)
    sizes = capped.groupBy("video_id").agg(F.count("*").alias("_n"))
    placed = running_sums(sizes, [], [F.col("video_id")], F.col("_n"), before="_before", total=None)
    kept = capped.join(placed.where(F.col("_before") < total).select("video_id"), "video_id", "left_semi")
    if path:
        kept.write.mode("append").option("header", True).csv(path)
    return kept


def append_log(log: DataFrame, path: str) -> None:
    """Append log rows; array fields keep their type."""
    log.write.mode("append").parquet(path)


def flatten_playlist_items(pages: DataFrame, column: str = "body") -> DataFrame:
    """Public playlist items with a publish time, one row each, from JSON response pages."""
    parsed = pages.select(F.from_json(column, PLAYLIST_ITEMS).alias("p"))
    items = parsed.select(F.explode("p.items").alias("i"))
    return items.where(
        (F.col("i.status.privacyStatus") == "public") & (F.col("i.contentDetails.videoPublishedAt") != "")
    ).select(
        F.col("i.snippet.resourceId.videoId").alias("id"),
        F.col("i.snippet.title").alias("title"),
        F.col("i.contentDetails.videoPublishedAt").alias("date"),
        F.col("i.snippet.description").alias("description"),
    )


def _count(path: str) -> Column:
    return F.coalesce(F.col(path).try_cast("bigint"), F.lit(0))


def flatten_video_statistics(pages: DataFrame, column: str = "body") -> DataFrame:
    """Typed video statistics from JSON response pages; missing counts are 0."""
    parsed = pages.select(F.from_json(column, VIDEO_LIST).alias("p"))
    i = parsed.select(F.explode("p.items").alias("i"))
    seconds = dates.iso_duration_seconds("i.contentDetails.duration")
    published = F.col("i.snippet.publishedAt")
    stamp = F.try_to_timestamp(published, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    local = F.date_format(dates.to_local(stamp), "yyyy-MM-dd HH:mm:ss")
    return i.select(
        F.col("i.id").alias("video_id"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("i.id")).alias("video_url"),
        F.coalesce(F.col("i.snippet.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("i.snippet.channelTitle"), F.lit("")).alias("channelTitle"),
        F.coalesce(local, published, F.lit("")).alias("publishedAt"),
        dates.clock_text(seconds).alias("duration"),
        dates.video_kind(seconds).alias("shortType"),
        _count("i.statistics.viewCount").alias("viewCount"),
        _count("i.statistics.likeCount").alias("likeCount"),
        _count("i.statistics.commentCount").alias("commentCount"),
    )


def flatten_comment_threads(pages: DataFrame, include_replies: bool = True, column: str = "body") -> DataFrame:
    """One row per top comment and, if asked, per reply of a thread that reports replies."""
    parsed = pages.select(F.from_json(column, COMMENT_THREADS).alias("p"))
    threads = parsed.select(F.explode("p.items").alias("t"))

    def row(c: str, parent: Column, reply: int) -> list[Column]:
        return [
            F.col("t.snippet.videoId").alias("video_id"),
            F.col(f"{c}.id").alias("comment_id"),
            parent.alias("parent_id"),
            F.lit(reply).alias("isReply"),
            F.coalesce(F.col(f"{c}.snippet.authorDisplayName"), F.lit("")).alias("author"),
            F.coalesce(F.col(f"{c}.snippet.textDisplay"), F.lit("")).alias("text"),
            F.coalesce(F.col(f"{c}.snippet.publishedAt"), F.lit("")).alias("publishedAt"),
            _count(f"{c}.snippet.likeCount").alias("likeCount"),
        ]

    top = threads.select(*row("t.snippet.topLevelComment", F.lit(""), 0))
    if not include_replies:
        return top
    replies = threads.where(F.coalesce("t.snippet.totalReplyCount", F.lit(0)) > 0)
    replies = replies.select("t", F.explode("t.replies.comments").alias("c"))
    return top.unionByName(replies.select(*row("c", F.col("t.snippet.topLevelComment.id"), 1)))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VIDEO).parquet(path)
