"""Bindings of the shared test tables to the analytic inputs, in Spark and as SQL text of the oracle.

The fact ``metric_long`` is lineitem unpivoted over named measures. Attributes that need a join (slot, segment,
title type) are only joined when asked for.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from audira.functions.exact import exact_sum, exact_sum_sql
from audira.operators import ordering
from audira.operators.prelaunch import PrelaunchSpec
from audira.session import store_rows
from audira.specs import AnchorRule, GrowthSpec, MetricSpec, ViewRouting

# Measures of the fact; the expressions mean the same in both engines.
MEASURES = {
    "rating": "CAST(floor(l_discount * 100 + 0.5) AS DOUBLE)",
    "home": "CAST(floor(l_tax * 100 + 0.5) AS DOUBLE)",
    "audience": "l_quantity",
    "views": "l_extendedprice",
    "mentions": "l_quantity * l_linenumber",
    "buzz": "CAST(floor(l_extendedprice / 100) AS DOUBLE)",
    "rank": "CAST(l_linenumber AS DOUBLE)",
    "ext_rank": "CAST(CAST(l_quantity AS INTEGER) % 11 AS DOUBLE)",
    "aware": "CAST(floor(l_tax * 100 + 1.5) AS DOUBLE)",
    "prefer": "CAST(floor(l_discount * 100 + 1.5) AS DOUBLE)",
    "intent": "CAST(l_linenumber AS DOUBLE)",
    "s_story": "CAST(l_linenumber % 3 AS DOUBLE)",
    "s_cast": "CAST(l_suppkey % 5 AS DOUBLE)",
}
MEDIA = ["LIVE", "QUICK", "VOD"]
SLOTS = ["ECONOMY", "STANDARD", "PROMO", "MEDIUM", "SMALL", "LARGE"]
ROUTING = ViewRouting("views", "ko", "en", "LIVE", ("PGC", "UGC"))
ANCHOR = AnchorRule(
    1998, {"ECONOMY": 5.2, "PROMO": 5.0, "LARGE": 5.4}, {"ECONOMY": 4.8, "PROMO": 4.6, "SMALL": 5.1}, (3,)
)
DETAIL = (
    MetricSpec("target_rating", "rating"),
    MetricSpec("household_rating", "home"),
    MetricSpec("live_uv", "audience", "step_sum", ("LIVE",)),
    MetricSpec("quick_uv", "audience", "step_sum", ("QUICK",)),
    MetricSpec("vod_uv", "audience", "vod", ("VOD", "QUICK")),
    MetricSpec("external_rank", "ext_rank", "min", cutoff="week", high_is_good=False),
    MetricSpec("mentions", "mentions", "sum", cutoff="week"),
    MetricSpec("buzz_score", "buzz", cutoff="week"),
)
# All twelve KPIs of the detail page.
DETAIL_PAGE = (
    *DETAIL[:5],
    MetricSpec("other_platform", "prefer", "step_sum", ("VOD",)),
    MetricSpec("external_rank", "EXT-Rank", "min", cutoff="week", high_is_good=False, normalized=True),
    MetricSpec("mentions", "mentions", "sum", cutoff="week"),
    MetricSpec("views_total", "views", "sum", views="total", cutoff="week"),
    MetricSpec("views_foreign", "views", "sum", views="foreign", cutoff="week"),
    MetricSpec("buzz_rank", "rank", "min", cutoff="week", high_is_good=False, normalized=True),
    MetricSpec("buzz_score", "buzz", cutoff="week", keep_zero=True, normalized=True, group_mode="rows"),
)
OVERVIEW = (
    MetricSpec("target_rating", "rating"),
    MetricSpec("household_rating", "home"),
    MetricSpec("live_uv", "audience", "step_sum", ("LIVE",)),
    MetricSpec("quick_uv", "audience", "step_sum", ("QUICK",)),
    MetricSpec("vod_uv", "audience", "step_sum", ("VOD",)),
    MetricSpec("mentions", "mentions", "sum"),
    MetricSpec("views", "views", "sum", views="total"),
    MetricSpec("buzz_rank", "rank", "min", keep_zero=True),
    MetricSpec("buzz_score", "buzz", "step_sum"),
)
SEVEN = (
    MetricSpec("target_rating", "rating"),
    MetricSpec("household_rating", "home"),
    MetricSpec("vod_uv", "audience", "vod", ("VOD", "QUICK")),
    MetricSpec("live_uv", "audience", "step_sum", ("LIVE",)),
    MetricSpec("views", "views", "sum", views="total"),
    MetricSpec("mentions", "mentions", "sum"),
    MetricSpec("buzz_score", "buzz"),
)
BROADCAST = (
    GrowthSpec("household_rating", "home"),
    GrowthSpec("target_rating", "rating"),
    GrowthSpec("live", "audience", "sum", ("LIVE",)),
    GrowthSpec("vod", "audience", "sum", ("VOD",), flag_factor=1.4),
)
DIGITAL = (GrowthSpec("views", "views", "sum", views="total"), GrowthSpec("buzz", "buzz"))
PRELAUNCH = PrelaunchSpec(
    ("s_story", "s_cast"), ("aware", "prefer", "intent"), "mentions", "buzz", "rank", routing=ROUTING
)
CURRENT_YEAR = 2026
AS_OF = dt.datetime(2024, 1, 30, 12, 0, 0)


# Explicit schemas: reading starts no job to look at file footers.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def entity_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity: slot, start date and year."""
    start = F.expr("date_add(DATE'1996-01-01', CAST(p_partkey * 37 % 1800 AS INT))")
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("slot"), start.alias("start_date"),
        F.year(start).alias("year"),
    )


def metric_long(
    spark: SparkSession, sf_dir: str, metrics: list[str], slot: bool = False, title: bool = False
) -> DataFrame:
    """The long fact over some measures. ``slot`` joins part; ``title`` joins orders for segment and title type."""
    line = table(spark, sf_dir, "lineitem")
    weeks = "floor(datediff(l_shipdate, DATE'1998-04-01') / 91)"
    base = line.selectExpr(
        "l_partkey AS entity_id",
        "date_add(DATE'1996-01-01', CAST(l_partkey * 37 % 1800 AS INT)) AS start_date",
        "year(date_add(DATE'1996-01-01', CAST(l_partkey * 37 % 1800 AS INT))) AS year",
        "l_linenumber AS step_no",
        "CAST(date_trunc('WEEK', l_shipdate) AS DATE) AS week_start",
        f"CAST(CASE WHEN {weeks} BETWEEN -6 AND -1 THEN {weeks} WHEN {weeks} BETWEEN 0 AND 1 THEN {weeks} + 1 END"
        " AS INT) AS week_no",
        "CASE l_returnflag WHEN 'A' THEN 'LIVE' WHEN 'N' THEN 'QUICK' ELSE 'VOD' END AS media",
        "CASE WHEN l_linestatus = 'F' THEN 'PGC' ELSE 'ETC' END AS attr1",
        "CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS flag_netflix",
        "l_orderkey",
        *[f"{MEASURES[m]} AS _m{i}" for i, m in enumerate(metrics)],
    )
    label = F.when(F.col("week_no") < 0, F.concat(F.lit("W"), F.col("week_no").cast("string")))
    label = label.when(F.col("week_no") > 0, F.concat(F.lit("W+"), F.col("week_no").cast("string")))
    base = base.withColumn("week_label", label)
    if title:
        orders = table(spark, sf_dir, "orders").selectExpr(
            "o_orderkey AS l_orderkey",
            "concat(CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' ELSE 'X' END,"
            " substring(o_orderpriority, 1, 1), '5') AS segment",
            "CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2') THEN 'ko' ELSE 'en' END AS attr3",
        )
        base = base.join(orders, "l_orderkey")
    if slot:
        base = base.join(entity_dim(spark, sf_dir).select("entity_id", "slot"), "entity_id")
    kept = [c for c in base.columns if c != "l_orderkey" and not c.startswith("_m")]
    pairs = ", ".join(f"'{m}', _m{i}" for i, m in enumerate(metrics))
    if len(metrics) == 1:
        return base.select(*kept, F.lit(metrics[0]).alias("metric"), F.col("_m0").alias("value"))
    return base.select(*kept, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)"))


def metric_long_sql(metrics: list[str]) -> str:
    """The same fact as CTEs ``ent`` and ``ml`` of the oracle, without the leading WITH."""
    union = "\n  UNION ALL ".join(
        f"SELECT entity_id, slot, start_date, year, step_no, week_start, week_no, week_label, media, segment, attr1,"
        f" attr3, flag_netflix, '{m}' AS metric, m_{m} AS value FROM base"
        for m in metrics
    )
    measures = ", ".join(f"{MEASURES[m]} AS m_{m}" for m in metrics)
    return f"""ent AS (
  SELECT p_partkey AS entity_id, p_type AS slot,
    DATE '1996-01-01' + CAST(p_partkey * 37 % 1800 AS INTEGER) AS start_date,
    CAST(year(DATE '1996-01-01' + CAST(p_partkey * 37 % 1800 AS INTEGER)) AS INTEGER) AS year FROM part),
quarters AS (
  SELECT *, CAST(floor(date_diff('day', DATE '1998-04-01', CAST(l_shipdate AS DATE)) / 91.0) AS INTEGER) AS q
  FROM lineitem),
base AS (
  SELECT entity_id, slot, start_date, year, l_linenumber AS step_no,
    CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start,
    CASE WHEN q BETWEEN -6 AND -1 THEN q WHEN q BETWEEN 0 AND 1 THEN q + 1 END AS week_no,
    CASE WHEN q BETWEEN -6 AND -1 THEN 'W' || q WHEN q BETWEEN 0 AND 1 THEN 'W+' || (q + 1) END AS week_label,
    CASE l_returnflag WHEN 'A' THEN 'LIVE' WHEN 'N' THEN 'QUICK' ELSE 'VOD' END AS media,
    CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' ELSE 'X' END || substr(o_orderpriority, 1, 1) || '5'
      AS segment,
    CASE WHEN l_linestatus = 'F' THEN 'PGC' ELSE 'ETC' END AS attr1,
    CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'ko' ELSE 'en' END AS attr3,
    CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS flag_netflix, {measures}
  FROM quarters JOIN orders ON o_orderkey = l_orderkey JOIN ent ON entity_id = l_partkey),
ml AS ({union})"""


# Predicates of routed view rows, for the oracle.
LOCAL_SQL = "(metric = 'views' AND attr3 = 'ko' AND (media <> 'LIVE' OR attr1 IN ('PGC', 'UGC')))"
FOREIGN_SQL = "(metric = 'views' AND attr3 = 'en')"
TOTAL_SQL = f"({LOCAL_SQL} OR {FOREIGN_SQL})"


# ---- persons -------------------------------------------------------------------------------------------------


def work_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x brand: buzz, weeks and the person's place within the work.

    Sums are exact, so they do not depend on the order of addition.
    """
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    rows = rows.select(
        F.col("o_custkey").alias("person"), F.col("p_brand").alias("work"), "l_extendedprice", F.date_trunc("WEEK", "l_shipdate").alias("_week")
    )
    # One shuffle serves weeks and sums, as a week's rows lie side by side: a line is nearly a week of its own, so adding up
    # before the shuffle would not make it smaller.
    before = F.lag("_week").over(Window.partitionBy("person", "work").orderBy("_week"))
    weeks = rows.repartition("person", "work").withColumn("_new", F.col("_week").isNotNull() & ~F.col("_week").eqNullSafe(before))
    pairs = ordering.settle(
        weeks.groupBy("person", "work").agg(
            exact_sum("l_extendedprice", 2).alias("person_buzz"), F.count_if("_new").cast("double").alias("weeks_ranked")
        )
    )
    placed = ordering.with_position(pairs, ["work"], [F.col("person_buzz").desc(), F.col("person")], "rank_in_work")
    sums = store_rows(pairs.groupBy("work").agg(exact_sum("person_buzz", 2).alias("_sum"), F.count("*").alias("_n")))
    out = ordering.join_small(placed, sums, ["work"])
    return out.select(
        "person",
        "work",
        F.col("_sum").alias("work_buzz"),
        "person_buzz",
        "weeks_ranked",
        F.col("_n").cast("double").alias("persons_ranked"),
        F.col("rank_in_work").cast("double").alias("rank_in_work"),
    )


WORK_PERSON_SQL = """pairs AS (
  SELECT o_custkey AS person, p_brand AS work, """ + exact_sum_sql("l_extendedprice", 2) + """ AS person_buzz,
    CAST(count(DISTINCT date_trunc('week', l_shipdate)) AS DOUBLE) AS weeks_ranked
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
wp AS (
  SELECT person, work, CAST(round(sum(CAST(person_buzz AS DECIMAL(28,8))) OVER (PARTITION BY work), 2) AS DOUBLE) AS work_buzz, person_buzz, weeks_ranked,
    CAST(count(*) OVER (PARTITION BY work) AS DOUBLE) AS persons_ranked,
    CAST(row_number() OVER (PARTITION BY work ORDER BY person_buzz DESC, person) AS DOUBLE) AS rank_in_work
  FROM pairs)"""

SEGMENT_GENDER = {"AUTOMOBILE": "남자", "BUILDING": "F", "FURNITURE": "M", "HOUSEHOLD": "여성", "MACHINERY": "unknown"}


def person_dim_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [x for k, v in SEGMENT_GENDER.items() for x in (F.lit(k), F.lit(v))]
    gender = F.coalesce(F.try_element_at(F.create_map(*names), F.col("c_mktsegment")), F.lit("?"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("person"),
        gender.alias("gender_text"),
        (F.lit(1955) + 2 * F.col("c_nationkey")).cast("string").alias("birth_year"),
    )


def person_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from audira.sources.tables import load_person_dim

    dim = load_person_dim(person_dim_raw(spark, sf_dir), CURRENT_YEAR)
    return dim.withColumn("person", F.col("person").cast("bigint"))


PERSON_DIM_SQL = f"""ages AS (
  SELECT c_custkey AS person, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '남' WHEN 'FURNITURE' THEN '남'
      WHEN 'BUILDING' THEN '여' WHEN 'HOUSEHOLD' THEN '여' ELSE '미상' END AS gender,
    1955 + 2 * c_nationkey AS birth_year, {CURRENT_YEAR} - (1955 + 2 * c_nationkey) + 1 AS age FROM customer),
dim AS (
  SELECT person, gender, birth_year, age, CASE WHEN age < 20 THEN '20대 미만' WHEN age < 30 THEN '20대'
    WHEN age < 40 THEN '30대' WHEN age < 50 THEN '40대' ELSE '50대' END AS age_group FROM ages)"""


# ---- videos --------------------------------------------------------------------------------------------------

def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a video catalogue; whole texts are both the titles and the descriptions."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("title"),
        F.col("text").alias("description"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 720 AS INT))").alias("published_at"),
        F.col("source").alias("source_file"),
        F.when(F.col("lang") == "de", F.lit("private")).otherwise(F.lit("public")).alias("privacy"),
        "n_chars",
    )


CATALOG_SQL = """catalog AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, text AS title, text AS description,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS published_at, source AS source_file,
    CASE WHEN lang = 'de' THEN 'private' ELSE 'public' END AS privacy, n_chars FROM documents)"""

AGE_BY_TYPE = {"click": "age18-24", "view": "age25-34", "purchase": "age35-44", "signup": "age45-54", "error": "age65-"}


def video_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main report: views, likes and watch percent of a video, one row per video and day."""
    events = table(spark, sf_dir, "events")
    rows = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.round(F.sum("value"), 2).alias("views"),
        F.count_if(F.col("event_type") == "click").cast("double").alias("likes"),
        F.round(F.avg(F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)")), 6).alias("avg_pct"),
    )
    return rows.select(
        (F.col("user_id") % 5).alias("channel"), F.col("user_id").alias("video_id"), "day", "views", "likes", "avg_pct"
    )


MAIN_SQL = """main AS (
  SELECT user_id % 5 AS channel, user_id AS video_id, CAST(ts AS DATE) AS day, round(sum(value), 2) AS views,
    CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS likes,
    round(avg(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)), 6) AS avg_pct
  FROM events GROUP BY 1, 2, 3)"""


def video_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewer percent of a video by age group (from the event type) and gender (from the event's parity)."""
    events = table(spark, sf_dir, "events")
    names = [x for k, v in AGE_BY_TYPE.items() for x in (F.lit(k), F.lit(v))]
    age = F.create_map(*names)[F.col("event_type")]
    gender = F.when(F.col("event_id") % 2 == 0, F.lit("male")).otherwise(F.lit("female"))
    cells = events.groupBy(F.col("user_id").alias("video_id"), age.alias("age_group"), gender.alias("gender")).agg(
        F.count("*").alias("_n")
    )
    totals = cells.groupBy("video_id").agg(F.sum("_n").alias("_t"))
    return cells.join(totals, "video_id").select(
        (F.col("video_id") % 5).alias("channel"), "video_id", "age_group", "gender",
        (F.col("_n") * 100.0 / F.col("_t")).alias("viewer_pct"),
    )


DEMO_SQL = """cells AS (
  SELECT user_id AS video_id, CASE event_type WHEN 'click' THEN 'age18-24' WHEN 'view' THEN 'age25-34'
    WHEN 'purchase' THEN 'age35-44' WHEN 'signup' THEN 'age45-54' ELSE 'age65-' END AS age_group,
    CASE WHEN event_id % 2 = 0 THEN 'male' ELSE 'female' END AS gender, count(*) AS n
  FROM events GROUP BY 1, 2, 3),
demo AS (
  SELECT video_id % 5 AS channel, video_id, age_group, gender,
    n * 100.0 / sum(n) OVER (PARTITION BY video_id) AS viewer_pct FROM cells)"""

# Codes of the dimension report.
TRAFFIC_BY_TYPE = {"click": "YT_SEARCH", "view": "RELATED_VIDEO", "purchase": "EXT_URL", "signup": "PLAYLIST", "error": "OTHER"}
COUNTRIES = ["KR", "US", "JP", "VN", "TH", "ID", "XX"]


def video_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension report: views by traffic source, keyword, country and day. One scan, four rows per event."""
    events = table(spark, sf_dir, "events")
    names = [x for k, v in TRAFFIC_BY_TYPE.items() for x in (F.lit(k), F.lit(v))]
    number = F.regexp_extract("props", "([0-9]+)", 1)
    keyword = F.when(number == "7", F.lit("GOOGLE_SEARCH")).otherwise(F.concat(F.lit("kw"), number))
    country = F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), (F.col("event_id") % 7 + 1).cast("int"))
    day = F.when(F.col("event_id") % 97 == 0, F.lit("unknown")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    pairs = {
        "traffic": F.create_map(*names)[F.col("event_type")],
        "keyword": keyword,
        "country": country,
        "day": day,
    }
    structs = F.array(*[F.struct(F.lit(d).alias("dim"), k.alias("key")) for d, k in pairs.items()])
    rows = events.select((F.col("user_id") % 5).alias("channel"), F.inline(structs), F.col("value").alias("views"))
    return rows.groupBy("channel", "dim", "key").agg(F.round(F.sum("views"), 2).alias("views"))


DIMS_SQL = """coded AS (
  SELECT user_id % 5 AS channel, CASE event_type WHEN 'click' THEN 'YT_SEARCH' WHEN 'view' THEN 'RELATED_VIDEO'
      WHEN 'purchase' THEN 'EXT_URL' WHEN 'signup' THEN 'PLAYLIST' ELSE 'OTHER' END AS traffic,
    CASE WHEN regexp_extract(props, '([0-9]+)', 1) = '7' THEN 'GOOGLE_SEARCH'
      ELSE 'kw' || regexp_extract(props, '([0-9]+)', 1) END AS keyword,
    CASE event_id % 7 WHEN 0 THEN 'KR' WHEN 1 THEN 'US' WHEN 2 THEN 'JP' WHEN 3 THEN 'VN' WHEN 4 THEN 'TH'
      WHEN 5 THEN 'ID' ELSE 'XX' END AS country,
    CASE WHEN event_id % 97 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS day, value FROM events),
dims AS (
  SELECT channel, dim, key, round(sum(value), 2) AS views FROM (
    SELECT channel, 'traffic' AS dim, traffic AS key, value FROM coded
    UNION ALL SELECT channel, 'keyword', keyword, value FROM coded
    UNION ALL SELECT channel, 'country', country, value FROM coded
    UNION ALL SELECT channel, 'day', day, value FROM coded) GROUP BY 1, 2, 3)"""


def video_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    return ids.select(
        (F.col("user_id") % 5).alias("channel"), F.col("user_id").alias("video_id"),
        F.concat(F.lit("video "), F.col("user_id").cast("string")).alias("title"),
    )


RECENT = AS_OF


def realtime(spark: SparkSession, sf_dir: str, recent_only: bool = False) -> DataFrame:
    """Real-time statistics of a video; with ``recent_only`` videos without a recent event have none."""
    sums = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video_id")).agg(
        F.sum("value").alias("_v"), F.count("*").alias("_n"), F.max("ts").alias("_last")
    )
    recent = F.col("_last") >= F.lit(RECENT).cast("timestamp_ntz")
    return sums.where(recent if recent_only else F.lit(True)).select(
        "video_id",
        F.floor(F.round("_v", 2) * 120).alias("viewCount"),
        F.col("_n").alias("likeCount"),
        F.concat(F.lit("PT"), (F.col("video_id") % 3).cast("string"), F.lit("M"), (F.col("_n") % 60).cast("string"), F.lit("S")).alias("duration"),
    )


LIST_SQL = """videos AS (
  SELECT DISTINCT user_id % 5 AS channel, user_id AS video_id, 'video ' || user_id AS title FROM events),
all_realtime AS (
  SELECT user_id AS video_id, CAST(floor(round(sum(value), 2) * 120) AS BIGINT) AS rt_views, count(*) AS rt_likes,
    user_id % 3 * 60 + count(*) % 60 AS seconds, max(ts) >= TIMESTAMP '2024-01-30 12:00:00' AS recent FROM events GROUP BY user_id),
realtime AS (SELECT * FROM all_realtime WHERE recent)"""


# ---- comments, accounts --------------------------------------------------------------------------------------


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"),
        F.format_string("%d-%d", "conv_id", "turn").alias("comment_id"),
        "turn",
        (F.col("turn") > 0).cast("int").alias("isReply"),
        F.col("role").alias("author"),
        "text",
        F.length("text").cast("bigint").alias("likeCount"),
    )


COMMENTS_SQL = """comments AS (
  SELECT conv_id AS video_id, conv_id || '-' || turn AS comment_id, turn, CASE WHEN turn > 0 THEN 1 ELSE 0 END AS isReply,
    role AS author, text, length(text) AS likeCount FROM conversations)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sessions: some never seen again, some revoked, all valid for twelve hours."""
    hours = "make_dt_interval(0, 12)"
    return table(spark, sf_dir, "events").selectExpr(
        "user_id",
        "event_type AS source_app",
        "ts AS created_at",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + make_dt_interval(0, 0, CAST(event_id % 240 AS INT)) END"
        " AS last_seen_at",
        f"ts + {hours} AS expires_at",
        "CASE WHEN event_id % 11 = 0 THEN ts END AS revoked_at",
        "event_type <> 'error' AS is_active",
    )


SESSIONS_SQL = """sessions AS (
  SELECT user_id, event_type AS source_app, ts AS created_at,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + to_minutes(CAST(event_id % 240 AS INTEGER)) END AS last_seen_at,
    ts + INTERVAL 12 HOUR AS expires_at, CASE WHEN event_id % 11 = 0 THEN ts END AS revoked_at,
    event_type <> 'error' AS is_active FROM events)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("department"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST(c_custkey % 365 AS INT))").alias("created_at"),
        (F.col("c_acctbal") >= 0).alias("stored"),
        F.array(
            F.concat(F.lit("app"), (F.col("c_nationkey") % 4).cast("string")),
            F.concat(F.lit("app"), (F.col("c_custkey") % 6).cast("string")),
        ).alias("allowed_apps"),
    )


USERS_SQL = """users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS department,
    lower(replace(c_name, '#', '.')) || '@example.com' AS email,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at,
    c_acctbal >= 0 AS stored, 'app' || (c_nationkey % 4) AS app1, 'app' || (c_custkey % 6) AS app2 FROM customer)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + reduce(lambda a, b: a + ",\n" + b, parts) + "\n"
