"""Queries that apply the column expressions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from audira.functions import dates, grades, segments, text
from audira.operators import ordering
from audira.plans.registry import query
from audira.sources import bindings as b
from audira.sources import tables
from audira.sources.bindings import CURRENT_YEAR, PERSON_DIM_SQL, with_ctes


@query(
    "parse_number",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS price,
  l_discount * 100 AS discount, CAST(0 AS DOUBLE) AS bad FROM lineitem""",
    {"price": 2, "discount": 3},
)
def parse_number(spark, d):
    line = b.table(spark, d, "lineitem")
    price = F.when(F.col("l_linenumber") == 7, F.lit("None")).otherwise(F.concat(F.lit(" "), F.format_number("l_extendedprice", 2)))
    return line.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        text.parse_number(price).alias("price"),
        text.parse_number(F.concat(F.format_string("%.4f", F.col("l_discount") * 100), F.lit("%"))).alias("discount"),
        text.parse_number(F.col("l_returnflag"), default=0.0).alias("bad"),
    )


@query(
    "extract_step",
    "SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS INTEGER) AS step, NULL::INTEGER AS none FROM customer",
)
def extract_step(spark, d):
    return b.table(spark, d, "customer").select(
        "c_custkey", text.extract_step("c_name").alias("step"), text.extract_step("c_mktsegment").alias("none")
    )


@query(
    "extract_week_no",
    "SELECT c_custkey, CAST(-(c_nationkey % 7) AS INTEGER) AS week_no FROM customer",
)
def extract_week_no(spark, d):
    label = F.concat(F.lit("W-"), (F.col("c_nationkey") % 7).cast("string"), F.lit("주차"))
    return b.table(spark, d, "customer").select("c_custkey", text.extract_week_no(label).alias("week_no"))


@query(
    "normalize_text",
    "SELECT doc_id, md5(lower(regexp_replace(text, '[^A-Za-z0-9가-힣]', '', 'g'))) AS digest FROM documents",
)
def normalize_text(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.md5(text.normalize_text("text")).alias("digest"))


@query(
    "squash_keyword",
    "SELECT doc_id, md5(regexp_replace(lower(substr(text, 1)), '[\\s\\x0B\\x1C-\\x1F\\p{Z}]', '', 'g')) AS digest FROM documents",
)
def squash_keyword(spark, d):
    # The hash signs in front are dropped again.
    marked = F.concat(F.lit("##"), F.col("text"))
    plain = b.table(spark, d, "documents").where(~F.col("text").startswith("#"))
    hashed = b.table(spark, d, "documents").where(F.col("text").startswith("#"))
    out = plain.select("doc_id", F.md5(text.squash_keyword(marked)).alias("digest"))
    kept = F.md5(F.regexp_replace(F.lower("text"), text.SPACE, "")).alias("digest")
    return out.unionByName(hashed.select("doc_id", kept))


@query(
    "normalize_week_label",
    "SELECT l_orderkey, l_linenumber, l_partkey, 'W' || l_linenumber AS label FROM lineitem",
)
def normalize_week_label(spark, d):
    label = F.concat(F.lit("W+"), F.col("l_linenumber").cast("string"), F.lit("주차 "))
    return b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.normalize_week_label(label).alias("label")
    )


SEGMENT_SQL = """seg AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'male ' ELSE 'f' END ||
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(o_custkey % 90 AS VARCHAR) END AS segment, o_custkey % 90 AS age, o_orderstatus,
  o_orderkey % 9 = 0 AS blank FROM orders)"""


def _segments(spark, d):
    status = F.col("o_orderstatus")
    head = F.when(status == "F", F.lit("F")).when(status == "O", F.lit("male ")).otherwise(F.lit("f"))
    tail = F.when(F.col("o_orderkey") % 9 == 0, F.lit("")).otherwise((F.col("o_custkey") % 90).cast("string"))
    return b.table(spark, d, "orders").select("o_orderkey", F.concat(head, tail).alias("segment"))


@query(
    "segment_gender",
    with_ctes(SEGMENT_SQL)
    + "SELECT o_orderkey, segment, CASE o_orderstatus WHEN 'F' THEN '여' WHEN 'O' THEN '남' ELSE '기타' END AS gender FROM seg",
)
def segment_gender(spark, d):
    return _segments(spark, d).withColumn("gender", segments.segment_gender("segment"))


@query(
    "segment_decade",
    with_ctes(SEGMENT_SQL)
    + """SELECT o_orderkey, CASE WHEN blank THEN '기타' ELSE (age // 10 * 10) || '대' END AS decade,
  CASE WHEN NOT blank THEN greatest(10, least(60, age // 10 * 10)) || '대' END AS clamped FROM seg""",
)
def segment_decade(spark, d):
    return _segments(spark, d).select(
        "o_orderkey",
        segments.segment_decade("segment").alias("decade"),
        segments.segment_decade("segment", clamped=True).alias("clamped"),
    )


@query(
    "segment_label",
    with_ctes(SEGMENT_SQL)
    + """SELECT o_orderkey, CASE WHEN NOT blank AND o_orderstatus IN ('F', 'O') THEN greatest(10, least(60, age // 10 * 10)) || '대' ||
  CASE o_orderstatus WHEN 'F' THEN '여성' ELSE '남성' END END AS label FROM seg""",
)
def segment_label(spark, d):
    return _segments(spark, d).select("o_orderkey", segments.segment_label("segment").alias("label"))


@query("normalize_gender", with_ctes(PERSON_DIM_SQL) + "SELECT person, gender FROM dim")
def normalize_gender(spark, d):
    raw = b.person_dim_raw(spark, d)
    return raw.select(F.col("person").cast("bigint").alias("person"), grades.normalize_gender("gender_text").alias("gender"))


@query("age_group", with_ctes(PERSON_DIM_SQL) + "SELECT person, age, age_group FROM dim")
def age_group(spark, d):
    year = text.parse_number("birth_year").cast("int")
    return b.person_dim_raw(spark, d).select(
        F.col("person").cast("bigint").alias("person"),
        grades.counted_age(year, CURRENT_YEAR).alias("age"),
        grades.age_group(year, CURRENT_YEAR).alias("age_group"),
    )


GRADE_CASES = " ".join(f"WHEN p >= {floor} THEN '{g}'" for g, floor in grades.GRADE_FLOORS.items())
GRADE_SQL = f"""WITH r AS (SELECT event_id, (event_id % 1000) / 1000.0 AS p FROM events),
g AS (SELECT event_id, CASE {GRADE_CASES} ELSE 'C' END AS grade FROM r)
"""


def _graded(spark, d):
    p = (F.col("event_id") % 1000) / 1000.0
    return b.table(spark, d, "events").select("event_id", grades.grade_from_percentile(p).alias("grade"))


@query("grade_from_percentile", GRADE_SQL + "SELECT event_id, grade FROM g")
def grade_from_percentile(spark, d):
    return _graded(spark, d)


@query(
    "tier_of_grade",
    GRADE_SQL + "SELECT event_id, CASE WHEN grade = 'S' THEN 'S' ELSE substr(grade, 1, 1) END AS tier FROM g",
)
def tier_of_grade(spark, d):
    return _graded(spark, d).select("event_id", grades.tier_of_grade("grade").alias("tier"))


@query(
    "grade_group",
    GRADE_SQL + "SELECT event_id, CASE WHEN substr(grade, 1, 1) IN ('S', 'A') THEN 'S·A' ELSE substr(grade, 1, 1) END AS grp FROM g",
)
def grade_group(spark, d):
    return _graded(spark, d).select("event_id", grades.grade_group("grade").alias("grp"))


@query(
    "parse_loose_date",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS day FROM lineitem""",
)
def parse_loose_date(spark, d):
    ship = F.col("l_shipdate")
    kind = F.col("l_linenumber") % 4
    raw = (
        F.when(kind == 0, F.date_format(ship, "yyyy. M. d"))
        .when(kind == 1, F.date_format(ship, "yyyy/MM/dd"))
        .when(kind == 2, F.date_format(ship, " yyyy-MM-dd "))
        .otherwise(F.lit("soon"))
    )
    return b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", dates.parse_loose_date(raw).alias("day")
    )


@query(
    "normalize_year",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(2000 + o_custkey % 100 AS INTEGER) WHEN 1 THEN CAST(year(o_orderdate) AS INTEGER)
  ELSE 2025 END AS year_no FROM orders""",
)
def normalize_year(spark, d):
    kind = F.col("o_orderkey") % 3
    raw = (
        F.when(kind == 0, F.concat(F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.lit("년")))
        .when(kind == 1, F.concat(F.year("o_orderdate").cast("string"), F.lit("년")))
        .otherwise(F.lit("미정"))
    )
    return b.table(spark, d, "orders").select("o_orderkey", dates.normalize_year(raw).alias("year_no"))


@query(
    "utc_to_local_date",
    "SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day FROM events",
)
def utc_to_local_date(spark, d):
    raw = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return b.table(spark, d, "events").select("event_id", dates.utc_to_local_date(raw).alias("day"))


@query("to_utc_string", "SELECT event_id, strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events")
def to_utc_string(spark, d):
    return b.table(spark, d, "events").select("event_id", dates.to_utc_string("ts").alias("utc"))


@query(
    "iso_duration_seconds",
    """WITH s AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0 ELSE event_id * 7 % 9000 END AS seconds FROM events)
SELECT event_id, seconds, round(seconds / 60.0, 1) AS minutes, CASE WHEN seconds >= 3600 THEN
  (seconds // 3600) || ':' || lpad(CAST(seconds % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(seconds // 60 AS VARCHAR) END
  || ':' || lpad(CAST(seconds % 60 AS VARCHAR), 2, '0') AS clock, CASE WHEN seconds <= 60 THEN 'Shorts' ELSE 'Clip' END AS kind FROM s""",
    {"minutes": 1},
)
def iso_duration_seconds(spark, d):
    n = F.col("event_id") * 7 % 9000
    hours = F.when(n >= 3600, F.format_string("%dH", F.floor(n / 3600))).otherwise(F.lit(""))
    minutes = F.when(n % 3600 >= 60, F.format_string("%dM", F.floor(n % 3600 / 60))).otherwise(F.lit(""))
    rest = F.when(n % 60 > 0, F.format_string("%dS", n % 60)).otherwise(F.lit(""))
    iso = F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit("PT"), hours, minutes, rest))
    seconds = dates.iso_duration_seconds(iso)
    return b.table(spark, d, "events").select(
        "event_id",
        seconds.alias("seconds"),
        dates.iso_duration_minutes(iso).alias("minutes"),
        dates.clock_text(seconds).alias("clock"),
        dates.video_kind(seconds).alias("kind"),
    )


@query("signed_log", "SELECT c_custkey, sign(c_acctbal) * ln(1 + abs(c_acctbal)) AS v FROM customer", {"v": 8})
def signed_log(spark, d):
    return b.table(spark, d, "customer").select("c_custkey", text.signed_log("c_acctbal").alias("v"))


@query("log1p_clip", "SELECT c_custkey, ln(1 + greatest(c_acctbal, 0)) AS v FROM customer", {"v": 8})
def log1p_clip(spark, d):
    return b.table(spark, d, "customer").select("c_custkey", text.log1p_clip("c_acctbal").alias("v"))


# ---- period labels -------------------------------------------------------------------------------------------

PERIOD_SQL = """labels_t AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m, (day(o_orderdate) - 1) // 7 + 1 AS w FROM orders),
texts AS (SELECT *, (y % 100) || '년 ' || m || '월 ' || w || '주차' AS label, CASE WHEN y % 100 + 2000 <= 2100 THEN y % 100 + 2000 END AS year FROM labels_t)"""


def _period_source(spark, d):
    day = F.col("o_orderdate")
    label = F.concat_ws(
        " ",
        F.concat((F.year(day) % 100).cast("string"), F.lit("년")),
        F.concat(F.month(day).cast("string"), F.lit("월")),
        F.concat((F.floor((F.dayofmonth(day) - 1) / 7) + 1).cast("string"), F.lit("주차")),
    )
    return b.table(spark, d, "orders").select(F.concat(label, F.lit(" ")).alias("label"))


@query(
    "parse_period_label",
    with_ctes(PERIOD_SQL) + "SELECT label, CAST(year AS INTEGER) AS year, CAST(m AS INTEGER) AS month, CAST(w AS INTEGER) AS week"
    " FROM texts",
)
def parse_period_label(spark, d):
    out = _period_source(spark, d).select(F.trim("label").alias("label")).distinct()
    return out.withColumn("_p", dates.parse_period_label("label")).select(
        "label", F.col("_p.year").alias("year"), F.col("_p.month").alias("month"), F.col("_p.week").alias("week")
    )


@query(
    "attach_period_labels",
    with_ctes(PERIOD_SQL) + "SELECT n_nationkey, (SELECT string_agg(label, '||' ORDER BY label) FROM texts) AS period_raw FROM nation",
)
def attach_period_labels(spark, d):
    nations = b.table(spark, d, "nation").select("n_nationkey")
    return tables.attach_period_labels(nations, _period_source(spark, d), "label")


@query(
    "explode_labels",
    with_ctes(PERIOD_SQL) + "SELECT label, CAST(year AS INTEGER) AS year, CAST(m AS INTEGER) AS month, CAST(w AS INTEGER) AS week FROM texts",
)
def explode_labels(spark, d):
    return tables.explode_labels(attach_period_labels(spark, d))


@query(
    "period_bounds",
    with_ctes(PERIOD_SQL)
    + """SELECT (SELECT label FROM texts ORDER BY year, m, w, label LIMIT 1) AS first_label,
  (SELECT label FROM texts ORDER BY year DESC, m DESC, w DESC, label DESC LIMIT 1) AS last_label""",
)
def period_bounds(spark, d):
    return tables.period_bounds(_period_source(spark, d))


@query(
    "distinct_comment_texts",
    "SELECT count(*) AS total_rows, count(DISTINCT trim(text)) AS texts FROM conversations",
)
def distinct_comment_texts(spark, d):
    body = F.trim("text")
    return tables.distinct_counts(b.comments(spark, d), {"texts": F.when(body != "", body)})


@query(
    "exact_quantiles",
    "SELECT quantile_cont(l_extendedprice, 0.05) AS p05, quantile_cont(l_extendedprice, 0.5) AS p50,"
    " quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem",
    {"p05": 4, "p50": 4, "p95": 4},
)
def exact_quantiles(spark, d):
    line = b.table(spark, d, "lineitem")
    return ordering.exact_quantiles(line, "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


