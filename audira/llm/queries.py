"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from audira.llm.decontaminate import leaks
from audira.llm.fst_tokens import token_counts
from audira.llm.html_text import page_texts
from audira.llm.language import language_report
from audira.llm.mixing import mix_report
from audira.llm.near_dedup import near_duplicates
from audira.llm.part_codes import part_codes
from audira.llm.quality import quality_report
from audira.llm.spelling import spelling_variants
from audira.llm.token_files import token_file_report
from audira.llm.tool_calls import derived_calls, derived_results, link_tool_calls, tool_schemas
from audira.llm.toxicity import toxicity_report
from audira.llm.warc import warc_report
from audira.plans.registry import Query

QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None, digits: dict[str, int] | None = None):
    def add(build):
        QUERIES[name] = Query(name, build, sql, digits or {})
        return build

    return add


def all_queries() -> dict[str, Query]:
    return QUERIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Words and counts of the quality rules for one text, as DuckDB list expressions over w (words) and l (lines).
QUALITY_SQL = r"""
WITH w AS (
    SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3
), grams AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY doc_id
), lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w
), line_counts AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), f AS (
    SELECT w.doc_id, source AS host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
    FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN line_counts USING (doc_id)
), j AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        (100 * n_symbols > 10 * n_words)::INT + (word_chars < 3 * n_words OR word_chars > 10 * n_words)::INT
        + (100 * n_dup_lines > 30 * n_lines)::INT AS n_soft
    FROM f
), h AS (
    SELECT host, count(*) AS n, sum((base_failed OR n_soft > 0)::INT) AS bad FROM j GROUP BY host
), p AS (
    SELECT count(*) AS k, sum(n) AS n, sum(bad) AS bad, sum(bad / n * bad) AS q FROM h
), p2 AS (
    SELECT bad / n AS m, greatest(0, q / n - (bad / n) * (bad / n)) - (bad / n) * (1 - bad / n) * k / n AS between_hosts FROM p
), p3 AS (
    SELECT m, least(greatest(CASE WHEN between_hosts > 0 THEN m * (1 - m) / between_hosts - 1 ELSE 1000.0 END, 2.0), 1000.0) AS s FROM p2
), v AS (
    SELECT host, (bad + m * s) / (n + s) AS shrunk_rate FROM h, p3
)
"""
QUALITY_KEPT = "NOT base_failed AND n_soft <= CASE WHEN shrunk_rate >= 0.9 THEN -1 WHEN shrunk_rate >= 0.5 THEN 0 ELSE 1 END"
QUALITY_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register(
    "op6_host_quality",
    QUALITY_SQL
    + f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {QUALITY_KEPT} AS kept
FROM j JOIN v ON j.host IS NOT DISTINCT FROM v.host""",
)
def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents")).select(*QUALITY_COLUMNS)


MIX_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 10))::BIGINT AS hash
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0 ELSE 3.0 END AS weight
    FROM d GROUP BY source
), r AS (  -- sources by how soon they are full; the level that holds if all before a source are full
    SELECT *, 3 * source_size / weight AS full_at,
        (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
    FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size, least(3.0 * source_size, weight * (SELECT min_by(level, full_at) FROM r WHERE level < full_at)) AS target FROM r
), u AS (
    SELECT source, source_size, target, least(floor(target / source_size), 3)::BIGINT AS whole,
        greatest(target - least(floor(target / source_size), 3) * source_size, 0) AS rest FROM t
), c AS (  -- words of the source at or below each hash
    SELECT d.doc_id, d.size, d.hash, u.*, sum(size) OVER (PARTITION BY d.source ORDER BY hash) AS upto
    FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), b AS (  -- words up to the last hash that fits, and through the next one
    SELECT source, coalesce(max(upto) FILTER (upto <= rest), 0) AS used, min(upto) FILTER (upto > rest) AS next_used, any_value(rest) AS rest FROM c GROUP BY source
)
SELECT c.doc_id, c.size, c.source_size, c.target,
    (c.size * (c.whole + (upto <= CASE WHEN next_used - b.rest < b.rest - used THEN next_used ELSE used END)::INT))::BIGINT AS taken
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
"""


@register("op7_mix_sources", MIX_SQL, {"target": 3})
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


@register("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op3_benchmark_leaks")
def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op1_warc_archives")
def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_report(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


@register("op5_page_texts")
def op5_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


# The derived calls, their levels by the longest chain, errors and canonical lines.
CALLS_SQL = r"""
WITH RECURSIVE t AS (
    SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations WHERE role = 'assistant'
), c AS (
    SELECT conv_id, turn AS seq, text, n, 'c' || conv_id || '-' || turn AS call_id,
        CASE WHEN n % 41 = 0 THEN 'weather' WHEN n % 3 = 0 THEN 'search' WHEN n % 3 = 1 THEN 'translate' ELSE 'score' END AS name,
        list_sort(list_distinct(list_filter([turn // 2, turn // 3], lambda x: x > 0 AND x < turn))) AS up FROM t
), edge AS (
    SELECT DISTINCT call_id, 'c' || conv_id || '-' || unnest(up) AS needs FROM c
), known AS (
    SELECT e.call_id, e.needs, k.call_id IS NOT NULL AS known FROM edge e LEFT JOIN (SELECT DISTINCT call_id FROM c) k ON k.call_id = e.needs
), path(call_id, level) AS (
    SELECT DISTINCT call_id, 0 FROM c
    UNION
    SELECT k.call_id, p.level + 1 FROM path p JOIN known k ON k.needs = p.call_id AND k.known
), lv AS (
    SELECT call_id, max(level) AS level FROM path GROUP BY call_id
), unmet AS (
    SELECT call_id, list_sort(list('depends ' || needs)) AS unmet FROM known WHERE NOT known GROUP BY call_id
), u AS (
    SELECT conv_id, turn, text, 'c' || conv_id || '-' || (turn - 1) AS call_id FROM conversations WHERE role = 'user'
), r AS (
    SELECT call_id, min_by(text, turn) AS content, count(*) AS n_results FROM u GROUP BY call_id
), a AS (
    SELECT c.*, lv.level, coalesce(unmet, []) AS unmet, content, coalesce(n_results, 0) AS n_results, n % 11 = 0 AS broken,
        CASE name WHEN 'search' THEN CASE WHEN n % 7 = 0 THEN '{"limit":' || n || ',"text":' || to_json(text) || '}' ELSE '{"limit":' || n || ',"query":' || to_json(text) || '}' END
        WHEN 'translate' THEN '{"text":' || to_json(text) || ',"to":' || CASE WHEN n % 5 = 0 THEN n::VARCHAR ELSE '"en"' END || '}'
        ELSE '{"strict":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || ',"value":' || regexp_replace((n::DOUBLE / 2)::VARCHAR, '\.0$', '') || ',"weights":[' || n || ',' || (n + 1) || ']}' END AS args,
        CASE WHEN name = 'weather' THEN ['tool'] WHEN n % 11 = 0 THEN ['arguments'] WHEN name = 'search' AND n % 7 = 0 THEN ['missing query', 'unexpected text']
        WHEN name = 'translate' AND n % 5 = 0 THEN ['type to'] ELSE [] END AS wrong
    FROM c JOIN lv USING (call_id) LEFT JOIN unmet USING (call_id) LEFT JOIN r USING (call_id)
), b AS (
    SELECT *, wrong || unmet AS errors,
        CASE WHEN len(wrong) + len(unmet) > 0 THEN 'invalid' WHEN n_results = 0 THEN 'unanswered' ELSE 'ok' END AS status FROM a
)
SELECT conv_id, seq, call_id, name, level, status, array_to_string(errors, '; ') AS errors, n_results,
    '{"arguments":' || CASE WHEN broken THEN 'null' ELSE args END || ',"call_id":"' || call_id || '","conv_id":' || conv_id
    || ',"depends_on":[' || CASE WHEN seq // 2 > 0 THEN '"c' || conv_id || '-' || (seq // 2) || '"' ELSE '' END
    || CASE WHEN seq // 3 > 0 AND seq // 3 <> seq // 2 THEN ',"c' || conv_id || '-' || (seq // 3) || '"' ELSE '' END
    || '],"errors":' || to_json(errors) || ',"level":' || level || ',"name":"' || name || '","result":' || coalesce(to_json(content)::VARCHAR, 'null')
    || ',"status":"' || status || '"}' AS line
FROM b
UNION ALL
SELECT NULL, turn, call_id, NULL, NULL, 'orphan', '', 0, '{"call_id":"' || call_id || '","result":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"status":"orphan"}'
FROM u WHERE call_id NOT IN (SELECT call_id FROM c)
"""


@register("op10_tool_calls", CALLS_SQL)
def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    linked = link_tool_calls(derived_calls(conversations), derived_results(conversations), tool_schemas(spark))
    return linked.withColumn("errors", F.array_join("errors", "; "))


@register("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@register("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Codebooks round by round; the nearest entry by all distances. z holds the last codebooks as one row per component.
CODED = """
d{i} AS (
    SELECT x.vec_id, x.p, c.e, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM parts x JOIN c{i} c USING (p, j) GROUP BY ALL
), a{i} AS (
    SELECT vec_id, p, min(struct_pack(d := d, e := e)) AS best FROM d{i} GROUP BY ALL
)"""
MOVED = """
c{k} AS (
    SELECT p, e, j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
        SELECT p, best.e AS e, j, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM a{i} JOIN parts USING (vec_id, p) GROUP BY ALL
    ) m USING (p, e, j)
)"""
PART_CODES_SQL = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS w
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
    SELECT vec_id, p, j, v[p * w + j + 1] AS v FROM (SELECT *, unnest(range(w)) AS j FROM (SELECT *, unnest(range(16)) AS p FROM kept))
), seeds AS (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64
), c0 AS (
    SELECT p, e, j, v FROM parts JOIN seeds USING (vec_id)
), {CODED.format(i=0)}, {MOVED.format(i=0, k=1)}, {CODED.format(i=1)}, {MOVED.format(i=1, k=2)}, {CODED.format(i=2)}, coded AS (
    SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) FROM c2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


@register("op13_part_codes", PART_CODES_SQL)
def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes(table(spark, sf_dir, "embeddings"))
