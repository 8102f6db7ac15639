"""Linking tool calls to their results, DataFrame functions only.

Calls and results meet by identifier in a hash join; results of one identifier are reduced to the first before it. Calls are
put in topological order by levels: a call without known dependencies has level 0, any other one more than the highest call
it depends on. Each round takes the calls whose dependencies are all done, so the rounds are as many as the longest chain of
dependencies, however many calls there are. Arguments are checked against the schema of their tool. Every call becomes one
line of canonical JSON: keys sorted at every depth, no white space, numbers in one form.

Inputs, by column name: calls (conv_id, seq, call_id, name, arguments, depends_on), results (call_id, seq, content), schemas
(name, param, kind, required). Other columns are not read.

=============================  ==================================================================
case                           result
=============================  ==================================================================
no result                      result null, status ``unanswered``
several results of a call      the one with the smallest (seq, content); n_results says how many
result without a call          a row with status ``orphan`` and no call columns
null identifiers               never meet; a call keeps its row, a result is an orphan
dependency on an unknown call  not waited for; listed in errors
cycle, or behind one           level null, status ``cycle``
repeated call identifiers      every row is kept; they share result and level
arguments not an object        error ``arguments`` (also for null, broken JSON and repeated keys)
unknown tool                   error ``tool``; arguments are not checked
empty tables                   empty results
=============================  ==================================================================

Status: ``cycle``, else ``invalid`` if there are errors, else ``unanswered`` or ``ok``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from audira.llm.shared import pick, settle

# Kinds of a schema and the JSON types that they accept.
KINDS = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}


def first_results(results: DataFrame) -> DataFrame:
    """(call_id, content, n_results): combined before the shuffle, so a hot identifier is one row per task."""
    known = results.where(F.col("call_id").isNotNull())
    first = F.min(F.struct(F.col("seq"), F.col("content")))
    return known.groupBy("call_id").agg(first.alias("first"), F.count(F.lit(1)).alias("n_results")).select("call_id", F.col("first.content").alias("content"), "n_results")


def levels(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(call_id, level) and (call_id, unknown dependencies); calls in or behind a cycle have no level."""
    ids = settle(calls.where(F.col("call_id").isNotNull()).select("call_id").distinct())
    edges = calls.where(F.col("call_id").isNotNull()).select("call_id", F.explode(F.array_distinct("depends_on")).alias("needs")).distinct()
    known = ids.select(F.col("call_id").alias("needs"), F.lit(True).alias("known"))
    edges = settle(edges.join(known, "needs", "left"))
    unknown = edges.where("known is null").groupBy("call_id").agg(F.array_sort(F.collect_set("needs")).alias("unknown"))
    waiting = settle(edges.where("known").select("call_id", "needs"))
    ready = settle(ids.join(waiting.select("call_id").distinct(), "call_id", "left_anti"))
    level, done = 0, ready.withColumn("level", F.lit(0))
    while not ready.isEmpty():
        level += 1
        left = settle(waiting.join(ready.withColumnRenamed("call_id", "needs"), "needs", "left_anti").select("call_id", "needs"))
        ready = settle(waiting.select("call_id").distinct().join(left.select("call_id").distinct(), "call_id", "left_anti"))
        done, waiting = done.union(ready.withColumn("level", F.lit(level))), left
    return done, unknown


def tools(schemas: DataFrame) -> DataFrame:
    """One row per tool: (name, params); a tool has as many entries as its schema has parameters."""
    param = F.struct("param", "kind", F.coalesce("required", F.lit(False)).alias("required"))
    return schemas.where("name is not null").groupBy("name").agg(F.array_sort(F.collect_set(F.when(F.col("param").isNotNull(), param))).alias("params"))


def argument_errors() -> tuple[Column, Column]:
    """The parameters given (name, type) and the errors of ``arguments`` against ``params``: missing, wrongly typed and unknown parameters, in order."""
    given = F.transform(F.map_entries(F.from_json("arguments", "map<string,variant>")), lambda e: F.struct(e["key"].alias("param"), F.schema_of_variant(e["value"]).alias("kind")))
    names = F.transform("given", lambda g: g["param"])

    def accepts(kind: Column, found: Column) -> Column:
        checks = [(kind == k) & F.regexp_extract(found, "^[A-Z]+", 0).isin(*v) for k, v in KINDS.items()]
        out = checks[0]
        for c in checks[1:]:
            out = out | c
        return out

    missing = F.transform(F.filter("params", lambda p: p["required"] & ~F.array_contains(names, p["param"])), lambda p: F.concat(F.lit("missing "), p["param"]))
    wrong = F.transform(
        F.filter("params", lambda p: F.exists("given", lambda g: (g["param"] == p["param"]) & ~accepts(p["kind"], g["kind"]))), lambda p: F.concat(F.lit("type "), p["param"])
    )
    allowed = F.transform("params", lambda p: p["param"])
    extra = F.transform(F.array_except(names, allowed), lambda n: F.concat(F.lit("unexpected "), n))
    checked = F.array_sort(F.concat(missing, wrong, extra))
    is_object = F.schema_of_variant(F.col("parsed")).startswith("OBJECT")
    errors = F.when(F.col("params").isNull(), F.array(F.lit("tool"))).when(F.coalesce(is_object, F.lit(False)), checked).otherwise(F.array(F.lit("arguments")))
    return F.when(F.coalesce(is_object, F.lit(False)), given).otherwise(F.array().cast("array<struct<param:string,kind:string>>")), errors


def canonical(**fields: Column) -> Column:
    """One JSON object: keys sorted here and, as variants sort theirs, at every depth; nulls stay."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Per call, and per result without one: conv_id, seq, call_id, name, level, status, errors, n_results, line (canonical JSON).

    (level, seq) is a topological order of a conversation's calls; no conversation is gathered for it.
    """
    c = pick(calls, "conv_id", "seq", "call_id", "name", "arguments", "depends_on")
    r = pick(results, "call_id", "seq", "content")
    s = pick(schemas, "name", "param", "kind", "required")
    c = settle(c)
    order, unknown = levels(c)
    answers = settle(first_results(r))
    joined = c.join(answers, "call_id", "left").join(order, "call_id", "left").join(unknown, "call_id", "left").join(tools(s), "name", "left")
    joined = joined.withColumn("parsed", F.try_parse_json("arguments"))
    given, errors = argument_errors()
    joined = joined.withColumn("given", given)
    unmet = F.transform(F.coalesce("unknown", F.array().cast("array<string>")), lambda d: F.concat(F.lit("depends "), d))
    joined = joined.withColumn("errors", F.concat(errors, unmet)).withColumn("level", F.when(F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("level")))
    status = F.when(F.col("level").isNull(), "cycle").when(F.size("errors") > 0, "invalid").when(F.col("n_results").isNull(), "unanswered").otherwise("ok")
    joined = joined.withColumns({"status": status, "n_results": F.coalesce("n_results", F.lit(0))})
    line = canonical(
        arguments=F.col("parsed"), call_id=F.col("call_id"), conv_id=F.col("conv_id"), depends_on=F.col("depends_on"), errors=F.col("errors"),
        level=F.col("level"), name=F.col("name"), result=F.col("content"), status=F.col("status"),
    )
    columns = ["conv_id", "seq", "call_id", "name", "level", "status", "errors", "n_results"]
    linked = joined.select(*columns, line.alias("line"))
    ids = c.where("call_id is not null").select("call_id").distinct()
    lost = r.join(ids, "call_id", "left_anti")
    empty = {"conv_id": c.schema["conv_id"].dataType, "name": "string", "level": "int"}
    lost = lost.withColumns({k: F.lit(None).cast(v) for k, v in empty.items()})
    lost = lost.withColumns({"status": F.lit("orphan"), "errors": F.array().cast("array<string>"), "n_results": F.lit(0).cast("long")})
    lost_line = canonical(call_id=F.col("call_id"), result=F.col("content"), status=F.col("status"))
    return linked.union(lost.select(*columns, lost_line.alias("line")))


# ---- Calls that Spark derives from plain conversations ----

# The tools of the derived calls.
TOOLS = {
    "search": (("query", "string", True), ("limit", "integer", False)),
    "translate": (("text", "string", True), ("to", "string", True)),
    "score": (("weights", "array", True), ("value", "number", True), ("strict", "boolean", False)),
}


def tool_schemas(spark) -> DataFrame:
    rows = [(name, *p) for name, params in TOOLS.items() for p in params]
    return spark.createDataFrame(rows, "name string, param string, kind string, required boolean")


def derived_calls(conversations: DataFrame) -> DataFrame:
    """Each assistant turn as a call. Its text's length chooses the tool and what is wrong with the arguments, if anything;
    it depends on the calls at half and at a third of its turn, where there are any."""
    t = conversations.where(F.col("role") == "assistant").withColumn("text", F.coalesce("text", F.lit("")))
    n = F.length("text")
    t = t.withColumns({"n": n, "name": F.element_at(F.array(*[F.lit(x) for x in (*TOOLS, "weather")]), F.when(n % 41 == 0, 4).otherwise(n % 3 + 1))})
    search = F.when(n % 7 == 0, F.to_json(F.struct("text", n.alias("limit")))).otherwise(F.to_json(F.struct(F.col("text").alias("query"), n.alias("limit"))))
    translate = F.when(n % 5 == 0, F.to_json(F.struct(n.alias("to"), "text"))).otherwise(F.to_json(F.struct(F.lit("en").alias("to"), "text")))
    half = n.cast("double") / 2
    score = F.to_json(F.struct(half.alias("value"), F.array(n, n + 1).alias("weights"), (n % 2 == 0).alias("strict")))
    arguments = F.when(F.col("name") == "search", search).when(F.col("name") == "translate", translate).otherwise(score)
    arguments = F.when(n % 11 == 0, F.substring(arguments, F.lit(1), F.length(arguments) - 1)).otherwise(arguments)
    call_id = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn")
    needs = F.array_distinct(F.array(F.floor(turn / 2), F.floor(turn / 3)))
    depends = F.transform(F.filter(needs, lambda x: (x > 0) & (x < turn)), call_id)
    return t.select("conv_id", turn.alias("seq"), call_id(turn).alias("call_id"), "name", arguments.alias("arguments"), depends.alias("depends_on"))


def derived_results(conversations: DataFrame) -> DataFrame:
    """Each user turn answers the call of the turn before it."""
    answers = conversations.where(F.col("role") == "user")
    call_id = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string"))
    return answers.select(call_id.alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
