import json

from audira.llm.tool_calls import link_tool_calls

CALLS = "conv_id long, seq long, call_id string, name string, arguments string, depends_on array<string>, level string"
RESULTS = "call_id string, seq long, content string, status string"
SCHEMAS = "name string, param string, kind string, required boolean"


def run(spark, calls, results=(), schemas=(("f", "a", "integer", True), ("f", "b", "string", False), ("f", "c", "number", None))):
    tables = [spark.createDataFrame(list(rows), schema) for rows, schema in ((calls, CALLS), (results, RESULTS), (schemas, SCHEMAS))]
    return link_tool_calls(*tables).collect()


def test_links_levels_and_lines(spark):
    calls = [
        (1, 3, "x3", "f", '{"b": "é\\n", "a": 1}', ["x1", "x2"], "extra"),
        (1, 1, "x1", "f", '{"a": 2, "c": 1.50}', None, "extra"),
        (1, 2, "x2", "f", '{ "a":3 }', ["x1", "x1"], "extra"),
        (2, 9, "x9", "f", '{"a": 4}', [], "extra"),
    ]
    results = [("x1", 5, "late", "s"), ("x1", 4, "first", "s"), ("x3", 1, None, "s"), ("zz", 1, "lost", "s"), (None, 2, "nobody", "s")]
    got = run(spark, calls, results)
    by = {r.call_id: r for r in got if r.status != "orphan"}
    assert {k: (r.level, r.status, r.n_results) for k, r in by.items()} == {"x1": (0, "ok", 2), "x2": (1, "unanswered", 0), "x3": (2, "ok", 1), "x9": (0, "unanswered", 0)}
    assert by["x3"].line == (
        '{"arguments":{"a":1,"b":"é\\n"},"call_id":"x3","conv_id":1,"depends_on":["x1","x2"],"errors":[],"level":2,"name":"f","result":null,"status":"ok"}'
    )
    assert json.loads(by["x1"].line)["result"] == "first" and '"c":1.5}' in by["x1"].line
    assert sorted(r.line for r in got if r.status == "orphan") == ['{"call_id":"zz","result":"lost","status":"orphan"}', '{"call_id":null,"result":"nobody","status":"orphan"}']


def test_arguments_are_validated(spark):
    cases = {
        '{"a": 1}': [], '{"a": 1.5}': ["type a"], '{"a": "1"}': ["type a"], '{"b": "x"}': ["missing a"], '{"a": null}': ["type a"],
        '{"a": 1, "d": 2, "b": []}': ["type b", "unexpected d"], '{"a": 1, "c": 2}': [], '{"a": 1, "c": 1e3}': [], "{bad": ["arguments"], "[1]": ["arguments"],
        None: ["arguments"], "": ["arguments"], '{"a": 1, "a": 1}': ["arguments"], "{}": ["missing a"], '{"a": true}': ["type a"],
    }
    calls = [(1, i, f"k{i}", "f", a, None, None) for i, a in enumerate(cases)] + [(1, 99, "k99", "g", "{}", None, None), (1, 98, "k98", None, "{}", None, None)]
    got = {r.call_id: r for r in run(spark, calls)}
    for i, (a, errors) in enumerate(cases.items()):
        assert got[f"k{i}"].errors == errors, a
        assert got[f"k{i}"].status == ("invalid" if errors else "unanswered")
    assert got["k99"].errors == got["k98"].errors == ["tool"]


def test_cycles_unknown_dependencies_and_repeats(spark):
    calls = [
        (1, 1, "a", "f", '{"a": 1}', ["b"], None), (1, 2, "b", "f", '{"a": 1}', ["a"], None), (1, 3, "c", "f", '{"a": 1}', ["a", "d"], None),
        (1, 4, "d", "f", '{"a": 1}', ["gone", None], None), (1, 5, "s", "f", '{"a": 1}', ["s"], None), (1, 6, None, "f", '{"a": 1}', ["d"], None),
        (1, 7, "r", "f", '{"a": 1}', ["d"], None), (1, 7, "r", "f", '{"a": 1}', ["d"], None), (None, None, "n", "f", '{"a": 1}', None, None),
    ]
    got = run(spark, calls)
    assert len(got) == 9
    by = {r.call_id: r for r in got}
    assert {k: by[k].level for k in by} == {"a": None, "b": None, "c": None, "d": 0, "s": None, None: 0, "r": 1, "n": 0}
    assert by["a"].status == by["c"].status == by["s"].status == "cycle" and by["d"].errors == ["depends gone"]


def test_hot_identifier_and_long_chain(spark):
    calls = [(1, i, f"c{i}", "f", '{"a": 1}', [f"c{i - 1}"] if i else None, None) for i in range(9)]
    results = [("c0", i, f"r{i:05}", None) for i in range(5000)]
    got = {r.call_id: r for r in run(spark, calls, results)}
    assert [got[f"c{i}"].level for i in range(9)] == list(range(9)) and got["c0"].n_results == 5000 and '"r00000"' in got["c0"].line


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert [r.status for r in run(spark, [], [("a", 1, "x", None)])] == ["orphan"]
    assert [r.errors for r in run(spark, [(1, 1, "a", "f", "{}", None, None)], schemas=())] == [["tool"]]


def test_no_python_in_the_plan(spark, capsys):
    from audira.llm.queries import QUERIES

    tables = [spark.sql("SELECT " + ", ".join(f"CAST(null AS {c.split(' ', 1)[1]}) AS {c.split(' ', 1)[0]}" for c in s.split(", "))) for s in (CALLS, RESULTS, SCHEMAS)]
    link_tool_calls(*tables).explain()
    plan = capsys.readouterr().out
    assert "Project" in plan and not any(x in plan for x in ("Python", "Arrow", "CartesianProduct", "NestedLoop"))
    assert "op10_tool_calls" in QUERIES
