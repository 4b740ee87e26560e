"""Linking, order, validation, canonical JSON."""

import json
import random

from pyspark.sql import functions as F

from leafwise.llm import toolcalls as tc

CALLS = "conv_id long, turn long, pos int, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
TOOLS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "ping": {}}


def linked(spark, calls, results):
    return tc.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), TOOLS).collect()


def test_links_states_and_errors(spark):
    calls = [
        (1, 0, 0, "a", "add", '{"b": 2.5, "a": 1}', []), (1, 0, 1, "b", "add", '{"a": "1", "note": 3}', ["a"]), (1, 1, 0, "a", "ping", "{}", []), (1, 2, 0, "c", "nothing", "{}", None), (1, 2, 1, None, "ping", "[1]", []), (1, 3, 0, "d", "ping", "not json", ["missing"]),
        (2, 0, 0, "a", "ping", None, []), (2, 0, 0, "a", "ping", None, []),
    ]
    results = [(1, 4, "a", "second"), (1, 3, "a", 'he said "hi"\n'), (1, 5, "z", "orphan"), (1, 6, None, "lost"), (2, 1, "a", None)]
    got = {(r.conv_id, r.call_id, r.status): r for r in linked(spark, calls, results)}
    assert len(got) == 10
    assert got[1, "a", "answered"].result_turn == 3 and got[1, "a", "answered"].errors == ""
    assert got[1, "b", "unanswered"].errors == "a is not integer; b is missing; note is not string"
    assert got[1, "c", "unanswered"].errors == "unknown tool" and got[1, None, "unanswered"].errors == "arguments are no object" and got[1, "d", "unanswered"].errors == "arguments are no object"
    assert got[1, "a", "duplicate"].result_turn is None and got[1, "z", "orphan"].name is None and got[2, "a", "answered"].result_turn == 1
    assert got[1, "a", "extra"].result_turn == 4 and got[1, None, "orphan"].result_turn == 6 and json.loads(got[1, None, "orphan"].json)["result"] == "lost"
    assert got[1, "a", "answered"].json == '{"after":[],"arguments":{"a":1,"b":2.5},"id":"a","name":"add","result":"he said \\"hi\\"\\n","status":"answered"}'
    for r in got.values():
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json


def test_forward_dependencies_and_cycles(spark):
    calls = [(1, t, 0, c, "ping", "{}", after) for t, (c, after) in enumerate([("d", ["c", "b"]), ("c", ["a"]), ("b", ["a"]), ("a", []), ("x", ["y"]), ("y", ["x"]), ("z", ["y"])])]
    calls += [(2, t, 0, f"k{t}", "ping", "{}", [f"k{t - 1}"]) for t in range(60)]
    rows = linked(spark, calls, [])
    one = {r.call_id: (r.level, r.place) for r in rows if r.conv_id == 1}
    assert {k: v[0] for k, v in one.items()} == {"a": 0, "b": 1, "c": 1, "d": 2, "x": None, "y": None, "z": None}
    assert [k for k, _ in sorted(one.items(), key=lambda x: x[1][1])] == ["a", "c", "b", "d", "x", "y", "z"]
    two = sorted((r.place, r.call_id, r.level) for r in rows if r.conv_id == 2)
    assert two == [(t + 1, f"k{t}", t) for t in range(60)]


def test_extracting(spark):
    call = {"tool_calls": [{"id": "a", "name": "add", "arguments": {"b": 1, "a": 2}}, {"id": "b", "name": "ping", "arguments": '{"x": 1}', "after": ["a"]}]}
    rows = [(1, 0, "assistant", json.dumps(call)), (1, 1, "tool", '{"tool_call_id": "a", "content": "3"}'), (1, 2, "user", "{ not json"), (1, 3, "user", None), (1, 4, "user", ""), (None, 5, "user", "x")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit("clash"))
    calls, results = tc.extracted(messages)
    got = {r.call_id: r for r in tc.link(calls, results, TOOLS).collect()}
    assert got["a"].status == "answered" and json.loads(got["a"].json)["arguments"] == {"a": 2, "b": 1} and json.loads(got["b"].json)["after"] == ["a"]
    plain, answers = tc.turns_as_calls(messages)
    assert plain.count() == 4 and answers.count() == 1
    empty, none = tc.turns_as_calls(messages.limit(0))
    assert tc.link(empty, none, tc.REPLY).count() == 0


def plain_levels(calls):
    """Of one conversation's calls {id: after}: the longest path below each, None on or behind a cycle."""
    known = {}
    while True:
        more = {i: max((known[d] + 1 for d in after if d in calls), default=0) for i, after in calls.items() if i not in known and all(d in known for d in after if d in calls)}
        if not more:
            return {i: known.get(i) for i in calls}
        known |= more


def test_levels_of_graphs(spark):
    draw, graphs = random.Random(4), {}
    for conv in range(8):
        n = draw.choice([3, 20, 90])
        reach = draw.choice([1, 3, n])
        graphs[conv] = {f"n{k}": [f"n{draw.randint(max(0, k - reach), k - 1 if conv % 2 else min(n, k + 1))}" for _ in range(draw.randint(0, 2))] if k else [] for k in range(n)}
    graphs[9] = {f"n{k}": [f"n{k + 1}"] for k in range(200)}
    rows = [(conv, k, 0, i, "ping", "{}", after) for conv, calls in graphs.items() for k, (i, after) in enumerate(calls.items())]
    got = {(r.conv_id, r.call_id): r for r in linked(spark, rows, [])}
    for conv, calls in graphs.items():
        want = plain_levels(calls)
        assert {i: got[conv, i].level for i in calls} == want
        assert sorted(got[conv, i].place for i in calls) == list(range(1, len(calls) + 1))
        assert all(got[conv, d].place < got[conv, i].place for i, after in calls.items() if want[i] is not None for d in after if d in calls)


def test_null_ids_repeated_results_and_numbers(spark):
    calls = [(1, 0, 0, "a", "add", '{"a": 12345678901234567890, "b": 1.0}', []), (1, 1, 0, "b", "add", '{"a": 1.0, "b": 2}', []), (1, 2, 0, "c", "add", '{"a": 1.5, "b": 2}', []), (1, 3, 0, "d", "add", '{"a": 1e3, "b": 2}', []), (None, 0, 0, "a", "ping", "{}", [])]
    results = [(1, 9, "z", "one"), (1, 9, "z", "one"), (1, 9, "z", "two"), (1, 8, None, None), (None, 1, "a", "no conversation"), (1, 5, "a", "x"), (1, 5, "a", "w"), (1, None, "a", "v")]
    rows = linked(spark, calls, results)
    assert len(rows) == len(calls) + 7 - 1
    by = {}
    for r in rows:
        by.setdefault((r.conv_id, r.call_id, r.status), []).append(r)
    assert len(by[1, "z", "orphan"]) == 2 and len(by[1, "a", "extra"]) == 2 and len(by[1, None, "orphan"]) == len(by[None, "a", "orphan"]) == len(by[None, "a", "unanswered"]) == 1
    assert [by[1, i, s][0].errors for i, s in (("a", "answered"), ("b", "unanswered"), ("c", "unanswered"), ("d", "unanswered"))] == ["", "", "a is not integer", ""]
    assert sorted(r.place for r in rows if r.conv_id == 1) == list(range(1, 10))


def test_places_of_a_large_conversation_are_dealt_out(spark):
    calls = spark.range(5_000).selectExpr("1L AS conv_id", "id AS turn", "0 AS pos", "cast(id AS string) AS call_id", "'ping' AS name", "'{}' AS arguments", "array(cast(id - 1 AS string)) AS after")
    rows = tc.link(calls, spark.createDataFrame([], RESULTS), TOOLS).select("call_id", "place", "level").collect()
    assert len(rows) == 5_000 and all(int(r.call_id) == r.level == r.place - 1 for r in rows)
