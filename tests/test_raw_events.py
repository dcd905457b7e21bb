"""Raw events at size: parsed once, only changed calls' texts in a join, written once."""

import json
import tempfile

from pyspark.sql import functions as F

from tests.conftest import data_dir
from trajloom.functions import outputs as o
from trajloom.operators.reduce import may_be_among
from trajloom.plans import queries as q
from trajloom.sources import files


def lines_file(*lines):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/events.jsonl"
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")
    return path


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_lines_and_responses_are_not_parsed_over_and_over(spark):
    events = files.read_tool_events(spark, lines_file('{"seq":1,"hook_event_name":"PostToolUse"}'))
    assert parses(events) <= 2
    assert parses(o.normalize_codex(events)) <= 20
    assert parses(o.normalize_claude(events)) <= 20


def test_raw_fields_stay_as_they_stand(spark):
    """Whatever other fields are named or hold: the text of the line's own field."""
    cases = [
        '"tool_response":5.00', '"tool_response":""', '"tool_response":"\\""', '"tool_response":"\\u0022x"', '"tool_response":"a\\/b"', '"tool_response": {"a" : 1}', '"tool_response":{"a":[1,2]}', '"tool_response":true',
        '"tool_response":null', '"x":{"tool_response":null}', '"x":{"tool_response":"5"},"tool_response":5', '"x":{"tool_response":5},"tool_response":"5"', '"tool_response": 5,"x":{"tool_response":"5"}',
        '"x":"tool_response","tool_response":"null"', '"tool\\u005fresponse":[1]', '"tool_response":"é\\n\\t{}"',
    ]
    want = ["5.00", '""', '"\\""', '"\\u0022x"', '"a\\/b"', '{"a" : 1}', '{"a":[1,2]}', "true", "null", None, "5", '"5"', "5", '"null"', "[1]", '"é\\n\\t{}"']
    path = lines_file(*[f'{{"seq":{k},"hook_event_name":"PostToolUse",{x}}}' for k, x in enumerate(cases)])
    got = {r["seq"]: r["tool_response"] for r in files.read_tool_events(spark, path).collect()}
    assert [got[k] for k in range(len(cases))] == want
    assert all(x is None or json.loads(x) == json.loads(x) for x in want)


def test_rows_that_may_be_among_others(spark):
    """All that are, and hardly any that aren't; any type of key."""
    for key in (F.col("id"), F.concat(F.lit("k"), F.col("id").cast("string"))):
        df, some = spark.range(20000).select(key.alias("k"), "id"), spark.range(0, 20000, 5).select(key.alias("k"))
        found = {r["id"] for r in may_be_among(df, some, "k").collect()}
        assert set(range(0, 20000, 5)) <= found and len(found) < 4100
    assert may_be_among(df, some.limit(0), "k").count() == 0


def test_stored_queries_write_raw_events_once_for_each_agent(spark, monkeypatch):
    made, own = [], q._raw
    monkeypatch.setattr(q, "_raw", lambda spark, sf_dir, codex: (made.append(codex), own(spark, sf_dir, codex))[1])
    for query in (q.stored_stats, q.stored_archive):
        made.clear()
        query(spark, data_dir())
        assert sorted(made) == [False, True]
