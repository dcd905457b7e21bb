"""Live usage equals the batch, and settling overwrites."""

import json
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import data_dir
from trajloom.operators import rollup
from trajloom.operators.decide import decide_claude, decide_codex
from trajloom.operators.state import SESSION
from trajloom.operators.usage import claude_session_usage, codex_session_usage
from trajloom.plans import adapters as a
from trajloom.plans import queries
from trajloom.sources.files import latest_session_stats
from trajloom.sources import tail
from trajloom.streaming.reduce import COLUMNS, reduce_stream, slim, use_rocksdb
from trajloom.streaming.usage import live_overview, live_usage, reread, session_rows, settle


def test_live_usage_equals_batch(spark):
    lines = a.claude_lines(spark, data_dir())
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    lines.repartition(3).write.mode("overwrite").parquet(f"{folder}/lines")
    live = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/lines")
    query = live_usage(live).writeStream.format("memory").queryName("live_usage").outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(200)
    got = {(r["project_root"], r["session_id"]): (r["tokens"], round(r["cost_usd"], 9), r["content_bytes"]) for r in spark.table("live_usage").collect()}
    want = {(r["project_root"], r["session_id"]): (r["tokens"], round(r["cost_usd"], 9), r["content_bytes"]) for r in claude_session_usage(lines, SESSION).collect()}
    assert got == want


def test_settle_overwrites_the_ended_sessions_only(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/stats"
    rows = lambda n: (lambda ended: ended.withColumn("tokens", F.lit(n)))
    ends = spark.createDataFrame([("p", "a", "SessionEnd"), ("p", "b", "SessionEnd"), ("p", "c", "Stop")], "project_root string, session_id string, hook_event_name string")
    settle(path, rows(1))(ends, 0)
    settle(path, rows(2))(ends.filter("session_id = 'a'"), 1)
    settle(path, rows(3))(ends.filter("session_id = 'c'"), 2)
    assert {r["session_id"]: r["tokens"] for r in latest_session_stats(spark, path).collect()} == {"a": 2, "b": 1}


def put(path, *lines, end="\n"):
    with open(path, "w") as out:
        out.write("\n".join(lines) + end)


def said(n):
    return json.dumps({"type": "assistant", "message": {"usage": {"input_tokens": n}}})


def count(n):
    return json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n}}}})


def test_reread_of_ended_sessions(spark):
    """Both agents; an unfinished last line counts, a missing file is no error; resumed sessions are read again in full."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    put(f"{folder}/a b.jsonl", said(5), said(7), said(30), end="")
    put(f"{folder}/x.jsonl", count(50), count(80), count(70)[:-9], end="")
    schema = "project_root string, session_id string, agent string, transcript_path string, hook_event_name string"
    rows = [("p", "a", "claude-code", f"{folder}/a b.jsonl"), ("p", "b", "claude-code", None), ("p", "c", "claude-code", ""), ("p", "d", "claude-code", f"{folder}/none.jsonl"), ("p", "x", "codex", f"file://{folder}/x.jsonl"), ("p", "y", "codex", "nowhere://x/y")]
    ended = spark.createDataFrame([(*r, "SessionEnd") for r in rows], schema)
    tokens = lambda df: {r["session_id"]: r["tokens"] for r in df.collect()}
    assert tokens(reread(ended)) == {"a": 42, "b": 0, "c": 0, "d": 0, "x": 80, "y": 0}
    assert tokens(reread(ended.filter("session_id = 'b'"))) == {"b": 0}
    settle(f"{folder}/stats", reread)(ended, 0)
    put(f"{folder}/x.jsonl", count(50), count(80), count(70), count(95))
    settle(f"{folder}/stats", reread)(ended.filter("session_id = 'x'"), 1)
    assert tokens(latest_session_stats(spark, f"{folder}/stats")) == {"a": 42, "b": 0, "c": 0, "d": 0, "x": 95, "y": 0}


@pytest.mark.parametrize("size", [1 << 20, 5])
def test_lines_by_ranges_are_the_lines(monkeypatch, size):
    """Whatever the ranges and chunks: each line once, with its position; a last one without an end only if asked for."""
    monkeypatch.setattr(tail, "RANGE", size)
    monkeypatch.setattr(tail, "CHUNK", 3)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/f.jsonl"
    data = "one\n\nthree and more\né\n\n" + "x" * 40 + "\nrest".encode().decode()
    with open(path, "wb") as out:
        out.write(data.encode())
    n = len(data.encode())
    found = [x for a, b in tail.ranges(0, n) for x in tail.lines_between(path, a, b, b == n)]
    assert [x for _, x in found] == data.split("\n")
    assert all(data.encode()[p : p + len(x.encode())].decode() == x for p, x in found)
    assert [x for a, b in tail.ranges(0, n) for _, x in tail.lines_between(path, a, b)] == data.split("\n")[:-1]


def test_tailing_waits_for_the_end_of_a_line(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    tail.register(spark)

    def read():
        stream = spark.readStream.format("tailed_lines").option("suffix", ".jsonl").load(f"{folder}/in")
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["session_id"], r["position"], r["value"]) for r in spark.read.schema(tail.SCHEMA).parquet(f"{folder}/out").collect())

    assert read() == []  # no folder yet
    os.makedirs(f"{folder}/in/session_id=q")
    put(f"{folder}/in/a.jsonl", "one", "tw", end="")
    put(f"{folder}/in/_hidden.jsonl", "no")
    put(f"{folder}/in/other.txt", "no")
    assert read() == [("a", 0, "one")]
    assert read() == [("a", 0, "one")]
    put(f"{folder}/in/a.jsonl", "one", "two", "", "three", end="")
    put(f"{folder}/in/session_id=q/part.jsonl", "q1")
    assert read() == [("a", 0, "one"), ("a", 4, "two"), ("a", 8, ""), ("q", 0, "q1")]
    put(f"{folder}/in/a.jsonl", "one", "two", "", "three")
    assert read()[3] == ("a", 9, "three") and len(read()) == 5


def test_live_overview_equals_the_batch_after_each_micro_batch(spark):
    """One running query: after each of three micro-batches it stands where a batch over the rows so far stands."""
    use_rocksdb(spark)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    projects = spark.range(10).select(F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("project_root"))
    d = data_dir()
    claude, codex = (e.withColumn("seq", F.unix_micros("ts")).filter("project_root in ('/p/0', '/p/1')") for e in (a.claude_events(spark, d, own=True), a.codex_events(spark, d)))
    events = slim(claude).withColumn("agent", F.lit("claude-code")).unionByName(slim(codex).withColumn("agent", F.lit("codex"))).persist()
    ends = events.selectExpr("percentile(seq, array(0.3, 0.6))").first()[0] + [float("inf")]
    # One model and counts that never fall: then what steps add up to is the full read.
    own = lambda x: x.filter("project_root in ('/p/0', '/p/1')")
    u1, u2 = own(a.claude_lines(spark, d)), own(a.codex_lines(spark, d)).withColumns({"model": F.when(F.col("model").isNotNull(), "gpt-5"), "total_input": F.when(F.col("is_total"), F.col("line_no") * 90_000)})
    for k, (low, high) in enumerate(zip([float("-inf"), *ends], ends)):
        new = lambda x: x.filter(F.col("line_no").between(k * 3, k * 3 + 2) if k < 2 else F.col("line_no") >= 6)
        rows = session_rows(events.filter((F.col("seq") > low) & (F.col("seq") <= high)), new(u1), new(u2))
        rows.write.mode("append").parquet(f"{folder}/rows")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/rows")
        live_overview(stream, f"{folder}/live", projects).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(f"{folder}/live/overview").filter(F.col("batch") == k).drop("batch").first()
        sofar = lambda x: x.filter(F.col("line_no") <= k * 3 + 2) if k < 2 else x
        decided = [decide(e.filter(F.col("seq") <= high), ["seq", "event_id"]).select(*SESSION, "agent", "action", "saved_bytes", "omitted_lines") for decide, e in ((decide_claude, claude), (decide_codex, codex))]
        usage = claude_session_usage(sofar(u1), SESSION).withColumn("agent", F.lit("claude-code")).unionByName(codex_session_usage(sofar(u2), SESSION, ["line_no"]).withColumn("agent", F.lit("codex")))
        want = rollup.overview(rollup.session_stats(rollup.mechanism_stats(decided[0].unionByName(decided[1])), usage), projects).first().asDict()
        assert {x: round(v, 3) for x, v in got.asDict().items()} == {x: round(v, 3) for x, v in want.items()}
        assert spark.read.parquet(f"{folder}/live/projects").filter(F.col("batch") == k).count() == 2
    events.unpersist()


def test_forgotten_outputs_count_as_new(spark):
    use_rocksdb(spark)
    row = {"project_root": "p", "session_id": "s", "tool_name": "Bash", "kind": "neutral", "is_shell": True, "eligible": True, "key": "k", "hash": "h", "tokens": 1, "n_lines": 1, "n_bytes": 3, "omitted_lines": 0, "omitted_bytes": 0, "raw_tokens": 1, "raw_bytes": 3, "reset": False, "subagent": False, "tool_call": True}
    for forget, want in ((None, ["pass", "dedup", "dedup"]), (1, ["pass", "pass", "pass"])):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        for k in range(3):
            rows = spark.createDataFrame([{**row, "seq": k, "event_id": k}]).select(*COLUMNS)
            rows.write.mode("append").parquet(f"{folder}/in")
            stream = reduce_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), forget=forget)
            stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
            time.sleep(1.5)
        assert [r["action"] for r in spark.read.schema("event_id bigint, action string").parquet(f"{folder}/out").orderBy("event_id").collect()] == want


def test_pieces_hold_each_event_once_though_percentiles_vary(spark, monkeypatch):
    """An approximate percentile depends on the order in which its parts meet: a new answer at each run may neither lose a row nor give it twice."""
    @F.udf("array<bigint>")
    def any_cuts(low, high):
        return sorted(random.randint(low, high) for _ in range(2))

    monkeypatch.setattr(F, "percentile_approx", lambda x, *_: any_cuts.asNondeterministic()(F.min(x), F.max(x)))
    want = {r["event_id"]: r["action"] for r in queries.claude_decisions(spark, data_dir()).collect()}
    got = queries.reduce_stream(spark, data_dir()).collect()
    assert len(got) == len(want) and {r["event_id"]: r["action"] for r in got} == want


def test_many_small_files_share_a_task(monkeypatch):
    """Each line once, whatever files share a task; a large file still is several tasks'."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for k in range(300):
        put(f"{folder}/s{k}.jsonl", f"a{k}", f"b{k}")
    reader = tail.TailReader({"path": folder, "suffix": ".jsonl"})
    read = lambda parts: sorted(r["value"] for p in parts for b in reader.read(p) for r in b.to_pylist())
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert len(parts) <= 3 and read(parts) == sorted(x + str(k) for x in "ab" for k in range(300))
    put(f"{folder}/s7.jsonl", "a7", "b7", "c7")
    parts = reader.partitions(end, reader.latestOffset())
    assert len(parts) == 1 and read(parts) == ["c7"]
    monkeypatch.setattr(tail, "RANGE", 4)
    parts = reader.partitions({}, {"s7.jsonl": 9})
    assert len(parts) == 3 and read(parts) == ["a7", "b7", "c7"]
