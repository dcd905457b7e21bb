"""Sequences of calls of one session, and the stream against the batch."""

import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import data_dir
from trajloom.functions import outputs as o
from trajloom.operators.decide import decide_claude, decide_codex, with_text_measures
from trajloom.operators.rollup import newest_first
from trajloom.operators.state import with_state, with_state_in_slices
from trajloom.plans import adapters as a
from trajloom.streaming.reduce import COLUMNS, reduce_stream, slim, use_rocksdb

LONG = "".join(f"word{k} and more words here\n" for k in range(200))


def claude(spark, calls):
    rows = []
    for k, (tool, arg, text) in enumerate(calls):
        hook = tool if tool in ("SessionStart", "PostCompact") else "PostToolUse"
        raw = {"Bash": lambda: {"stdout": text, "stderr": "", "interrupted": False, "isImage": False}, "Grep": lambda: {"content": text}, "Glob": lambda: {"filenames": text.split("\n")}}.get(tool, lambda: {"file": text})()
        import json

        rows.append((k, "p", "s", hook, tool, json.dumps({"command": arg}), json.dumps(raw)))
    e = spark.createDataFrame(rows, "seq bigint, project_root string, session_id string, hook_event_name string, tool_name string, tool_input string, tool_response string")
    e = with_text_measures(o.normalize_claude(e), "text", "raw_text").withColumn("eligible", F.col("is_shell") & F.col("text").isNotNull())
    return [r["action"] for r in decide_claude(e, ["seq"]).orderBy("seq").collect()]


def codex(spark, calls):
    import json

    rows = []
    for k, (tool, arg, text) in enumerate(calls):
        hook = tool if tool in ("SessionStart", "SubagentStart") else "PostToolUse"
        rows.append((k, "p", "s", hook, tool, json.dumps({"cmd": arg}), json.dumps(text)))
    e = spark.createDataFrame(rows, "seq bigint, project_root string, session_id string, hook_event_name string, tool_name string, tool_input string, tool_response string")
    e = with_text_measures(o.normalize_codex(e)).withColumn("eligible", F.col("can_rewrite"))
    return [r["action"] for r in decide_codex(e, ["seq"]).orderBy("seq").collect()]


CLAUDE = [
    ([("Bash", "echo hi", "hi\n")] * 2, ["pass", "dedup"]),
    ([("Bash", "date", "Mon\n"), ("Bash", "date", "Tue\n"), ("Bash", "date", "Mon\n")], ["pass"] * 3),
    ([("Bash", "x", LONG)] * 2, ["trim", "dedup"]),
    ([("Read", "", "a"), ("Edit", "", "a")], ["pass", "nudge"]),
    ([("Edit", "", "a"), ("Edit", "", "a")], ["pass", "pass"]),
    ([("Grep", "", "a"), ("Write", "", "a"), ("Edit", "", "a")], ["pass", "nudge", "pass"]),
    ([("Read", "", "a"), ("Edit", "", "a"), ("Grep", "", LONG), ("Read", "", "b")], ["pass", "nudge", "retire_boundary", "pass"]),
    ([("Read", "", "a"), ("Edit", "", "a"), ("Bash", "x", LONG), ("Bash", "x", LONG)], ["pass", "nudge", "bash_retire", "dedup"]),
    ([("Read", "", "a")] * 20 + [("Grep", "", "b")], ["pass"] * 20 + ["retire_threshold"]),
    ([("Read", "", "a")] * 20 + [("SessionStart", "", ""), ("Read", "", "a")], ["pass"] * 22),
    ([("Glob", "", "\n".join(f"some/long/path/number{k}" for k in range(200))), ("Grep", "", LONG), ("WebFetch", "", LONG)], ["trim", "trim", "pass"]),
    ([("Bash", "x", "a"), ("PostCompact", "", ""), ("Bash", "x", "a")], ["pass"] * 3),
]


@pytest.mark.parametrize("calls,want", CLAUDE)
def test_claude(spark, calls, want):
    assert claude(spark, calls) == want


CODEX = [
    ([("SubagentStart", "", ""), ("apply_patch", "", "x"), ("exec_command", "cat a", LONG)], ["pass", "nudge", "retire_boundary"]),
    ([("exec_command", "rg a", "x"), ("apply_patch", "", "x"), ("exec_command", "go test ./...", LONG)], ["pass", "nudge", "bash_retire"]),
    ([("exec_command", "cat a", LONG), ("apply_patch", "", "x"), ("exec_command", "cat a", LONG)], ["trim", "nudge", "dedup"]),
    ([("mcp__x", "", LONG), ("other", "", LONG)], ["pass", "pass"]),
]


@pytest.mark.parametrize("calls,want", CODEX)
def test_codex(spark, calls, want):
    assert codex(spark, calls) == want


@pytest.mark.parametrize("kind", ["claude", "codex"])
def test_stream_equals_batch(spark, kind):
    """In three files of strictly increasing times."""
    use_rocksdb(spark)
    events = (a.claude_events if kind == "claude" else a.codex_events)(spark, data_dir()).withColumn("seq", F.unix_micros("ts"))
    want = {r["event_id"]: (r["action"], r["saved_bytes"]) for r in (decide_claude if kind == "claude" else decide_codex)(events, a.ORDER).collect()}
    rows = slim(events).orderBy("seq", "event_id").toPandas()
    folder, out = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = slim(events).schema
    third = len(rows) // 3 + 1
    for k in range(3):
        rows[k * third : (k + 1) * third].to_json(f"{folder}/{k}.json", orient="records", lines=True)
        time.sleep(1.1)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder).select(*COLUMNS)
    query = reduce_stream(live, codex=kind == "codex").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {r["event_id"]: (r["action"], r["saved_bytes"]) for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == want


def test_random_sequences_fold(spark):
    """The windows equal a plain fold over random calls."""
    r = random.Random(4)
    texts = ["a", "b", LONG]
    calls = [r.choice([("Bash", r.choice("xy"), r.choice(texts)), ("Read", "", r.choice(texts)), ("Edit", "", "z"), ("Grep", "", r.choice(texts)), ("SessionStart", "", "")]) for _ in range(120)]
    looked, crossed, ledger, want = 0, False, {}, []
    for tool, arg, text in calls:
        if tool == "SessionStart":
            looked, crossed, ledger = 0, False, {}
            want.append("pass")
            continue
        looked += tool in ("Read", "Grep")
        if tool == "Edit":
            now = looked > 0 and not crossed
            crossed |= now
            want.append("nudge" if now else "pass")
        elif tool == "Bash":
            same = ledger.get(arg) == text
            ledger[arg] = text
            want.append("dedup" if same else ("bash_retire" if crossed else "trim") if text is LONG else "pass")
        elif crossed:
            want.append("retire_boundary" if text is LONG else "pass")
        elif looked > 20:
            want.append("retire_threshold")
        else:
            want.append("trim" if tool == "Grep" and text is LONG else "pass")
    assert claude(spark, calls) == want


def test_random_sequences_fold_codex(spark):
    """The second agent's windows equal a plain fold: repeats come before retiring, only changeable outputs count."""
    r = random.Random(9)
    texts = ["a", "b", LONG]
    calls = [r.choice([("shell", r.choice(["cat x", "make y"]), r.choice(texts)), ("read_file", "", r.choice(texts)), ("apply_patch", "", "z"), ("mcp__t", "", LONG), ("SubagentStart", "", ""), ("SessionStart", "", "")]) for _ in range(160)]
    looked, crossed, ledger, want = 0, False, {}, []
    for tool, arg, text in calls:
        looks = tool in ("read_file", "SubagentStart") or arg == "cat x"
        if tool == "SessionStart":
            looked, crossed, ledger = 0, False, {}
            want.append("pass")
            continue
        looked += looks
        if tool == "apply_patch":
            now = looked > 0 and not crossed
            crossed |= now
            want.append("nudge" if now else "pass")
        elif tool in ("mcp__t", "SubagentStart"):
            want.append("pass")
        else:
            same = ledger.get((tool, arg)) == text
            ledger[tool, arg] = text
            long = text is LONG
            want.append("dedup" if same else ("retire_boundary" if long else "pass") if looks and crossed else "retire_threshold" if looks and looked > 20 else "bash_retire" if tool == "shell" and crossed and long else "trim" if long else "pass")
    assert codex(spark, calls) == want


@pytest.mark.parametrize("slices", [3, 9])
def test_state_by_slices_equals_windows(spark, slices):
    """A session with most events, null keys, ties of the first order column, resets; every column, whatever the slices."""
    r = random.Random(slices)
    rows = []
    for k in range(900):
        session = "hot" if r.random() < 0.7 else r.choice(["a", "b", None])
        hook = "SessionStart" if r.random() < 0.01 else r.choice(["PostToolUse"] * 9 + ["SubagentStop"])
        rows.append(("p", session, k // 3, k, hook, r.choice(["investigate"] * 3 + ["implement", "neutral", None]), r.random() < 0.8, r.choice(["x", "y", "z", None]), r.choice(["1", "2", None])))
    df = spark.createDataFrame(rows, "project_root string, session_id string, ts bigint, event_id bigint, hook_event_name string, class string, eligible boolean, key string, hash string")
    def save(x):
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/x"
        x.write.parquet(path)
        return spark.read.schema(x.schema).parquet(path)

    columns = ["event_id", "epoch", "investigate_count", "crossing", "past_boundary", "over_threshold", "is_repeat", "turn", "repeat_of_turn"]
    got = sorted(tuple(x) for x in with_state_in_slices(df, ["ts", "event_id"], save, 20, slices).select(*columns).collect())
    want = sorted(tuple(x) for x in with_state(df, ["ts", "event_id"], 20).select(*columns).collect())
    assert [x[:8] for x in got] == [x[:8] for x in want] and [x[8] for x in got] == [x[8] for x in want]
    assert len(got) == 900 and with_state_in_slices(df.limit(0), ["ts", "event_id"], save, 20, 2).count() == 0


def test_places_by_ranges_of_time(spark):
    r = random.Random(3)
    rows = [("/p/hot" if r.random() < 0.8 else "/p/x", f"s{k}", None if k % 50 == 0 else r.randrange(40)) for k in range(400)]
    df = spark.createDataFrame(rows, "project_root string, session_id string, mtime bigint")
    want = {}
    for p in ("/p/hot", "/p/x"):
        own = sorted((-1 if m is None else m, s) for q, s, m in rows if q == p)
        own = sorted(own, key=lambda x: (-x[0], x[1]))
        want |= {s: k + 1 for k, (_, s) in enumerate(own)}
    assert {x["session_id"]: x["place"] for x in newest_first(df, 7).collect()} == want
