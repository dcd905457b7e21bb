"""The registered queries of the trajectory jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajloom.functions import classify as c
from trajloom.functions import outputs as o
from trajloom.functions import savings as s
from trajloom.functions import text as t
from trajloom.functions.pricing import price_claude, price_openai
from trajloom.operators import archive as ar
from trajloom.operators import decide as d
from trajloom.operators import projects as p
from trajloom.operators import reduce as rd
from trajloom.operators import rollup as r
from trajloom.operators import state as st
from trajloom.operators import usage as u
from trajloom.plans import adapters as a
from trajloom.sources import files, tail
from trajloom.streaming import usage as live
from trajloom.streaming.reduce import reduce_stream as live_decisions
from trajloom.streaming.reduce import slim, use_rocksdb

ORDER = a.ORDER


def _documents(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))


def _claude(spark, sf_dir, measures=None):
    return d.decide_claude(a.claude_events(spark, sf_dir, measures=measures), ORDER)


def _codex(spark, sf_dir, measures=None):
    return d.decide_codex(a.codex_events(spark, sf_dir, measures=measures), ORDER)


def _measured(spark, sf_dir):
    """The documents' measures, written once for queries of both agents."""
    return _saved(spark)(a.measured(spark, sf_dir))


def _texts(spark, sf_dir):
    """doc_id, text: decided rows carry the number of their output."""
    return _documents(spark, sf_dir).select("doc_id", "text")


def _decided(spark, sf_dir):
    """The first agent's decisions, written once for queries that read them twice."""
    path = _shared(spark)
    df = _claude(spark, sf_dir).select(*st.SESSION, "epoch", "event_id", "doc_id", "action", "saved_bytes", "hash", "is_shell", "tool_name", "key", "repeat_of_turn")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", t.estimated_tokens(F.col("text")).alias("tokens"))


def trim_head_tail(spark, sf_dir):
    x = F.col("text")
    long = t.trims(x)
    return _documents(spark, sf_dir).select("doc_id", long.alias("trimmed"), F.when(long, t.omitted_lines(x)).otherwise(0).cast("bigint").alias("omitted_lines"), F.when(long, t.omitted_bytes(x)).otherwise(0).cast("bigint").alias("omitted_bytes"), F.md5(F.when(long, t.trimmed(x)).otherwise(x)).alias("text_md5"))


def trim_summary_by_lang(spark, sf_dir):
    x = F.col("text")
    df = d.with_text_measures(_documents(spark, sf_dir))
    long = (F.col("tokens") > t.MAX_TOKENS) & (F.col("n_lines") > t.HEAD + t.TAIL)
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.sum(long.cast("bigint")).alias("trims"), F.sum(F.when(long, F.col("omitted_bytes")).otherwise(0)).alias("omitted_bytes"), F.max(F.octet_length(x)).cast("bigint").alias("longest"))


def content_hash_dups(spark, sf_dir):
    x = F.col("text")
    g = _documents(spark, sf_dir).groupBy(t.content_id(x).alias("content_id")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
    return g.filter(F.col("copies") > 1)


# Commands that the events are dealt.
COMMANDS = ["cat a.txt", "ls -la", "rg foo | head", "tail -n 5 x", "tail -f log", "find . -name x", "find . -delete", "git status", "git push", "go test -list .", "go test ./...", "curl http://x", "curl -o f http://x", "wget -O f http://x", "wget http://x", "make all", "grep -r a .; rm b", "echo $(date)", "", "head -3 f", "tail --follow=name f", "go test -list", "git", "wc -l f", "cat a > b"]


def classify_commands(spark, sf_dir):
    e = a.tool_events(spark, sf_dir)
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("event_id") % len(COMMANDS) + 1).cast("int"))
    return e.withColumn("command", command).groupBy("command").agg(F.count(F.lit(1)).alias("calls")).select("command", c.classify_command(F.col("command")).alias("class"), "calls")


def tool_class_counts(spark, sf_dir):
    measures = _measured(spark, sf_dir)
    x = a.codex_events(spark, sf_dir, measures).select("tool_name", "class", F.lit("codex").alias("agent"))
    y = a.claude_events(spark, sf_dir, measures=measures).select("tool_name", "class", F.lit("claude-code").alias("agent"))
    return x.unionByName(y).filter(F.col("tool_name").isNotNull()).groupBy("agent", "tool_name", "class").agg(F.count(F.lit(1)).alias("calls"))


def routed_events(spark, sf_dir):
    return a.tool_events(spark, sf_dir).groupBy(c.route_event(F.col("hook_event_name")).alias("route")).agg(F.count(F.lit(1)).alias("events"))


def epochs(spark, sf_dir):
    e = st.with_epoch(a.tool_events(spark, sf_dir), ORDER)
    return e.groupBy(*st.SESSION, "epoch").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("least_event"))


def investigate_counts(spark, sf_dir):
    return _claude(spark, sf_dir).select("event_id", "epoch", "investigate_count", "over_threshold")


def phase_boundary(spark, sf_dir):
    return _claude(spark, sf_dir).select("event_id", "crossing", "past_boundary")


def repeat_detection(spark, sf_dir):
    return _claude(spark, sf_dir).filter("eligible").select("event_id", "is_repeat", "turn", "repeat_of_turn")


def sliced_state(spark, sf_dir):
    """The state of calls where a third of all users is one session, by slices of sessions."""
    hot = (F.col("session_id").cast("bigint") % 3) == 0
    e = a.claude_events(spark, sf_dir).withColumns({"project_root": F.when(hot, "/p/hot").otherwise(F.col("project_root")), "session_id": F.when(hot, "hot").otherwise(F.col("session_id"))})
    found = st.with_state_in_slices(e, ORDER, _saved(spark))
    return found.select("event_id", "epoch", "investigate_count", "crossing", "past_boundary", "over_threshold", "is_repeat", "turn", "repeat_of_turn")


def claude_decisions(spark, sf_dir):
    return _claude(spark, sf_dir).select("event_id", "action", "saved_bytes")


def codex_decisions(spark, sf_dir):
    return _codex(spark, sf_dir).select("event_id", "action", "saved_bytes")


def decision_counts(spark, sf_dir):
    measures = _measured(spark, sf_dir)
    x = _claude(spark, sf_dir, measures).select("action", "saved_bytes", F.lit("claude-code").alias("rules")).unionByName(_codex(spark, sf_dir, measures).select("action", "saved_bytes", F.lit("codex").alias("rules")))
    return x.groupBy("rules", "action").agg(F.count(F.lit(1)).alias("calls"), F.sum("saved_bytes").alias("saved_bytes"))


def archive_contents(spark, sf_dir):
    return ar.archive(_claude(spark, sf_dir), _texts(spark, sf_dir), "doc_id").select(*ar.KEY, "n_bytes")


def live_archive(spark, sf_dir):
    decided = _decided(spark, sf_dir)
    return ar.live_archive(ar.archive(decided, _texts(spark, sf_dir), "doc_id"), decided).select(*ar.KEY, "n_bytes")


def reduced_outputs(spark, sf_dir):
    return ar.reduced(_claude(spark, sf_dir), _texts(spark, sf_dir), "doc_id").select("event_id", "action", "content_id", F.md5("reduced").alias("reduced_md5"))


def recover_content(spark, sf_dir):
    decided, texts = _decided(spark, sf_dir), _texts(spark, sf_dir)
    found = ar.recover(ar.reduced(decided, texts, "doc_id"), ar.archive(decided, texts, "doc_id"))
    return found.select("event_id", "content_id", F.md5("content").alias("content_md5"), "n_bytes")


def compaction_points(spark, sf_dir):
    return d.compaction_points(_claude(spark, sf_dir)).select(*st.SESSION, "epoch", "event_id", "investigate_count")


def _claude_usage(spark, sf_dir):
    return u.claude_session_usage(a.claude_lines(spark, sf_dir), st.SESSION)


def _codex_usage(spark, sf_dir):
    return u.codex_session_usage(a.codex_lines(spark, sf_dir), st.SESSION, ["line_no"])


def _usage(spark, sf_dir):
    return _claude_usage(spark, sf_dir).withColumn("agent", F.lit("claude-code")).unionByName(_codex_usage(spark, sf_dir).withColumn("agent", F.lit("codex")))


def claude_usage(spark, sf_dir):
    return _claude_usage(spark, sf_dir).withColumn("cost_usd", F.round("cost_usd", 6))


def codex_usage(spark, sf_dir):
    return _codex_usage(spark, sf_dir).withColumn("cost_usd", F.round("cost_usd", 6))


def usage_deltas(spark, sf_dir):
    x = a.codex_lines(spark, sf_dir).filter("is_total")
    return u.usage_deltas(x, st.SESSION, ["line_no"], ["total_input", "total_cached", "total_write"]).select("session_id", "line_no", "total_input_delta", "total_cached_delta", "total_write_delta")


def model_in_force(spark, sf_dir):
    return u.with_model_in_force(a.codex_lines(spark, sf_dir), st.SESSION, ["line_no"]).select("session_id", "line_no", "model")


def price_lookup(spark, sf_dir):
    x = price_claude(a.claude_lines(spark, sf_dir).filter("type = 'assistant'")).withColumn("family", F.lit("claude"))
    y = price_openai(a.codex_lines(spark, sf_dir).filter("model is not null")).withColumn("family", F.lit("openai"))
    cols = ["family", F.coalesce("model", F.lit("")).alias("model"), "priced_as", "input", "cache_write_1h"]
    return x.select(*cols).unionByName(y.select(*cols)).groupBy("family", "model", "priced_as", "input", "cache_write_1h").agg(F.count(F.lit(1)).alias("n_lines"))


def _stats(spark, sf_dir):
    cols = [*st.SESSION, "agent", "action", "saved_bytes", "omitted_lines"]
    measures = _measured(spark, sf_dir)
    decided = d.decide_claude(a.claude_events(spark, sf_dir, True, measures), ORDER).select(cols).unionByName(_codex(spark, sf_dir, measures).select(cols))
    return r.session_stats(r.mechanism_stats(decided), _usage(spark, sf_dir))


def _rounded(df, *more):
    return df.withColumns({x: F.round(x, 4) for x in (*more, "transcript_cost_usd") if x in df.columns})


def session_stats(spark, sf_dir):
    return _rounded(_stats(spark, sf_dir))


def sessions_worth_keeping(spark, sf_dir):
    return _stats(spark, sf_dir).filter(s.worth_keeping()).select(*st.SESSION, s.has_activity().alias("active"), F.round(s.percent_saved(), 4).alias("percent_saved"))


def project_rollup(spark, sf_dir):
    return _rounded(r.project_rollup(_stats(spark, sf_dir)), "tokens_saved", "dollars_saved")


def _registry(spark, sf_dir):
    return p.register_projects(a.tool_events(spark, sf_dir), spark.createDataFrame([("/p/gone",), ("/p/0",)], "project_root string"))


def _existing(spark, sf_dir):
    """Directories that exist: those of suppliers, all but one."""
    return a.table(spark, sf_dir, "supplier").select(F.concat(F.lit("/p/"), (F.col("s_suppkey") % 10).cast("string")).alias("dir")).filter("dir <> '/p/7'").distinct()


def live_projects(spark, sf_dir):
    return p.live_projects(_registry(spark, sf_dir), _existing(spark, sf_dir))


def overview(spark, sf_dir):
    return _rounded(r.overview(_stats(spark, sf_dir), live_projects(spark, sf_dir)), "tokens_saved", "dollars_saved")


def overview_texts(spark, sf_dir):
    df = r.overview(_stats(spark, sf_dir), live_projects(spark, sf_dir))
    return df.select(s.headline().alias("headline"), s.stretch_text().alias("stretch_text"), *[v.alias(k) for k, v in s.card_texts(F.col("tokens_saved"), F.col("dollars_saved")).items()])


def savings_rollup(spark, sf_dir):
    return _rounded(r.savings_rollup(_stats(spark, sf_dir)), "tokens_saved", "dollars_saved", "percent_saved").withColumn("level", F.col("level").cast("bigint"))


def mechanism_breakdown(spark, sf_dir):
    df = r.mechanism_breakdown(r.project_rollup(_stats(spark, sf_dir)), ["project_root"])
    return df.withColumns({"percent": F.round("percent", 4), "fill": F.round("fill", 4), "place": F.col("place").cast("bigint")})


def _seen(spark, sf_dir):
    last = a.tool_events(spark, sf_dir).groupBy(*st.SESSION).agg(F.max("ts").alias("mtime"))
    return _stats(spark, sf_dir).join(last, st.SESSION)


def sessions_newest_first(spark, sf_dir):
    return r.newest_first(_seen(spark, sf_dir)).select(*st.SESSION, F.col("place").cast("bigint").alias("place"))


def latest_agent_session(spark, sf_dir):
    return r.latest_agent_session(_seen(spark, sf_dir)).withColumn("last_seen", F.unix_micros("last_seen"))


def agent_status(spark, sf_dir):
    """Configured at the middle of the log; the second agent is watched in the first half only, a third never."""
    seen = _seen(spark, sf_dir)
    middle = a.table(spark, sf_dir, "events").agg(F.timestamp_micros(F.floor((F.unix_micros(F.min(F.col("ts").cast("timestamp"))) + F.unix_micros(F.max(F.col("ts").cast("timestamp")))) / 2)).alias("configured_at"))
    agents = spark.createDataFrame([("claude-code", True), ("codex", True), ("other", True), ("unset", False)], "agent string, configured boolean").crossJoin(middle)
    latest = r.latest_agent_session(seen.crossJoin(F.broadcast(middle)).filter((F.col("agent") != "codex") | (F.col("mtime") < F.col("configured_at"))))
    return p.agent_status(agents, latest).select("agent", "status")


def resolve_project(spark, sf_dir):
    """Customers' directories: a nation's root is a repository where its key is even, the region's where it is odd."""
    n = a.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    e = a.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    region = F.concat(F.lit("/home/u/r"), F.col("n_regionkey").cast("string"))
    e = e.select("c_custkey", F.concat(region, F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string")).alias("cwd"), F.lit("/home/u").alias("cwd_home"))
    region_n = F.concat(F.lit("/home/u/r"), F.col("n_regionkey").cast("string"))
    roots = n.filter("n_nationkey % 2 = 0").select(F.concat(region_n, F.lit("/n"), F.col("n_nationkey").cast("string")).alias("dir")).union(n.filter("n_regionkey % 2 = 1").select(region_n.alias("dir"))).union(n.select(F.lit("/home").alias("dir")))
    return p.resolve_project(e, roots).select("c_custkey", "project_root", t.project_slug(F.col("project_root")).alias("slug"))


def fold_legacy(spark, sf_dir):
    """Suppliers as old lifetime rows, each source twice."""
    x = a.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("source"), F.concat(F.lit("/p/"), (F.col("s_suppkey") % 10).cast("string")).alias("project_root"), *[(F.col("s_suppkey") * (k + 1)).cast("bigint").alias(name) for k, name in enumerate(s.COUNTERS)])
    out = r.fold_legacy(x.union(x), _stats(spark, sf_dir))
    return out.groupBy("project_root").agg(F.count(F.lit(1)).alias("sessions"), *[F.sum(k).alias(k) for k in s.COUNTERS])


def session_receipts(spark, sf_dir):
    return r.session_report(_stats(spark, sf_dir), t.PREFIX).select(*st.SESSION, "receipt")


def _shared(spark):
    """A new folder in the one that the cluster names; a machine-local one only where none is named and everything runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = found or f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    return f"{found.rstrip('/')}/trajloom-{uuid.uuid4().hex}"


def _pieces(df, at, spark, folder, run):
    """Lands df in three pieces by the column at (0, 1, 2), one after another, and runs the stream over what is new each time."""
    for k in range(3):
        df.filter(F.col(at) == k).drop(at).write.mode("append").parquet(folder)
        run(spark.readStream.schema(df.drop(at).schema).parquet(folder))


def _thirds(spark, sf_dir):
    """Two times that cut the events into thirds, found once: an approximate percentile may come out otherwise each time that it is worked out, and rows between two answers would be lost or come twice."""
    seq = F.unix_micros(F.col("ts").cast("timestamp"))
    return a.table(spark, sf_dir, "events").agg(F.percentile_approx(seq, [1 / 3, 2 / 3])).first()[0] or [0, 0]  # two numbers


def _by_time(events, cuts):
    """piece (0, 1, 2): the third that seq falls into; a row without one is in the last."""
    return events.withColumn("piece", F.when(F.col("seq") <= cuts[0], 0).when(F.col("seq") <= cuts[1], 1).otherwise(2))


def _live(spark, sf_dir, events, codex, sink):
    """The stream over all events, in three micro-batches with the state between them."""
    use_rocksdb(spark)
    folder = _shared(spark)
    pieces = _by_time(slim(events.withColumn("seq", F.unix_micros("ts"))), _thirds(spark, sf_dir))

    def run(live):
        out = live_decisions(live, codex).withColumn("agent", F.lit("codex" if codex else "claude-code"))
        sink(out.writeStream, f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    _pieces(pieces, "piece", spark, f"{folder}/events", run)
    return f"{folder}/out"


def _rows(writer, path):
    return writer.format("parquet").option("path", path)


def reduce_stream(spark, sf_dir):
    """The first agent's decisions by the stream."""
    path = _live(spark, sf_dir, a.claude_events(spark, sf_dir, measures=_measured(spark, sf_dir)), False, _rows)
    return spark.read.schema("event_id bigint, action string, saved_bytes bigint").parquet(path)


def reduce_stream_codex(spark, sf_dir):
    """The second agent's decisions by the stream."""
    path = _live(spark, sf_dir, a.codex_events(spark, sf_dir, _measured(spark, sf_dir)), True, _rows)
    return spark.read.schema("event_id bigint, action string, saved_bytes bigint").parquet(path)


def _by_turn(lines):
    return lines.withColumn("piece", F.when(F.col("line_no") < 3, 0).when(F.col("line_no") < 6, 1).otherwise(2))


def live_overview(spark, sf_dir):
    """The overview that one running query over decisions and usage of both agents keeps, as of its third micro-batch."""
    use_rocksdb(spark)
    folder, measures = _shared(spark), _measured(spark, sf_dir)
    events = [slim(e.withColumn("seq", F.unix_micros("ts"))).withColumn("agent", F.lit(name)) for e, name in ((a.claude_events(spark, sf_dir, True, measures), "claude-code"), (a.codex_events(spark, sf_dir, measures), "codex"))]
    both = _by_time(events[0].unionByName(events[1]), _thirds(spark, sf_dir))
    of = lambda df, k: df.filter(F.col("piece") == k).drop("piece")
    claude, codex = _by_turn(a.claude_lines(spark, sf_dir)), _by_turn(a.codex_lines(spark, sf_dir))
    projects = live_projects(spark, sf_dir)
    for k in range(3):
        rows = live.session_rows(of(both, k), of(claude, k), of(codex, k))
        rows.write.mode("append").parquet(f"{folder}/rows")
        query = live.live_overview(spark.readStream.schema(rows.schema).parquet(f"{folder}/rows"), f"{folder}/live", projects)
        query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    made = spark.read.parquet(f"{folder}/live/overview")
    return _rounded(made.orderBy(F.desc("batch")).limit(1).drop("batch"), "tokens_saved", "dollars_saved")


def live_codex_usage(spark, sf_dir):
    """The second agent's usage from cumulative counts read in three pieces."""
    use_rocksdb(spark)
    folder = _shared(spark)
    lines = _by_turn(a.codex_lines(spark, sf_dir))

    def run(stream):
        _rows(live.live_codex_usage(stream).writeStream, f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    _pieces(lines, "piece", spark, f"{folder}/lines", run)
    steps = spark.read.schema("project_root string, session_id string, tokens bigint, cost_usd double, content_bytes bigint").parquet(f"{folder}/out")
    return steps.groupBy(*st.SESSION).agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.sum("content_bytes").alias("content_bytes"))


def _project(df):
    """Conversations' sessions are named s<conv_id>."""
    return df.withColumn("project_root", F.concat(F.lit("/p/"), (F.substring("session_id", 2, 30).cast("bigint") % 10).cast("string")))


def _tailed(spark, lines, start):
    """Files that grow by two lines and a half, again, and to their end; the stream reads on each time."""
    tail.register(spark)
    use_rocksdb(spark)
    folder = _shared(spark)
    for cut in (3, 6, None):
        a.write_growing(lines, f"{folder}/files", cut)
        stream = spark.readStream.format("tailed_lines").option("suffix", ".jsonl").load(f"{folder}/files")
        start(stream, f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/out"


def tailed_transcripts(spark, sf_dir):
    """The first agent's usage from files that are still being written."""
    def start(stream, out):
        usage = live.live_usage(_project(files.transcript_lines(stream)))
        return usage.writeStream.outputMode("update").foreachBatch(lambda batch, n: files.write_session_stats(batch, out, version=n))

    found = files.latest_session_stats(spark, _tailed(spark, a.transcript_json(spark, sf_dir), start))
    return found.withColumn("cost_usd", F.round("cost_usd", 6))


def tailed_rollouts(spark, sf_dir):
    """The second agent's likewise, from cumulative counts."""
    def start(stream, out):
        lines = _project(files.rollout_lines(stream, "position")).withColumnRenamed("position", "line_no")
        return _rows(live.live_codex_usage(lines).writeStream, out)

    out = _tailed(spark, a.rollout_json(spark, sf_dir), start)
    steps = spark.read.schema("project_root string, session_id string, tokens bigint, cost_usd double, content_bytes bigint").parquet(out)
    return steps.groupBy(*st.SESSION).agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.sum("content_bytes").alias("content_bytes"))


def settled_sessions(spark, sf_dir):
    """Sessions of both agents that end, go on and end again: their files are read in full each time, the last version of each stands."""
    folder = _shared(spark)
    lines = {"claude-code": a.transcript_json(spark, sf_dir), "codex": a.rollout_json(spark, sf_dir)}
    for cut in (4, None):
        ends = []
        for agent, x in lines.items():
            a.write_growing(x, f"{folder}/{agent}", cut)
            path = F.concat(F.lit(f"{folder}/{agent}/"), "session_id", F.lit(".jsonl"))
            ends.append(_project(x.select("session_id").distinct()).select(*st.SESSION, F.lit(agent).alias("agent"), path.alias("transcript_path"), F.lit("SessionEnd").alias("hook_event_name")))
        live.settle(f"{folder}/stats", live.reread)(ends[0].unionByName(ends[1]), 0)
    return files.latest_session_stats(spark, f"{folder}/stats").withColumn("cost_usd", F.round("cost_usd", 6))


def _raw(spark, sf_dir, codex):
    """Raw events, read back from JSON lines. The files are compressed (one is read by one task, so a file holds a bounded number of lines)."""
    path = _shared(spark)
    lines = a.event_lines(a.raw_codex_events(spark, sf_dir) if codex else a.raw_claude_events(spark, sf_dir))
    lines.write.option("compression", "snappy").option("maxRecordsPerFile", 50_000).text(path)
    return files.read_tool_events(spark, path).withColumnsRenamed({"seq": "event_id"}).withColumn("project_root", F.col("cwd"))


def raw_claude_normalized(spark, sf_dir):
    """What raw events of the first agent say: class, key, text that can be changed, raw response."""
    e = o.normalize_claude(_raw(spark, sf_dir, False))
    return e.select("event_id", "class", "is_shell", "key", F.md5("text").alias("text_md5"), F.md5("raw_text").alias("raw_md5"))


def raw_codex_normalized(spark, sf_dir):
    e = o.normalize_codex(_raw(spark, sf_dir, True))
    return e.select("event_id", "class", "is_shell", "can_rewrite", F.when(F.col("can_rewrite"), F.col("key")).alias("key"), F.md5("text").alias("text_md5"))


def _saved(spark):
    def save(df):
        path = _shared(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def _reduce(spark, sf_dir, codex):
    """Raw events, reduced."""
    return rd.reduce_trajectories(_raw(spark, sf_dir, codex), ["event_id"], codex=codex, save=_saved(spark))


def reduced_trajectories_claude(spark, sf_dir):
    x = _reduce(spark, sf_dir, False)
    return x.outputs.select("event_id", "action", "content_id", F.md5("updated_output").alias("output_md5"))


def reduced_trajectories_codex(spark, sf_dir):
    x = _reduce(spark, sf_dir, True)
    return x.outputs.select("event_id", "action", "content_id", F.md5("updated_output").alias("output_md5"))


def stored_reduced(spark, sf_dir):
    """Both agents' replacements, written and read back."""
    path = _shared(spark)
    for codex in (False, True):
        files.write_reduced(_reduce(spark, sf_dir, codex).outputs, path)
    return files.read_reduced(spark, path).select(*st.SESSION, "event_id", "action", "content_id", F.md5("updated_output").alias("output_md5"))


def stats_files(spark, sf_dir):
    """Tallies in files of their own, corrupt and old ones among them."""
    path = _shared(spark)
    a.write_files(a.stats_json(spark, sf_dir), path)
    return files.read_session_stats(spark, path).select("session_id", "agent", *s.COUNTERS, *s.USAGE)


def stored_archive(spark, sf_dir):
    """Both agents' archives of raw events, stored in two portions, the second one twice, and read back."""
    path = _shared(spark)
    claude, codex = (_saved(spark)(_reduce(spark, sf_dir, x).archive) for x in (False, True))
    for portion in (claude, codex, codex):
        files.write_archive(portion, path)
    return files.read_archive(spark, path).select(*ar.KEY, F.md5("content").alias("content_md5"), "n_bytes")


def stored_stats(spark, sf_dir):
    """Tallies of raw events stored in two portions, both twice, and read back."""
    path = _shared(spark)
    tallies = [_reduce(spark, sf_dir, codex).tallies for codex in (False, True)]
    for portion in (*tallies, *tallies):
        files.write_session_stats(portion, path)
    return files.latest_session_stats(spark, path)


def trimmed_lists(spark, sf_dir):
    """Lines of documents as lists of short entries."""
    entries = F.split("text", "\n")
    x = _documents(spark, sf_dir).select("doc_id", t.trimmed_entries(entries).alias("e"))
    return x.select("doc_id", F.size("e").cast("bigint").alias("n"), F.md5(F.array_join("e", "\n")).alias("entries_md5"))


def _as_files(spark, df):
    """Lines (session_id, n, line) as a text file for each session, as agents leave them."""
    path = _shared(spark)
    a.write_growing(df, path)
    return path


def transcript_files(spark, sf_dir):
    """The first agent's transcripts as JSON lines, broken and mistyped ones among them, read from files."""
    x = a.transcript_json(spark, sf_dir)
    lines = files.read_transcripts(spark, _as_files(spark, x))
    return u.claude_session_usage(lines, ["session_id"]).withColumn("cost_usd", F.round("cost_usd", 6))


def rollout_files(spark, sf_dir):
    """The second agent's rollouts likewise; contents are strings, lists of parts or something else."""
    lines = files.read_rollouts(spark, _as_files(spark, a.rollout_json(spark, sf_dir)))
    return u.codex_session_usage(lines, ["session_id"], ["split", "line_no"]).withColumn("cost_usd", F.round("cost_usd", 6))


def mechanism_levels(spark, sf_dir):
    """The breakdown of sessions, of projects and of the whole."""
    levels = r.savings_rollup(_stats(spark, sf_dir)).withColumn("level", F.col("level").cast("bigint"))
    df = r.mechanism_breakdown(levels, ["level", "project_root", "session_id"])
    return df.withColumns({"percent": F.round("percent", 4), "fill": F.round("fill", 4), "place": F.col("place").cast("bigint")})


NAMES = [
    estimated_tokens, trim_head_tail, trim_summary_by_lang, content_hash_dups, classify_commands, tool_class_counts, routed_events, epochs, investigate_counts, phase_boundary, repeat_detection, sliced_state,
    claude_decisions, codex_decisions, decision_counts, archive_contents, live_archive, reduced_outputs, recover_content, compaction_points, claude_usage, codex_usage, usage_deltas, model_in_force, price_lookup,
    session_stats, sessions_worth_keeping, project_rollup, live_projects, overview, overview_texts, savings_rollup, mechanism_breakdown, sessions_newest_first, latest_agent_session, agent_status, resolve_project, fold_legacy, session_receipts, reduce_stream, reduce_stream_codex, live_overview,
    live_codex_usage, tailed_transcripts, tailed_rollouts, settled_sessions, raw_claude_normalized, raw_codex_normalized, reduced_trajectories_claude, reduced_trajectories_codex, stored_reduced, stats_files, stored_archive, stored_stats, trimmed_lists, transcript_files, rollout_files, mechanism_levels,
]
QUERIES = {f.__name__: f for f in NAMES}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_counts(spark, sf_dir)
