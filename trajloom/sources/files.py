"""Reading hook events, transcripts, rollouts and session tallies, and writing the results."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.functions.savings import default_agent
from trajloom.functions.strict import fields_at, raw_field, strict, written_field

_NAMES = ["session_id", "cwd", "hook_event_name", "tool_name", "transcript_path", "model", "turn_id", "tool_use_id", "agent_id", "agent_type", "agent"]
EVENT = {"seq": "bigint", **dict.fromkeys(_NAMES, "string")}
_CREATED = {"ephemeral_5m_input_tokens": "bigint", "ephemeral_1h_input_tokens": "bigint"}
_USED = {"input_tokens": "bigint", "output_tokens": "bigint", "cache_read_input_tokens": "bigint", "cache_creation_input_tokens": "bigint", "cache_creation": _CREATED}
TRANSCRIPT = {"type": "string", "message": {"role": "string", "model": "string", "usage": _USED}}
_TOTAL = dict.fromkeys(["input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"], "bigint")
ROLLOUT = {"type": "string", "payload": {"type": "string", "role": "string", "model": "string", "content": "json", "output": "string", "info": {"total_token_usage": _TOTAL}}}
_STATS = {"agent": "agent", "dedupHits": "dedup_hits", "dedupBytes": "dedup_bytes", "budgetTrims": "budget_trims", "budgetLinesOmitted": "budget_lines_omitted", "budgetBytesOmitted": "budget_bytes_omitted", "retiredCalls": "retired_calls", "retiredBytes": "retired_bytes", "transcriptTokens": "transcript_tokens", "transcriptCostUsd": "transcript_cost_usd", "transcriptContentBytes": "transcript_content_bytes"}


def read_tool_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Hook events as agents send them, one JSON object a line. Inputs and responses stay raw JSON text (a bare string keeps its quotes); a line that can't be read, or in which any other field has another type, is left out whole."""
    lines = (spark.readStream if stream else spark.read).text(path)
    # Each line is parsed once: a filter by itself, or one that Spark moves down to it, would parse it again.
    nested = ("tool_input", "tool_response")
    fit = F.filter(F.array(strict(F.col("value"), {**EVENT, **dict.fromkeys(nested, "text")})), lambda x: F.coalesce(x["hook_event_name"], F.lit("")) != "")
    x = lines.select("value", F.explode(fit).alias("x")).withColumns({f"_{k}": written_field(F.col("value"), k, F.col(f"x.{k}")) for k in nested})
    raw = {k: raw_field(F.col("value"), k, F.col(f"_{k}")).alias(k) for k in nested}
    return x.select(*[F.col(f"x.{k}").alias(k) for k in ("seq", *_NAMES[:4])], *raw.values(), *[F.col(f"x.{k}").alias(k) for k in _NAMES[4:]])


@F.pandas_udf(T.LongType())
def raw_content_bytes(lines: pd.Series) -> pd.Series:
    """Bytes of message.content as it stands in the line; 0 where there is none. The only raw JSON length that built-ins cannot give."""
    def size(line: str) -> int:
        try:
            text = line.strip()
            for name, a, _ in fields_at(text, 0):
                if name == "message" and text[a] == "{":
                    return next((len(text[x:y].encode("utf-8")) for n, x, y in fields_at(text, a) if n == "content"), 0)
        except (ValueError, IndexError, AttributeError):
            pass
        return 0

    return lines.map(size)


def _named(files: DataFrame, *more: Column) -> DataFrame:
    """value and session_id: that of the directory (session_id=...) where there is one, else the file's name."""
    own = F.col("session_id").cast("string") if "session_id" in files.columns else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.jsonl)?$", 1)
    return files.select("value", own.alias("session_id"), *more)


def read_transcripts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines for claude_session_usage; the session is the directory's (session_id=...) or the file's name, bad lines are left out."""
    lines = _named(spark.read.text(path))
    return transcript_lines(lines)


def transcript_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """The same of lines (session_id, value, and columns to keep) that were read otherwise."""
    x = lines.withColumn("x", strict(F.col("value"), TRANSCRIPT)).filter(F.col("x.type").isNotNull())
    u = "x.message.usage"
    return x.select("session_id", *keep, F.col("x.type").alias("type"), F.col("x.message.model").alias("model"), F.col(f"{u}.input_tokens").alias("input_tokens"), F.col(f"{u}.cache_creation.ephemeral_5m_input_tokens").alias("write_5m"), F.col(f"{u}.cache_creation.ephemeral_1h_input_tokens").alias("write_1h"), F.when(F.col("x.type") == "user", raw_content_bytes("value")).alias("content_bytes"))


def codex_content_bytes(content: Column) -> Column:
    """Of a variant: of a string its bytes, of a list of parts the bytes of their texts, else (also where a part has another shape) 0."""
    kind = F.schema_of_variant(content)
    parts = F.when(kind.startswith("ARRAY"), F.try_variant_get(content, "$", "array<variant>"))
    field = lambda p, name: F.try_variant_get(p, f"$.{name}", "variant")
    string = lambda x: F.coalesce(F.schema_of_variant(x).isin("STRING", "VOID"), F.lit(True))
    fits = F.forall(parts, lambda p: (F.schema_of_variant(p).startswith("OBJECT") | (F.schema_of_variant(p) == "VOID")) & string(field(p, "type")) & string(field(p, "text")))
    summed = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(F.octet_length(F.try_variant_get(p, "$.text", "string")), F.lit(0)))
    own = F.when(kind == "STRING", F.octet_length(F.try_variant_get(content, "$", "string"))).when(fits, summed)
    return F.coalesce(own, F.lit(0)).cast("bigint")


def read_rollouts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines for codex_session_usage, to be ordered by (split, line_no): where the file's part begins, and the line's number there. Large files are read in parts by several tasks."""
    return rollout_lines(_named(spark.read.text(path), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line_no")), "split", "line_no")


def rollout_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """The same of lines (session_id, value, and columns to keep) that were read otherwise."""
    x = lines.withColumn("x", strict(F.col("value"), ROLLOUT)).filter(F.col("x").isNotNull())
    outer, p = F.col("x.type"), F.col("x.payload")
    total, item = p["info"]["total_token_usage"], F.coalesce(outer == "response_item", F.lit(False))
    said = item & (p["type"] == "message") & (p["role"] == "user")
    own = F.when(said, codex_content_bytes(p["content"])).when(item & (p["type"] == "function_call_output"), F.octet_length(p["output"]))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select(
        "session_id", *keep, F.coalesce((outer == "event_msg") & (p["type"] == "token_count"), F.lit(False)).alias("is_total"), p["model"].alias("model"),
        zero(total["input_tokens"]).alias("total_input"), zero(total["cached_input_tokens"]).alias("total_cached"), zero(total["cache_write_input_tokens"]).alias("total_write"), zero(own).cast("bigint").alias("content_bytes"),
    )


def read_session_stats(spark: SparkSession, path: str) -> DataFrame:
    """Every *.stats.json but the old lifetime file; a corrupt one is a row of zeros."""
    schema = T.StructType([T.StructField(k, T.StringType() if k == "agent" else T.DoubleType() if "Cost" in k else T.LongType()) for k in _STATS])
    raw = spark.read.text(path, pathGlobFilter="*.stats.json", wholetext=True).select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("mtime"))
    x = raw.filter(F.col("name") != "lifetime.stats.json").withColumn("x", F.from_json("value", schema))
    counts = [F.coalesce(F.col(f"x.{k}"), F.lit(0)).alias(v) for k, v in _STATS.items() if v != "agent"]
    return x.select(F.regexp_replace("name", r"\.stats\.json$", "").alias("session_id"), "mtime", default_agent(F.col("x.agent")).alias("agent"), *counts)


BUCKETS = 64
ARCHIVE_KEY = ["project_root", "session_id", "epoch", "content_id"]


def _bucketed(df: DataFrame) -> DataFrame:
    """A bounded number of directories, whatever the number of projects and sessions."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("project_root"), F.lit(BUCKETS)).cast("int"))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What lies at the path; None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as x:
        if x.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_session_stats(stats: DataFrame, path: str, version: int | None = None) -> None:
    """One row for each (project, session), appended as a new version (by default the time); the other rows stay."""
    version = time.time_ns() // 1000 if version is None else version
    once = stats.dropDuplicates(["project_root", "session_id"]).withColumn("version", F.lit(version).cast("bigint"))
    _bucketed(once).write.mode("append").partitionBy("bucket").parquet(path)


def latest_session_stats(spark: SparkSession, path: str) -> DataFrame:
    """The last version of every session that was written."""
    rows = _stored(spark, path)
    own = [x for x in rows.columns if x not in ("project_root", "session_id", "version", "bucket")]
    last = rows.groupBy("project_root", "session_id").agg(F.max(F.struct("version", *own)).alias("x"))
    return last.select("project_root", "session_id", *[F.col(f"x.{c}").alias(c) for c in own])


def compact_session_stats(spark: SparkSession, path: str, to: str) -> None:
    """The last versions alone, in a new folder."""
    write_session_stats(latest_session_stats(spark, path), to)


def write_archive(archived: DataFrame, path: str) -> None:
    """Appends the contents that are not stored yet; storing twice leaves one. Spread over projects, not a file for each text.

    Of what is stored only the buckets are read that the new contents fall into.
    """
    once = _bucketed(archived.dropDuplicates(ARCHIVE_KEY))
    old = _stored(archived.sparkSession, path)
    if old is None:
        once.write.mode("append").partitionBy("bucket").parquet(path)
        return
    once = once.persist()  # read twice
    new_contents(once, old).write.mode("append").partitionBy("bucket").parquet(path)
    once.unpersist()


def new_contents(once: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of once (with bucket) that old, stored by bucket, doesn't have."""
    touched = [r["bucket"] for r in once.select("bucket").distinct().collect()]  # BUCKETS at most
    known = old.filter(F.col("bucket").isin(touched)).select("bucket", *ARCHIVE_KEY)
    return once.join(known, ["bucket", *ARCHIVE_KEY], "left_anti")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Each content once, also where two writers stored it at the same time."""
    return _stored(spark, path).drop("bucket").dropDuplicates(ARCHIVE_KEY)


def read_reduced(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_reduced(reduced: DataFrame, path: str) -> None:
    """Changed calls: their identity, action, content_id and the replacement in the response's own shape (updated_output)."""
    reduced.write.mode("append").parquet(path)
