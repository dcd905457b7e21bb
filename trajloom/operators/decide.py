"""What each call's output becomes: nudge, dedup, trim, retire_boundary, retire_threshold, bash_retire or pass.

Events have: project_root, session_id, the order columns, hook_event_name, tool_name, class, is_shell,
eligible, key, hash, and of the text: tokens, n_lines, n_bytes, omitted_lines, omitted_bytes; for the first
agent also raw_tokens and raw_bytes of the raw response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajloom.functions import classify as c
from trajloom.functions import text as t
from trajloom.operators.state import THRESHOLD_CALLS, with_state

RETIRED = ["retire_boundary", "retire_threshold", "bash_retire"]
CHANGED = [*RETIRED, "trim", "dedup"]


def with_text_measures(events: DataFrame, text: str = "text", raw: str | None = None) -> DataFrame:
    """The measures of the text (and of the raw response); drop the texts after this, before any window."""
    x = F.col(text)
    out = {"tokens": t.estimated_tokens(x), "n_lines": F.size(t.lines(x)).cast("bigint"), "n_bytes": F.octet_length(x).cast("bigint"), "hash": t.content_hash(x), "omitted_lines": t.omitted_lines(x).cast("bigint"), "omitted_bytes": t.omitted_bytes(x)}
    if raw:
        out |= {"raw_tokens": t.estimated_tokens(F.col(raw)), "raw_bytes": F.octet_length(raw).cast("bigint"), "raw_hash": t.content_hash(F.col(raw))}
    return events.withColumns(out)


def _long(column: str, limit: int) -> Column:
    return F.coalesce(F.col(column) > limit, F.lit(False))


def _trims(limit: int) -> Column:
    return _long("tokens", limit) & F.coalesce(F.col("n_lines") > t.HEAD + t.TAIL, F.lit(False))


def decide_claude(events: DataFrame, order: list[str], nudge: bool = True, max_tokens: int = t.MAX_TOKENS, threshold: int = THRESHOLD_CALLS) -> DataFrame:
    """events with state, action and saved_bytes, by the first agent's order of rules."""
    df = with_state(events, order, threshold)
    looks, past = F.col("class") == c.INVESTIGATE, F.col("past_boundary")
    shell = F.when(~F.col("eligible"), "pass").when(F.col("is_repeat"), "dedup").when(past, F.when(_long("tokens", max_tokens), "bash_retire").otherwise("pass")).when(_trims(max_tokens), "trim").otherwise("pass")
    action = (
        F.when(~c.is_tool_call(F.col("hook_event_name")), "pass").when(F.col("crossing") & F.lit(nudge), "nudge")
        .when(looks & past, F.when(_long("raw_tokens", max_tokens), "retire_boundary").otherwise("pass"))
        .when(looks & F.col("over_threshold"), "retire_threshold")
        .when(F.col("is_shell"), shell)
        .when(F.col("tool_name").isin("Grep", "Glob") & _trims(max_tokens), "trim").otherwise("pass")
    )
    return _with_saved(df.withColumn("action", action), F.when(F.col("action") == "bash_retire", F.col("n_bytes")).otherwise(F.col("raw_bytes")))


def decide_codex(events: DataFrame, order: list[str], nudge: bool = True, max_tokens: int = t.MAX_TOKENS, threshold: int = THRESHOLD_CALLS) -> DataFrame:
    """The same by the second agent's order: repeats come before everything but the crossing. eligible is can_rewrite here."""
    df = with_state(events, order, threshold)
    looks, past, long = F.col("class") == c.INVESTIGATE, F.col("past_boundary"), _long("tokens", max_tokens)
    action = (
        F.when(~c.is_tool_call(F.col("hook_event_name")), "pass").when(F.col("crossing"), F.lit("nudge") if nudge else F.lit("pass"))
        .when(~F.col("eligible"), "pass").when(F.col("is_repeat"), "dedup")
        .when(looks & past, F.when(long, "retire_boundary").otherwise("pass"))
        .when(looks & F.col("over_threshold"), "retire_threshold")
        .when(F.col("is_shell") & ~looks & past & long, "bash_retire")
        .when(_trims(max_tokens), "trim").otherwise("pass")
    )
    return _with_saved(df.withColumn("action", action), F.col("n_bytes"))


def _with_saved(df: DataFrame, retired: Column) -> DataFrame:
    a = F.col("action")
    return df.withColumn("saved_bytes", F.when(a == "dedup", F.col("n_bytes")).when(a == "trim", F.col("omitted_bytes")).when(a.isin(*RETIRED), retired).otherwise(0).cast("bigint"))


def compaction_points(decided: DataFrame) -> DataFrame:
    """The crossing call of each epoch that has one."""
    return decided.filter("crossing")
