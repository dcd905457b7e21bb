"""Raw events in, reduced trajectories out: normalise, decide, replace, archive, tally, as one job."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajloom.functions import outputs as o
from trajloom.functions import savings as s
from trajloom.functions import text as t
from trajloom.functions.strict import quoted, strict
from trajloom.operators.archive import ARCHIVED
from trajloom.operators.decide import CHANGED, decide_claude, decide_codex, with_text_measures
from trajloom.operators.rollup import mechanism_stats
from trajloom.operators.state import SESSION

SLIM = [*SESSION, "agent", "hook_event_name", "tool_name", "class", "is_shell", "eligible", "key", "tokens", "n_lines", "n_bytes", "hash", "omitted_lines", "omitted_bytes"]


class Reduced(NamedTuple):
    """decided: all events; outputs: by, action, content_id, updated_output of changed calls; archive: key, content, n_bytes; tallies: a row a session."""

    decided: DataFrame
    outputs: DataFrame
    archive: DataFrame
    tallies: DataFrame


def decided_claude(events: DataFrame, order: list[str], by: str = "event_id", **limits) -> DataFrame:
    """events: raw, with project_root and session_id. Texts are measured in the scan and left behind before any window."""
    df = with_text_measures(o.normalize_claude(events), "text", "raw_text").withColumn("eligible", F.col("is_shell") & F.col("text").isNotNull())
    keep = dict.fromkeys([by, *order, *SLIM, "raw_tokens", "raw_bytes", "raw_hash"])
    return decide_claude(df.select(*keep), order, **limits)


def decided_codex(events: DataFrame, order: list[str], by: str = "event_id", **limits) -> DataFrame:
    df = with_text_measures(o.normalize_codex(events)).withColumn("eligible", F.coalesce("can_rewrite", F.lit(False)))
    return decide_codex(df.select(*dict.fromkeys([by, *order, *SLIM])), order, **limits)


BITS, BUCKET = 1 << 27, 1 << 15


def may_be_among(df: DataFrame, some: DataFrame, by: str) -> DataFrame:
    """Rows of df whose ``by`` may be among those of some: all that are, and of the others as many as share a bit by their hash, of a table of 16 MB that goes to all tasks. Keeps large rows out of a join that drops most of them."""
    at = lambda: F.pmod(F.xxhash64(by), F.lit(BITS))
    bits = some.select(F.floor(at() / BUCKET).alias("_bucket"), (at() % BUCKET).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    of = df.withColumns({"_bucket": F.floor(at() / BUCKET), "_bit": (at() % BUCKET).cast("int")}).join(F.broadcast(bits), "_bucket")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return of.filter(F.getbit(byte, F.col("_bit") % 8) == 1).drop("_bucket", "_bit", "_bits")


def _shown(codex: bool, prefix: str) -> Column:
    """What the model sees in place of the text (column shown_text), as plain text."""
    x, where, n, a, key = F.col("shown_text"), F.col("content_id"), F.col("saved_bytes"), F.col("action"), F.col("key")
    entries = (F.col("tool_name") == "Glob") if not codex else F.lit(False)
    trim = F.when(F.col("is_shell"), t.trimmed(x, "shell", where, prefix)).when(entries, t.trimmed(x, "entries", where, prefix)).otherwise(t.trimmed(x, "text", where, prefix))
    why = F.when(a == "retire_boundary", "post-boundary").otherwise("over-threshold")
    return (
        F.when(a == "dedup", s.dedup_receipt(F.col("repeat_of_turn"), key, prefix)).when(a == "trim", trim)
        .when(a == "bash_retire", s.bash_receipt(F.regexp_replace(key, "^Bash:", ""), n, where, prefix)).otherwise(s.retire_receipt(why, F.col("tool_name"), key, n, where, prefix))
    )


def _claude_output(shown: Column) -> Column:
    """JSON in the shape of the response: shell calls keep their four fields, lists and searches their own, retired calls become a string."""
    response = F.col("tool_response")
    shell = F.to_json(F.struct(shown.alias("stdout"), F.lit("").alias("stderr"), F.lit(False).alias("interrupted"), F.lit(False).alias("isImage")))
    grep = F.to_json(strict(response, o.GREP_RESPONSE).withField("content", shown))
    glob = F.to_json(strict(response, o.GLOB_RESPONSE).withField("filenames", F.split(shown, "\n")))
    return F.when(F.col("is_shell"), shell).when((F.col("action") == "trim") & (F.col("tool_name") == "Grep"), grep).when((F.col("action") == "trim") & (F.col("tool_name") == "Glob"), glob).otherwise(quoted(shown))


def reduce_trajectories(events: DataFrame, order: list[str], by: str = "event_id", codex: bool = False, prefix: str = t.PREFIX, save=lambda df: df, **limits) -> Reduced:
    """events: raw tool_events with project_root, agent and a unique ``by``. save: writes the decisions once (they are read three times) and returns them.

    Retired looking calls of the first agent archive the raw response, all others the text that the model saw.
    """
    decide, normal = (decided_codex, o.normalize_codex) if codex else (decided_claude, o.normalize_claude)
    decided = save(decide(events, order, by, **limits))
    raw = F.lit(False) if codex else F.col("action").isin("retire_boundary", "retire_threshold")
    named = F.substring(F.when(raw, F.col("hash" if codex else "raw_hash")).otherwise(F.col("hash")), 1, 32)
    changed = decided.filter(F.col("action").isin(*CHANGED)).select(by, *SESSION, "epoch", "action", "saved_bytes", "repeat_of_turn", F.when(F.col("action") != "dedup", named).alias("content_id"))
    # Only changed calls' responses are dealt to the join, and only there are their texts taken from them.
    said = lambda some: normal(some.join(may_be_among(events.select(by, "hook_event_name", "tool_name", "tool_input", "tool_response"), some, by), by)).withColumn("shown_text", F.coalesce("text", F.lit("")))
    full = said(changed)
    shown = _shown(codex, prefix)
    updated = quoted(shown) if codex else _claude_output(shown)
    outputs = full.select(*SESSION, "epoch", by, "action", "content_id", updated.alias("updated_output"))
    content = F.when(raw, F.col("tool_response")).otherwise(F.col("shown_text"))
    once = changed.filter(F.col("action").isin(*ARCHIVED)).dropDuplicates([*SESSION, "epoch", "content_id"])
    archive = said(once).select(*SESSION, "epoch", "content_id", F.coalesce(content, F.lit("")).alias("content"))
    return Reduced(decided, outputs, archive.withColumn("n_bytes", F.octet_length("content").cast("bigint")), mechanism_stats(decided))
