"""Reduced trajectories: the archive of removed texts, what replaces them, and how to get them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajloom.functions import savings as s
from trajloom.functions import text as t
from trajloom.operators.decide import RETIRED
from trajloom.operators.state import SESSION

ARCHIVED = [*RETIRED, "trim"]
KEY = [*SESSION, "epoch", "content_id"]


def archive(decided: DataFrame, texts: DataFrame, by: str = "event_id") -> DataFrame:
    """One row for each (project, session, epoch, content): content_id, content, n_bytes. texts: by, text (none: empty).

    Only changed rows meet their texts, and each content of an epoch once: hash names it before the text is there.
    """
    changed = decided.filter(F.col("action").isin(*ARCHIVED)).select(*SESSION, "epoch", F.substring("hash", 1, 32).alias("content_id"), by).dropDuplicates(KEY)
    full = changed.join(texts.select(by, "text"), by, "left").withColumn("content", F.coalesce("text", F.lit("")))
    return full.select(*KEY, "content", F.octet_length("content").cast("bigint").alias("n_bytes"))


def live_archive(archived: DataFrame, decided: DataFrame) -> DataFrame:
    """A reset drops a session's archive: what is left is of its last epoch."""
    last = decided.groupBy(*SESSION).agg(F.max("epoch").alias("epoch"))
    return archived.join(last, [*SESSION, "epoch"], "left_semi")


def reduced(decided: DataFrame, texts: DataFrame, by: str = "event_id", prefix: str = t.PREFIX) -> DataFrame:
    """by, action, reduced: what the model sees in place of the text, for changed calls only."""
    x, where, n = F.col("text"), F.substring("hash", 1, 32), F.col("saved_bytes")
    slim = decided.filter(F.col("action").isin(*ARCHIVED, "dedup")).select(*decided.columns)
    # Only a trim shows some of the text.
    trims = slim.filter(F.col("action") == "trim").join(texts.select(by, "text"), by, "left").withColumn("text", F.coalesce("text", F.lit("")))
    some = slim.filter(F.col("action") != "trim").withColumn("text", F.lit("")).unionByName(trims)
    kind = F.when(F.col("is_shell"), t.trimmed(x, "shell", where, prefix)).when(F.col("tool_name").isin("Glob"), t.trimmed(x, "entries", where, prefix)).otherwise(t.trimmed(x, "text", where, prefix))
    shown = (
        F.when(F.col("action") == "dedup", s.dedup_receipt(F.col("repeat_of_turn"), F.col("key"), prefix)).when(F.col("action") == "trim", kind)
        .when(F.col("action") == "bash_retire", s.bash_receipt(F.col("key"), n, where, prefix))
        .otherwise(s.retire_receipt(F.when(F.col("action") == "retire_boundary", "post-boundary").otherwise("over-threshold"), F.col("tool_name"), F.col("key"), n, where, prefix))
    )
    named = [x for x in ("event_id", by) if x in decided.columns]
    return some.select(*SESSION, "epoch", *dict.fromkeys(named), "action", F.when(F.col("action") != "dedup", where).alias("content_id"), shown.alias("reduced"))


def recover(receipts: DataFrame, archived: DataFrame) -> DataFrame:
    """receipts with the archived original."""
    return receipts.filter(F.col("content_id").isNotNull()).join(archived, KEY)
