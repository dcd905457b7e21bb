"""From decisions to session rows, and from those to projects and the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajloom.functions import savings as s
from trajloom.operators.decide import RETIRED
from trajloom.operators.state import SESSION, running, with_slice


def mechanism_stats(decided: DataFrame) -> DataFrame:
    """Hits, trims, retires and their bytes of every session; resets don't clear them."""
    is_ = lambda *names: F.col("action").isin(*names)
    total = lambda test, value: F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("bigint")
    return decided.groupBy(*SESSION, "agent").agg(
        total(is_("dedup"), 1).alias("dedup_hits"), total(is_("dedup"), F.col("saved_bytes")).alias("dedup_bytes"),
        total(is_("trim"), 1).alias("budget_trims"), total(is_("trim"), F.col("omitted_lines")).alias("budget_lines_omitted"), total(is_("trim"), F.col("saved_bytes")).alias("budget_bytes_omitted"),
        total(is_(*RETIRED), 1).alias("retired_calls"), total(is_(*RETIRED), F.col("saved_bytes")).alias("retired_bytes"),
    )


def session_stats(mechanisms: DataFrame, usage: DataFrame) -> DataFrame:
    """Both sides of every session, zero where one lacks it. usage: project_root, session_id, agent, tokens, cost_usd, content_bytes."""
    u = usage.select(*SESSION, F.col("agent").alias("usage_agent"), F.col("tokens").alias("transcript_tokens"), F.col("cost_usd").alias("transcript_cost_usd"), F.col("content_bytes").alias("transcript_content_bytes"))
    both = mechanisms.join(u, SESSION, "full")
    zeros = [F.coalesce(x, F.lit(0)).alias(x) for x in s.COUNTERS] + [F.coalesce(x, F.lit(0.0 if x == "transcript_cost_usd" else 0)).alias(x) for x in s.USAGE]
    return both.select(*SESSION, s.default_agent(F.coalesce("agent", "usage_agent")).alias("agent"), *zeros)


def with_saved(stats: DataFrame) -> DataFrame:
    """tokens_saved and dollars_saved of each session, zero without data: sums of these, never ratios of sums, make the levels agree."""
    return stats.withColumns({"tokens_saved": F.coalesce(s.tokens_saved(), F.lit(0.0)), "dollars_saved": F.coalesce(s.dollars_saved(), F.lit(0.0))})


def _sums() -> list:
    return [F.sum(x).alias(x) for x in (*s.COUNTERS, *s.USAGE, "tokens_saved", "dollars_saved")]


def project_rollup(stats: DataFrame) -> DataFrame:
    return with_saved(stats).groupBy("project_root").agg(F.count(F.lit(1)).alias("sessions"), *_sums())


def overview(stats: DataFrame, projects: DataFrame) -> DataFrame:
    """One row over the live projects; a project without a session counts as a project."""
    live = with_saved(stats).join(projects.select("project_root").distinct(), "project_root", "left_semi")
    sums = [F.coalesce(x, F.lit(0)).alias(name) for x, name in ((F.sum(y), y) for y in (*s.COUNTERS, *s.USAGE, "tokens_saved", "dollars_saved"))]
    row = live.agg(F.count(F.lit(1)).alias("sessions"), *sums)
    return row.crossJoin(projects.agg(F.count_distinct("project_root").alias("projects")))  # one row with one row


def savings_rollup(stats: DataFrame) -> DataFrame:
    """level 0 sessions, 1 projects, 3 the whole, in one pass."""
    cube = with_saved(stats).rollup("project_root", "session_id").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("sessions"), *_sums())
    return cube.withColumn("percent_saved", s.percent_saved())


def mechanism_breakdown(levels: DataFrame, by: list[str]) -> DataFrame:
    """Three rows of each level, most bytes first (ties: dedup, trim, retire): count, bytes, percent of all bytes, share of the largest."""
    stack = F.expr("stack(3, 0, 'dedup', dedup_hits, dedup_bytes, 1, 'trim', budget_trims, budget_bytes_omitted, 2, 'retire', retired_calls, retired_bytes) as (ord, mechanism, n, bytes)")
    long = levels.select(*by, (s.suppressed() + F.col("transcript_content_bytes")).alias("total"), stack)
    most = F.max("bytes").over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("bytes"), "ord"))
    return long.select(*by, "mechanism", "n", "bytes", s.part_percent(F.col("bytes"), F.col("total")).alias("percent"), F.when(most > 0, F.col("bytes") / most).otherwise(0.0).alias("fill"), place.alias("place"))


def newest_first(stats: DataFrame, slices: int = 64) -> DataFrame:
    """place of each session in its project, newest first. Sessions are ranked in ranges of time, whose counts are carried on: a project's sessions never meet in one task."""
    df = with_slice(stats, "mtime", slices)
    df = df.withColumn("slice", -F.col("slice"))  # the newest range comes first
    return running(df, ["project_root"], [F.desc("mtime"), "session_id"], "place", F.lit(1).cast("bigint")).drop("slice")


def latest_agent_session(stats: DataFrame) -> DataFrame:
    return stats.groupBy("agent").agg(F.max("mtime").alias("last_seen"))


def session_report(stats: DataFrame, prefix: str) -> DataFrame:
    """The receipt of every session with activity."""
    p = project_rollup(stats).select("project_root", *[F.col(x).alias(f"project_{x}") for x in ("sessions", "dedup_hits", "budget_trims", "retired_calls")])
    return stats.filter(s.has_activity()).join(p, "project_root").withColumn("receipt", s.session_receipt(prefix))


def fold_legacy(legacy: DataFrame, stats: DataFrame) -> DataFrame:
    """Old lifetime rows (source, project_root, counters), each source once, as one session of their project."""
    once = legacy.dropDuplicates(["source"]).groupBy("project_root").agg(*[F.sum(x).alias(x) for x in s.COUNTERS])
    folded = once.withColumns({"session_id": F.lit("legacy-migrated"), "agent": F.lit(s.DEFAULT_AGENT)})
    return stats.unionByName(folded, allowMissingColumns=True).fillna(0, subset=[*s.COUNTERS, *s.USAGE])
