"""New-content tokens, cost and content bytes of sessions, from transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajloom.functions.pricing import price_claude, price_openai

MILLION = 1_000_000.0


def claude_session_usage(lines: DataFrame, by: list[str]) -> DataFrame:
    """lines: by, type, model, input_tokens, write_5m, write_1h, content_bytes. Only input and cache writes are new content; each line has its own model's price."""
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    priced = price_claude(lines.filter(F.col("type").isNotNull()))
    said = F.col("type") == "assistant"
    tokens = zero("input_tokens") + zero("write_5m") + zero("write_1h")
    cost = (zero("input_tokens") * F.col("input") + zero("write_5m") * F.col("cache_write_5m") + zero("write_1h") * F.col("cache_write_1h")) / MILLION
    return priced.groupBy(*by).agg(
        F.sum(F.when(said, tokens).otherwise(0)).cast("bigint").alias("tokens"),
        F.sum(F.when(said, cost).otherwise(0.0)).alias("cost_usd"),
        F.sum(F.when(F.col("type") == "user", zero("content_bytes")).otherwise(0)).cast("bigint").alias("content_bytes"),
    )


def with_model_in_force(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """model: the last one named at or before the line."""
    own = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("model", F.last(F.nullif(F.col("model"), F.lit("")), ignorenulls=True).over(own))


def fresh_input(total_input: Column, cached: Column) -> Column:
    """The second agent's input counts cached tokens in."""
    return F.greatest(F.coalesce(total_input, F.lit(0)) - F.coalesce(cached, F.lit(0)), F.lit(0))


def codex_session_usage(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """lines: by, order, is_total, model, total_input, total_cached, total_write, content_bytes. Counts are cumulative: the last total stands, at the model then in force."""
    own = with_model_in_force(lines, by, order)
    sums = own.groupBy(*by).agg(
        F.max_by(F.when(F.col("is_total"), F.struct("model", "total_input", "total_cached", "total_write")), F.when(F.col("is_total"), F.struct(*order))).alias("last"),
        F.sum(F.coalesce("content_bytes", F.lit(0))).cast("bigint").alias("content_bytes"),
    )
    flat = sums.select(*by, "content_bytes", F.col("last.model").alias("model"), fresh_input(F.col("last.total_input"), F.col("last.total_cached")).alias("fresh"), F.coalesce("last.total_write", F.lit(0)).alias("write"))
    priced = price_openai(flat)
    return priced.select(*by, (F.col("fresh") + F.col("write")).cast("bigint").alias("tokens"), ((F.col("fresh") * F.col("input") + F.col("write") * F.col("cache_write_5m")) / MILLION).alias("cost_usd"), "content_bytes")


def usage_deltas(totals: DataFrame, by: list[str], order: list[str], counters: list[str]) -> DataFrame:
    """Cumulative counters as steps, never below zero."""
    own = Window.partitionBy(*by).orderBy(*order)
    return totals.withColumns({f"{x}_delta": F.greatest(F.col(x) - F.coalesce(F.lag(x).over(own), F.lit(0)), F.lit(0)) for x in counters})
