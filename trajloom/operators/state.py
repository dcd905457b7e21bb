"""Per-session state as windows: epochs, phases and the repeat ledger.

All windows lead with (project_root, session_id), so one exchange on these serves them all; only slim columns
should reach it (hashes and counts of texts, not texts). Where a session may hold a large share of all events,
``with_state_in_slices`` gives the same columns without ever bringing a session to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajloom.functions import classify as c

SESSION = ["project_root", "session_id"]
THRESHOLD_CALLS = 20


def with_epoch(events: DataFrame, order: list[str]) -> DataFrame:
    """epoch: how many resets the session has had, the current row's included."""
    own = Window.partitionBy(*SESSION).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("epoch", F.sum(c.is_reset(F.col("hook_event_name")).cast("bigint")).over(own))


def with_phase(events: DataFrame, order: list[str], threshold: int = THRESHOLD_CALLS) -> DataFrame:
    """investigate_count, crossing (the first implementing call after an investigating one), past_boundary, over_threshold. Needs epoch and class."""
    sofar = Window.partitionBy(*SESSION, "epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tool = c.is_tool_call(F.col("hook_event_name"))
    looks = (tool & (F.col("class") == c.INVESTIGATE)) | c.is_subagent(F.col("hook_event_name"))
    df = events.withColumn("investigate_count", F.sum(F.coalesce(looks, F.lit(False)).cast("bigint")).over(sofar))
    df = df.withColumn("_works", F.coalesce(tool & (F.col("class") == c.IMPLEMENT) & (F.col("investigate_count") > 0), F.lit(False)))
    return df.withColumns({
        "crossing": F.col("_works") & (F.sum(F.col("_works").cast("bigint")).over(sofar) == 1),
        "past_boundary": F.max("_works").over(sofar),
        "over_threshold": F.col("investigate_count") > threshold,
    }).drop("_works")


def with_repeats(events: DataFrame, order: list[str]) -> DataFrame:
    """is_repeat, turn, repeat_of_turn. Needs epoch, eligible, key, hash; rows that aren't eligible are unseen by the ledger.

    A repeat equals the key's last output: after A, B the third call with A is none.
    """
    by_key = Window.partitionBy(*SESSION, "epoch", "eligible", "key").orderBy(*order)
    sofar = Window.partitionBy(*SESSION, "epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = events.withColumn("is_repeat", F.coalesce(F.col("eligible") & (F.col("hash") == F.lag("hash").over(by_key)), F.lit(False)))
    df = df.withColumn("turn", F.sum((F.col("eligible") & ~F.col("is_repeat")).cast("bigint")).over(sofar))
    recorded = F.last(F.when(~F.col("is_repeat"), F.col("turn")), ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("repeat_of_turn", F.when(F.col("is_repeat"), recorded))


def with_state(events: DataFrame, order: list[str], threshold: int = THRESHOLD_CALLS) -> DataFrame:
    return with_repeats(with_phase(with_epoch(events, order), order, threshold), order)


def with_slice(events: DataFrame, by: str, slices: int) -> DataFrame:
    """slice: the range of the column (a number or timestamp) that a row falls into, each holding about as many rows; equal values share one; nulls count as the least."""
    x = F.unix_micros(by) if dict(events.dtypes)[by].startswith("timestamp") else F.col(by)
    bounds = events.agg(F.percentile_approx(x, [k / slices for k in range(1, slices)], 10_000)).first()[0] or []  # a fixed number
    return events.withColumn("slice", reduce(lambda a, b: a + b, [F.coalesce(x > b, F.lit(False)).cast("int") for b in sorted(set(bounds))], F.lit(0)))


def _with_earlier(df: DataFrame, by: list[str], parts: DataFrame, carried: list[Column]) -> DataFrame:
    """df with what the slices before a row's own come to. parts: by, slice and a slice's own values; carried: of these, over ``before``."""
    found = parts.select(*[F.col(x).alias(f"_{x}") for x in (*by, "slice")], *carried)
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in (*by, "slice")])
    return df.join(found, same, "left").drop(*[f"_{x}" for x in (*by, "slice")])


def running(df: DataFrame, by: list[str], order: list, name: str, value: Column, total=F.sum) -> DataFrame:
    """name: the running sum (or max) of the value in each group: a slice's own, and all earlier slices' carried in."""
    df = df.withColumn("_v", value)
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*by, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = df.groupBy(*by, "slice").agg(total("_v").alias("_p"))
    df = _with_earlier(df.withColumn("_own", total("_v").over(own)), by, parts, [total("_p").over(before).alias("_c")])
    joined = F.greatest("_own", "_c") if total is F.max else F.coalesce("_own", F.lit(0)) + F.coalesce("_c", F.lit(0))
    return df.withColumn(name, joined).drop("_v", "_own", "_c")


def with_state_in_slices(events: DataFrame, order: list[str], save, threshold: int = THRESHOLD_CALLS, slices: int = 64) -> DataFrame:
    """The columns of ``with_state`` for logs in which a session may hold a third of all events: a slice of a session is a task's share, and slices' sums are carried on.

    save: writes a table and returns it read back. Each step reads the one before twice, so each is written once.
    """
    of = lambda x: F.coalesce(x, F.lit(False))
    tool = c.is_tool_call(F.col("hook_event_name"))
    looks = of((tool & (F.col("class") == c.INVESTIGATE)) | c.is_subagent(F.col("hook_event_name")))
    epoch, key = [*SESSION, "epoch"], [*SESSION, "epoch", "eligible", "key"]
    df = save(with_slice(events, order[0], slices))
    df = save(running(df, SESSION, order, "epoch", c.is_reset(F.col("hook_event_name")).cast("bigint")))
    df = running(df, epoch, order, "investigate_count", looks.cast("bigint"))
    df = save(df.withColumn("_works", of(tool & (F.col("class") == c.IMPLEMENT) & (F.col("investigate_count") > 0))))
    df = running(df, epoch, order, "_n", F.col("_works").cast("bigint"))
    df = save(df.withColumns({"crossing": F.col("_works") & (F.col("_n") == 1), "past_boundary": F.col("_n") > 0, "over_threshold": F.col("investigate_count") > threshold}).drop("_works", "_n"))
    # The hash before a row: in its slice, else the last one of the slices before. Rows that aren't eligible have none.
    some = df.filter("eligible").groupBy(*key, "slice").agg(F.max_by(F.coalesce("hash", F.lit("")), F.struct(*order)).alias("_h"))
    df = df.withColumn("_own", F.lag(F.coalesce("hash", F.lit(""))).over(Window.partitionBy(*key, "slice").orderBy(*order)))
    df = _with_earlier(df, key, some, [F.lag("_h").over(Window.partitionBy(*key).orderBy("slice")).alias("_c")])
    df = save(df.withColumn("is_repeat", of(F.col("eligible") & (F.col("hash") == F.coalesce("_own", "_c")))).drop("_own", "_c"))
    df = save(running(df, epoch, order, "turn", of(F.col("eligible") & ~F.col("is_repeat")).cast("bigint")))
    # Turns only rise, so the last recorded one is the largest.
    df = running(df, key, order, "_recorded", F.when(~F.col("is_repeat"), F.col("turn")), F.max)
    return df.withColumn("repeat_of_turn", F.when(F.col("is_repeat"), F.col("_recorded"))).drop("_recorded", "slice")
