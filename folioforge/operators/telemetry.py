"""Analytics over the cost and question logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import strip

UNKNOWN = "unknown"


def known(col: str) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(F.col(col))), F.lit("")), F.lit(UNKNOWN))


def grouping_sets(log: DataFrame) -> DataFrame:
    """Total and the sums and counts by endpoint, provider and model in one pass: dimension, key, calls, cost."""
    rows = log.select(known("endpoint").alias("endpoint"), known("provider").alias("provider"), known("model").alias("model"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost"))
    g = rows.groupingSets([[], ["endpoint"], ["provider"], ["model"]], "endpoint", "provider", "model").agg(
        F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"), F.grouping_id().alias("gid")
    )
    dim = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "endpoint").when(F.col("gid") == 5, "provider").otherwise("model")
    return g.select(dim.alias("dimension"), F.coalesce("endpoint", "provider", "model", F.lit("all")).alias("key"), "calls", "cost")


def per_user(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce("user_id", F.lit("0")).alias("user_id")).agg(F.count("*").alias("calls"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost"))


def last_days(log: DataFrame, days: int) -> DataFrame:
    """Rows of the last ``days`` days up to the log's last day."""
    last = log.agg(F.max(F.to_date("ts")).alias("last"))  # one row
    return log.join(F.broadcast(last), F.to_date("ts") > F.date_sub("last", days)).drop("last")


def recent(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("line_no")).limit(max(1, min(n, 500)))


def priced(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Unit costs by the price table (a few rows): the exact model, then without the prefix ``openai/``, then the whole name
    without case, else zero."""
    p = prices.select(F.col("model").alias("m"), "rate_input_per_m", "rate_output_per_m")
    name = strip(F.col("model"))
    keys = [name, F.when(name.startswith("openai/"), F.substring(name, 8, 1000)), F.lower(name)]
    out = log.drop("rate_input_per_m", "rate_output_per_m")
    for k, key in enumerate(keys):
        side = p.select((F.lower("m") if k == 2 else F.col("m")).alias(f"m{k}"), F.struct("rate_input_per_m", "rate_output_per_m").alias(f"p{k}")).dropDuplicates([f"m{k}"])
        out = out.join(F.broadcast(side), key == F.col(f"m{k}"), "left")
    rate = F.coalesce("p0", "p1", "p2")
    i, o = F.coalesce(rate["rate_input_per_m"], F.lit(0.0)), F.coalesce(rate["rate_output_per_m"], F.lit(0.0))
    cost = F.coalesce("prompt_tokens", F.lit(0)) * i / 1e6 + F.coalesce("completion_tokens", F.lit(0)) * o / 1e6
    return out.withColumn("unit_cost", F.round(cost, 8)).drop("m0", "m1", "m2", "p0", "p1", "p2")


def scope(user: str, admin: bool, wanted: str) -> str | None:
    """Whose costs a request sees: null for everybody's. ``all`` is for administrators; ``system`` is global."""
    if wanted == "system" or wanted == "all" and admin:
        return None
    return user


def of_user(log: DataFrame, user: str | None) -> DataFrame:
    """The rows of a user; all rows without one, or for a number of zero or less."""
    if user is None or user.lstrip("-").isdigit() and int(user) <= 0:
        return log
    return log.where(F.coalesce("user_id", F.lit("0")) == user)


def clamped(days: int, most: int = 30) -> int:
    return max(1, min(days, most))


def spent(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """What the totals (``by``, cost) grew by between two readings, never less than nothing."""
    b = before.select(by, F.col("cost").alias("was"))
    return after.join(b, by, "left").select(by, F.round(F.greatest(F.lit(0.0), F.col("cost") - F.coalesce("was", F.lit(0.0))), 6).alias("spent"))


def daily_level(log: DataFrame, budget: float) -> DataFrame:
    """Cost of each day and how much of a daily budget it is."""
    days = log.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost"))
    share = F.col("cost") / budget
    return days.withColumn("level", F.when(share >= 0.9, "high").when(share >= 0.5, "warn").otherwise("ok"))


def running_by_day(log: DataFrame) -> DataFrame:
    """Calls of each day and hour with the day's running cost; hours are aggregated before the window."""
    hours = log.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("calls"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost"))
    w = Window.partitionBy("day").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return hours.select("day", "hour", "calls", F.round(F.sum("cost").over(w), 6).alias("running_cost"))


def deduplicated(log: DataFrame) -> DataFrame:
    """One row per call that was written twice under new line numbers: the first number stays."""
    cols = [c for c in log.columns if c != "line_no"]
    return log.groupBy(*cols).agg(F.min("line_no").alias("line_no")).select(*log.columns)


def p95(col: str) -> Column:
    """The value at the position floor(0.95 n) (from 1) of the sorted values; null below two values. It gathers a
    group's values, so it is for groups of a bounded size; ``p95_distributed`` is for the others."""
    return F.when(F.count(col) >= 2, F.try_element_at(F.array_sort(F.collect_list(col)), F.greatest(F.lit(1), F.floor(F.count(col) * 0.95).cast("int"))))


def p95_distributed(rows: DataFrame, by: str, col: str) -> DataFrame:
    """``p95`` per ``by`` without gathering a group: counts per distinct value, then a running count."""
    counts = rows.where(F.col(col).isNotNull()).groupBy(by, col).agg(F.count("*").alias("n"))
    up = Window.partitionBy(by).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    at = F.greatest(F.lit(1), F.floor(F.col("all") * 0.95))
    return c.where((F.col("upto") >= at) & (F.col("all") >= 2)).groupBy(by).agg(F.min(col).alias("p95"))
