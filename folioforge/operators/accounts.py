"""Users, settings and sessions as keyed tables: each change gives the rows of the next version of a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import blank_to_null, strip
from folioforge.operators.store import live_sessions

PRESET, PRESETS = "hybrid", ("air_gapped", "hybrid", "cloud_premium")
#: What a preset stands for: recognition and language model.
PRESET_ROWS = (("air_gapped", "local", "local"), ("hybrid", "local", "api"), ("cloud_premium", "api", "api"))


def same_name(a: Column, b: Column) -> Column:
    """Equality without the case of ASCII letters only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(a, upper, lower) == F.translate(b, upper, lower)


def inserted(users: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The users that may be added of ``new`` (username, email), numbered on from the largest id, and their settings: blank
    names and names that exist are refused, of equal new names the first by email is taken. Few rows are added at a time."""
    name = strip(F.col("username"))
    fresh = new.select(name.alias("username"), blank_to_null(strip(F.col("email"))).alias("email")).where("username <> ''").groupBy("username").agg(F.min("email").alias("email"))
    fresh = fresh.join(users.select("username").distinct(), "username", "left_anti")
    top = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    added = fresh.withColumn("k", F.row_number().over(Window.orderBy("username"))).join(F.broadcast(top)).select((F.col("top") + F.col("k")).alias("id"), "username", "email")
    return added, added.select(F.col("id").alias("user_id"), F.lit(PRESET).alias("default_preset"))


def updated(rows: DataFrame, changes: DataFrame, key: str, *columns: str) -> DataFrame:
    """``rows`` with ``columns`` taken from ``changes`` where they have a row of the key; a change to null is a change."""
    c = changes.select(key, F.struct(*columns).alias("__new"))
    out = rows.join(c, key, "left")
    return out.withColumns({x: F.when(F.col("__new").isNotNull(), F.col(f"__new.{x}")).otherwise(F.col(x)) for x in columns}).drop("__new")


def settings(users: DataFrame, rows: DataFrame) -> DataFrame:
    """Every user's settings, defaults for those without a row."""
    return users.select(F.col("id").alias("user_id")).join(rows, "user_id", "left").withColumn("default_preset", F.coalesce("default_preset", F.lit(PRESET)))


def opened(user_ids: DataFrame, now: Column, hours: int = 24 * 7) -> DataFrame:
    """A session for each of ``user_ids`` (token, user_id)."""
    return user_ids.select("token", "user_id", F.timestamp_add("HOUR", F.lit(hours), now).alias("expires_at"), F.lit(None).cast("timestamp").alias("revoked_at"))


def revoked(sessions: DataFrame, which: Column, now: Column) -> DataFrame:
    """``sessions`` with those that ``which`` picks revoked now, unless they are already; ``changed`` marks them."""
    hit = which & F.col("revoked_at").isNull()
    return sessions.withColumn("changed", hit).withColumn("revoked_at", F.when(hit, now).otherwise(F.col("revoked_at")))


def purged(sessions: DataFrame, now: Column, hours: int = 24 * 30) -> DataFrame:
    """Without sessions that expired more than ``hours`` ago."""
    return sessions.where(F.col("expires_at") >= F.timestamp_add("HOUR", F.lit(-hours), now))


def signed_in(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """token and user of live sessions of users who are not disabled."""
    return live_sessions(sessions, now).select("token", "user_id", "expires_at").join(users.where("disabled_at is null").select(F.col("id").alias("user_id"), "username"), "user_id")
