"""Queries over users, settings and sessions, over costs by scope, and over golden questions.

The customers stand in for users and the orders for sessions: the test tables have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import models as L
from folioforge.functions import text as X
from folioforge.operators import accounts as A
from folioforge.operators import evaluation as E
from folioforge.operators import telemetry as M
from folioforge.plans.registry import query, sql_strip
from folioforge.session import table

_USERS = "(SELECT c_custkey AS id, c_name AS username, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower(c_name) || '@mail.test' END AS email, CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '1997-01-01' END AS disabled_at, c_acctbal AS created_at FROM customer)"
_SESSIONS = "(SELECT o_orderkey AS token, o_custkey AS user_id, o_orderdate AS expires_at, CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '1997-01-01' END AS revoked_at FROM orders)"
_SETTINGS = "(SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'air_gapped' ELSE 'cloud_premium' END AS default_preset FROM customer WHERE c_custkey % 2 = 0)"


def users(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), F.col("c_name").alias("username"), F.when(k % 3 == 0, None).otherwise(F.concat(F.lower("c_name"), F.lit("@mail.test"))).alias("email"),
        F.when(k % 7 == 0, F.expr("timestamp_ntz '1997-01-01'")).alias("disabled_at"), F.col("c_acctbal").alias("created_at"),
    )


def sessions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("expires_at"), F.when(F.col("o_orderstatus") == "P", F.expr("timestamp_ntz '1997-01-01'")).alias("revoked_at"))


def settings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 4 == 0, "air_gapped").otherwise("cloud_premium").alias("default_preset"))


def _now():
    return F.expr("timestamp_ntz '1998-06-01 00:00:00'")



@query(f"SELECT u.id, count(*) OVER () AS kept, CAST(NULL AS VARCHAR) AS preset FROM {_USERS} u WHERE FALSE UNION ALL SELECT m + row_number() OVER (ORDER BY username), count(*) OVER (), 'hybrid' FROM (SELECT DISTINCT username FROM (SELECT {sql_strip('username')} AS username FROM (SELECT c_name || CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN ' ' ELSE '-new' END AS username FROM customer WHERE c_custkey % 10 < 4)) WHERE username <> '' AND username NOT IN (SELECT username FROM {_USERS})), (SELECT max(id) AS m FROM {_USERS})")
def users_insert(spark, d):
    """New users whose names are not taken, with their default settings."""
    k = F.col("c_custkey")
    new = table(spark, d, "customer").where(k % 10 < 4).select(F.concat("c_name", F.when(k % 5 == 0, "").when(k % 5 == 1, " ").otherwise("-new")).alias("username"), F.lit(" ").alias("email"))
    added, rows = A.inserted(users(spark, d), new)
    n = added.agg(F.count("*").alias("kept"))
    return added.join(rows, added["id"] == rows["user_id"]).join(F.broadcast(n)).select("id", "kept", F.col("default_preset").alias("preset"))


@query(f"SELECT id, username, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN TIMESTAMP '1998-06-01' ELSE disabled_at END AS disabled_at FROM {_USERS}")
def users_update(spark, d):
    """Some users enabled, some disabled, the others as they were."""
    u = users(spark, d)
    changes = u.where("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 1, _now()).alias("disabled_at"))
    return A.updated(u, changes, "id", "disabled_at").select("id", "username", "disabled_at")


@query(f"SELECT id AS user_id, coalesce(default_preset, 'hybrid') AS default_preset FROM {_USERS} LEFT JOIN {_SETTINGS} ON user_id = id")
def user_settings(spark, d):
    return A.settings(users(spark, d), settings(spark, d))


@query(f"SELECT token, CASE WHEN user_id % 11 = 0 AND revoked_at IS NULL THEN TIMESTAMP '1998-06-01' ELSE revoked_at END AS revoked_at, user_id % 11 = 0 AND revoked_at IS NULL AS changed FROM {_SESSIONS} WHERE expires_at >= TIMESTAMP '1998-06-01' - INTERVAL 17520 HOUR")
def sessions_revoked(spark, d):
    """All sessions of some users revoked, then those purged that expired more than two years ago."""
    s = A.revoked(sessions(spark, d), F.col("user_id") % 11 == 0, _now())
    return A.purged(s, _now(), 2 * 365 * 24).select("token", "revoked_at", "changed")


@query(f"SELECT id AS user_id, TIMESTAMP '1998-06-01' + INTERVAL 168 HOUR AS expires_at FROM {_USERS} WHERE id % 9 = 0")
def sessions_opened(spark, d):
    ids = users(spark, d).where("id % 9 = 0").select(F.uuid().alias("token"), F.col("id").alias("user_id"))
    return A.opened(ids, _now()).select("user_id", "expires_at")


@query(f"SELECT token, user_id, username FROM {_SESSIONS} s JOIN {_USERS} u ON u.id = s.user_id WHERE revoked_at IS NULL AND expires_at >= TIMESTAMP '1998-06-01' AND disabled_at IS NULL")
def sessions_users(spark, d):
    """Live sessions and their users who are not disabled."""
    return A.signed_in(sessions(spark, d), users(spark, d), _now()).select("token", "user_id", "username")


@query(f"SELECT id, username, email, CAST(row_number() OVER (ORDER BY created_at, id) AS INT) AS place FROM {_USERS} QUALIFY place <= 100")
def users_by_date(spark, d):
    """The first users by the time they were created."""
    first = users(spark, d).orderBy("created_at", "id").limit(100)
    return first.withColumn("place", F.row_number().over(M.Window.orderBy("created_at", "id"))).select("id", "username", "email", "place")


@query(f"SELECT u.id, q.asked FROM {_USERS} u JOIN (SELECT upper(c_name) AS asked FROM customer WHERE c_custkey % 50 = 0) q ON lower(u.username) = lower(q.asked)")
def users_by_name(spark, d):
    """Users looked up without case."""
    asked = table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.upper("c_name").alias("asked"))
    return users(spark, d).join(asked, A.same_name(F.col("username"), F.col("asked"))).select("id", "asked")


@query(f"SELECT token FROM {_SESSIONS} WHERE user_id IN (SELECT id FROM {_USERS} WHERE disabled_at IS NULL)")
def sessions_cascade(spark, d):
    """Sessions left when some users are deleted."""
    kept = users(spark, d).where("disabled_at is null").select(F.col("id").alias("user_id"))
    return sessions(spark, d).join(kept, "user_id", "left_semi").select("token")


# --- costs ------------------------------------------------------------------------------------------------------------
@query("SELECT u.user_id, coalesce(calls, 0) AS calls, coalesce(cost, 0) AS cost FROM (SELECT DISTINCT user_id FROM cost_log WHERE user_id IS NOT NULL UNION SELECT 'never_seen') u LEFT JOIN (SELECT coalesce(user_id, '0') AS user_id, count(*) AS calls, round(sum(coalesce(cost_usd, 0)), 6) AS cost FROM cost_log GROUP BY 1) t USING (user_id)")
def user_costs(spark, d):
    """Every user with calls and costs, none being zero."""
    log = table(spark, d, "cost_log")
    known = log.where("user_id is not null").select("user_id").distinct().unionByName(spark.createDataFrame([("never_seen",)], "user_id string"))
    return known.join(M.per_user(log), "user_id", "left").select("user_id", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


@query("SELECT scope, count(*) AS calls, round(sum(coalesce(cost_usd, 0)), 6) AS cost FROM (SELECT 'own' AS scope, * FROM cost_log WHERE coalesce(user_id, '0') = (SELECT min(user_id) FROM cost_log) UNION ALL SELECT 'all', * FROM cost_log) GROUP BY scope")
def cost_scopes(spark, d):
    """What a user and what an administrator see of the costs."""
    log = table(spark, d, "cost_log")
    me = log.agg(F.min("user_id")).first()[0]
    totals = lambda wanted, admin, name: M.of_user(log, M.scope(me, admin, wanted)).agg(F.lit(name).alias("scope"), F.count("*").alias("calls"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost"))
    return totals("all", False, "own").unionByName(totals("all", True, "all"))


_BY_USER = "(SELECT coalesce(user_id, '0') AS user_id, round(sum(coalesce(cost_usd, 0)), 6) AS cost FROM cost_log WHERE {w} GROUP BY 1)"


@query(f"SELECT a.user_id, round(greatest(0, a.cost - coalesce(b.cost, 0)), 6) AS spent FROM {_BY_USER.format(w='TRUE')} a LEFT JOIN {_BY_USER.format(w='line_no % 2 = 0')} b USING (user_id)")
def cost_spent(spark, d):
    """What each user spent between two readings of the log."""
    log = table(spark, d, "cost_log")
    return M.spent(M.per_user(log.where("line_no % 2 = 0")), M.per_user(log), "user_id")


@query("SELECT key, cost, CAST(row_number() OVER (ORDER BY cost DESC, key) AS INT) AS place FROM (SELECT coalesce(nullif(lower(trim(model)), ''), 'unknown') AS key, round(sum(coalesce(cost_usd, 0)), 6) AS cost FROM cost_log GROUP BY 1)")
def cost_breakdown(spark, d):
    """Models by what they cost, dearest first; as many rows as models."""
    rows = M.grouping_sets(table(spark, d, "cost_log")).where("dimension = 'model'").select("key", "cost")
    return rows.withColumn("place", F.row_number().over(M.Window.orderBy(F.desc("cost"), "key")))


@query(f"SELECT line_no, replace(replace(replace(replace(replace(CASE WHEN length(t) > 20 THEN left(t, 20) || '…' ELSE t END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS shown FROM (SELECT line_no, {sql_strip('regexp_replace(endpoint || chr(10) || coalesce(ctx, ' + chr(39) + '<none>' + chr(39) + '), ' + chr(39) + '[' + chr(92) + 's' + chr(92) + 'x0b' + chr(92) + 'p{Z}]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS t FROM cost_log)")
def log_display(spark, d):
    """Log lines as they are shown: squeezed, cut, escaped."""
    line = F.concat("endpoint", F.lit("\n"), F.coalesce("ctx", F.lit("<none>")))
    return table(spark, d, "cost_log").select("line_no", X.log_text(line, 20).alias("shown"))


# --- golden questions -----------------------------------------------------------------------------------------------
_GOLDEN = "(SELECT query AS question, min(doc_ids[1]) AS doc, lower(min(string_split(query, ' ')[-1])) AS word FROM qa_log WHERE query IS NOT NULL GROUP BY query)"
_ANSWERS = "(SELECT query, arg_max(answer, (ts, coalesce(answer, ''))) AS answer, arg_max(doc_ids, (ts, coalesce(answer, ''))) AS docs FROM qa_log WHERE query IS NOT NULL GROUP BY query)"


@query(f"SELECT question, CASE WHEN contains(lower(coalesce(answer, '')), word) THEN 1.0 ELSE 0.0 END AS recall, CASE WHEN list_contains(docs, doc) THEN 1.0 ELSE 0.0 END AS match FROM {_GOLDEN} JOIN {_ANSWERS} ON query = question")
def golden_scores(spark, d):
    """Golden questions joined with their latest answers and scored."""
    return _scores(spark, d).select("question", "recall", "match")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "qa_log").where("query is not null")
    golden = qa.groupBy(F.col("query").alias("question")).agg(F.min(F.try_element_at("doc_ids", F.lit(1))).alias("doc"), F.lower(F.min(F.element_at(F.split("query", " "), -1))).alias("word"))
    answers = qa.groupBy(F.col("query").alias("question")).agg(F.max(F.struct("ts", F.coalesce("answer", F.lit("")).alias("a"), "answer", "doc_ids")).alias("x"))
    both = golden.join(answers, "question")
    return both.select("question", E.keyword_recall(F.col("x.answer"), F.array("word")).alias("recall"), E.doc_match(F.col("x.doc_ids"), F.array("doc")).alias("match"))


@query(f"WITH s AS (SELECT length(question) AS len, CASE WHEN contains(lower(coalesce(answer, '')), word) THEN 1.0 ELSE 0.0 END AS recall, CASE WHEN list_contains(docs, doc) THEN 1.0 ELSE 0.0 END AS match FROM {_GOLDEN} JOIN {_ANSWERS} ON query = question) SELECT count(*) AS n, round(avg(recall), 3) AS keyword_recall, round(avg(match), 3) AS doc_match, round(avg(CASE WHEN len % 2 = 0 THEN recall END), 3) AS judge, round(avg(len / 10.0), 2) AS latency_avg, round(list_sort(list(len / 10.0))[greatest(1, CAST(floor(count(*) * 0.95) AS INT))], 2) AS latency_p95, CASE WHEN avg(recall) >= 0.8 THEN 'excellent' WHEN avg(recall) >= 0.7 THEN 'good' WHEN avg(recall) >= 0.5 THEN 'fair' ELSE 'poor' END AS grade FROM s")
def golden_report(spark, d):
    """Means over all questions; of the judge over the judged ones (every second one), of the latency over the timed ones.
    Judge and latency stand in: no model answers here."""
    n = F.length("question")
    rows = _scores(spark, d).withColumn("judge", F.when(n % 2 == 0, F.col("recall"))).withColumn("latency", n / 10.0)
    return E.summary(rows)


@query("SELECT mode, engine, ocr, llm FROM (VALUES ('auto', 'local', 'local', 'local'), ('api', 'api', 'local', 'api'), ('local', 'local', 'api', 'api')) v(mode, engine, ocr, llm)")
def model_routes(spark, d):
    """Which engine serves a mode, and what the presets stand for, in order."""
    modes = spark.createDataFrame([("auto", "air_gapped"), ("api", "hybrid"), ("local", "cloud_premium")], "mode string, preset string")
    presets = spark.createDataFrame(list(A.PRESET_ROWS), "preset string, ocr string, llm string")
    return modes.join(F.broadcast(presets), "preset").select("mode", L.route(F.col("mode"), F.lit(True)).alias("engine"), "ocr", "llm")
