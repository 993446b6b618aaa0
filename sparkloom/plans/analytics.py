"""Management reports over events, orders and conversations. Every moment is a parameter; nothing reads a clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkloom.sources.tables import table

AS_OF = "2024-01-15 00:00:00"
#: Credits by kind of event: views spend simple credits, clicks draft credits, purchases add.
SPENDS = {"view": "simple", "click": "draft"}


def moment(text: str):
    return F.expr(f"timestamp_ntz'{text}'")


def day_before(text: str):
    return F.expr(f"timestamp_ntz'{text}' - INTERVAL 1 DAY")


def last_day(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    return events.where((F.col("ts") >= day_before(as_of)) & (F.col("ts") < moment(as_of)))


def credit_logs(events: DataFrame) -> DataFrame:
    """log_id, user_id, amount, credit_type, created_at."""
    kind = F.when(F.col("event_type") == "view", "simple").when(F.col("event_type") == "click", "draft").otherwise("purchase")
    amount = F.when(F.col("event_type") == "purchase", F.floor("value").cast("long")).otherwise(F.lit(-1).cast("long"))
    rows = events.where(F.col("event_type").isin("view", "click", "purchase"))
    return rows.select(F.col("event_id").alias("log_id"), "user_id", amount.alias("amount"), kind.alias("credit_type"), F.col("ts").alias("created_at"))


def mis_daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a day's scalars in one pass over events instead of a query each."""
    rows = last_day(table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value"))
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    return rows.agg(
        count("signup").alias("signups"), count("purchase").alias("purchases"), count("error").alias("errors"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.floor("value"))), F.lit(0)).cast("long").alias("credits_bought"),
        F.countDistinct("user_id").alias("active_users"),
    )


def credit_spend_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = credit_logs(last_day(table(spark, sf_dir, "events"))).where("amount < 0")
    return rows.groupBy("credit_type").agg(F.abs(F.sum("amount")).alias("spent"))


def credit_spend_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = credit_logs(table(spark, sf_dir, "events")).where("amount < 0")
    wide = rows.groupBy("user_id").pivot("credit_type", ["simple", "draft"]).agg(F.abs(F.sum("amount")))
    return wide.select("user_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("simple", "draft")])


def userwise_usage_today_yesterday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both days in one conditional aggregate, left-joined to all users; top 100, user as the last word on ties."""
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    users = events.select("user_id").distinct()
    today = (F.col("ts") >= day_before(AS_OF)) & (F.col("ts") < moment(AS_OF))
    before = (F.col("ts") >= F.expr(f"timestamp_ntz'{AS_OF}' - INTERVAL 2 DAY")) & (F.col("ts") < day_before(AS_OF))
    used = events.where(today | before).groupBy("user_id").agg(F.count_if(today).alias("today"), F.count_if(before).alias("yesterday"))
    rows = users.join(used, "user_id", "left").select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("today", "yesterday")])
    return rows.orderBy(F.desc("today"), F.desc("yesterday"), "user_id").limit(100)


def revenue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("paise"), "o_custkey")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("payments"), F.coalesce(F.sum("paise"), F.lit(0)).alias("paise"), F.countDistinct("o_custkey").alias("payers"))


def revenue_of_user(spark: SparkSession, sf_dir: str, user: int | None = 7, since: str | None = "1995-01-01 00:00:00", until: str | None = None) -> DataFrame:
    """Filters apply only where they are given; half-open in time."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    if user is not None:
        rows = rows.where(F.col("o_custkey") == user)
    if since:
        rows = rows.where(F.col("o_orderdate") >= moment(since))
    if until:
        rows = rows.where(F.col("o_orderdate") < moment(until))
    return rows.agg(F.count("*").alias("payments"), F.coalesce(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")), F.lit(0)).alias("paise"))


def feedback_join_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feedback with its order (session) and customer (user), newest first; the comment is cut at 40."""
    rating = F.when(F.col("event_type") == "error", -1).otherwise(1 + F.floor("value") % 5)
    feedback = table(spark, sf_dir, "events").select("event_id", "ts", rating.cast("long").alias("rating"), "props", F.col("event_id").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = feedback.join(orders, "o_orderkey").join(people, "o_custkey").join(nations, "c_nationkey")
    preview = F.when(F.length("props") > 40, F.concat(F.substring("props", 1, 40), F.lit("..."))).otherwise(F.col("props"))
    return joined.select("event_id", "ts", "rating", "c_name", "n_name", "o_orderpriority", preview.alias("preview")).orderBy(F.desc("ts"), F.desc("event_id"))


def feedback_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.when(F.col("event_type") == "error", -1).otherwise(1 + F.floor("value") % 5)
    rows = last_day(table(spark, sf_dir, "events")).select(rating.alias("rating"))
    return rows.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("rating"), F.lit(0.0)), 1).alias("mean"), F.count_if(F.col("rating") < 0).alias("negative"))


def credit_history_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit_logs(table(spark, sf_dir, "events")).orderBy(F.desc("created_at"), F.desc("log_id")).limit(100)


def active_users_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.date_trunc("DAY", F.col("ts").cast("timestamp")).cast("date").alias("day"), "user_id")
    return rows.groupBy("day").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


def package_sales_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages: what was sold of each size, with packages never sold."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("sales"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return parts.join(sold, parts["p_partkey"] == sold["l_partkey"], "left").select("p_partkey", "p_name", "p_size", F.coalesce("sales", F.lit(0)).alias("sales"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


def name_lookup_ignoring_case(spark: SparkSession, sf_dir: str, wanted: str = "customer#000000007") -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.lower("c_name") == wanted.lower()).select("c_custkey", "c_name")


QUERIES = {f.__name__: f for f in (
    mis_daily_metrics, credit_spend_by_type, credit_spend_pivot, userwise_usage_today_yesterday, revenue_summary, revenue_of_user,
    feedback_join_report, feedback_rating, credit_history_top100, active_users_by_day, package_sales_left_join, name_lookup_ignoring_case,
)}

_DAY = f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND ts < TIMESTAMP '{AS_OF}'"
_LOGS = """(SELECT event_id AS log_id, user_id, CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) ELSE -1 END AS amount,
 CASE event_type WHEN 'view' THEN 'simple' WHEN 'click' THEN 'draft' ELSE 'purchase' END AS credit_type, ts AS created_at
 FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""
_RATING = "CASE WHEN event_type = 'error' THEN -1 ELSE 1 + CAST(floor(value) AS BIGINT) % 5 END"

ORACLES = {
    "mis_daily_metrics": f"""SELECT count(*) FILTER (WHERE event_type = 'signup') AS signups, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
 count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type = 'purchase'), 0) AS BIGINT) AS credits_bought,
 count(DISTINCT user_id) AS active_users FROM events WHERE {_DAY}""",
    "credit_spend_by_type": f"SELECT credit_type, CAST(abs(sum(amount)) AS BIGINT) AS spent FROM {_LOGS} WHERE amount < 0 AND {_DAY.replace('ts', 'created_at')} GROUP BY credit_type",
    "credit_spend_pivot": f"""SELECT user_id, CAST(coalesce(abs(sum(amount) FILTER (WHERE credit_type = 'simple')), 0) AS BIGINT) AS simple,
 CAST(coalesce(abs(sum(amount) FILTER (WHERE credit_type = 'draft')), 0) AS BIGINT) AS draft FROM {_LOGS} WHERE amount < 0 GROUP BY user_id""",
    "userwise_usage_today_yesterday": f"""WITH t AS (SELECT user_id, count(*) AS c FROM events WHERE {_DAY} GROUP BY 1),
y AS (SELECT user_id, count(*) AS c FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY GROUP BY 1)
SELECT u.user_id, coalesce(t.c, 0) AS today, coalesce(y.c, 0) AS yesterday FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN t ON t.user_id = u.user_id LEFT JOIN y ON y.user_id = u.user_id ORDER BY today DESC, yesterday DESC, u.user_id LIMIT 100""",
    "revenue_summary": "SELECT o_orderstatus, count(*) AS payments, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS paise, count(DISTINCT o_custkey) AS payers FROM orders GROUP BY 1",
    "revenue_of_user": "SELECT count(*) AS payments, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS paise FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7 AND o_orderdate >= TIMESTAMP '1995-01-01'",
    "feedback_join_report": f"""SELECT event_id, ts, {_RATING} AS rating, c_name, n_name, o_orderpriority,
 CASE WHEN length(props) > 40 THEN substr(props, 1, 40) || '...' ELSE props END AS preview
 FROM events JOIN orders ON event_id = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "feedback_rating": f"SELECT count(*) AS n, round(coalesce(avg({_RATING}), 0), 1) AS mean, count(*) FILTER (WHERE {_RATING} < 0) AS negative FROM events WHERE {_DAY}",
    "credit_history_top100": f"SELECT * FROM {_LOGS} ORDER BY created_at DESC, log_id DESC LIMIT 100",
    "active_users_by_day": "SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "package_sales_left_join": """SELECT p_partkey, p_name, p_size, coalesce(sales, 0) AS sales, coalesce(quantity, 0) AS quantity FROM part LEFT JOIN
 (SELECT l_partkey, count(*) AS sales, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""",
    "name_lookup_ignoring_case": "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = 'customer#000000007'",
}
