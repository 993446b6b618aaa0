"""Sessions, quotas, balances, coupons and payments as folds over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkloom.plans.analytics import credit_logs
from sparkloom.sources.tables import table

#: Limits of tokens, and what a new user starts with.
GLOBAL_TOKENS, DRAFT_TOKENS, SIMPLE_TOKENS, START_BALANCE = 1_000_000, 30_000, 50_000, 3
MARKER = "[Documents:"
HISTORY, TRIM_CAP, TRIM_FLOOR = 50, 20, 4
#: The test data's sessions are short, so the queries use limits that some of them reach.
DEMO_SESSION_LIMIT, DEMO_BUDGET = 600, 900
COUPONS = [("TEN", "percentage", 10, 0, 5, True), ("FLAT", "fixed", 50_000, 100, 3, True), ("USED", "fixed", 100, 5, 5, True), ("OFF", "percentage", 50, 0, 0, False), ("ALL", "percentage", 100, 0, 0, True)]


def tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", tokens(F.col("text")).alias("tokens"))


def session_token_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.when(F.col("role") != "assistant", F.col("tokens")).otherwise(0)
    answer = F.when(F.col("role") == "assistant", F.col("tokens")).otherwise(0)
    return messages(spark, sf_dir).groupBy("conv_id").agg(F.sum(prompt + answer).alias("tokens"), F.count("*").alias("messages"))


def session_titles_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first message names a session; one marked user message makes it a draft for good."""
    marked = (F.col("role") == "user") & F.contains("text", F.lit(MARKER))
    first = F.min_by(F.substring("text", 1, 30), "turn")
    return messages(spark, sf_dir).groupBy("conv_id").agg(first.alias("title"), F.when(F.max(marked), "draft").otherwise("simple").alias("session_type"))


def quota_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks in order, the first failure counts: simple balance, all tokens, the session's tokens."""
    sums = messages(spark, sf_dir).groupBy("conv_id").agg(F.sum("tokens").alias("tokens"))
    balance = F.col("conv_id") % 4
    verdict = F.when(balance <= 0, "no simple credits").when(F.col("tokens") > GLOBAL_TOKENS, "token limit").when(F.col("tokens") > DEMO_SESSION_LIMIT, "session limit").otherwise("ok")
    return sums.select("conv_id", "tokens", verdict.alias("verdict"))


def fold_balance(rows: DataFrame, start: int = START_BALANCE) -> DataFrame:
    """user_id, balance, used, refused, alerts from (user_id, at, id, amount): purchases add; a use takes one where there is one, counts
    always, and gives an alert where exactly one is left. Zero is a floor, so the order matters: the balance is the running sum less its
    lowest value so far where that is below zero. Windows by user, so no user's rows are gathered in one."""
    order = Window.partitionBy("user_id").orderBy("at", "id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    use = F.col("amount") < 0
    rows = rows.withColumn("sum", start + F.sum(F.when(use, -1).otherwise(F.col("amount"))).over(so_far))
    rows = rows.withColumn("balance", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far))).withColumn("before", F.coalesce(F.lag("balance").over(order), F.lit(start)))
    last = F.max_by("balance", F.struct("at", "id")).cast("long")
    return rows.groupBy("user_id").agg(last.alias("balance"), F.count_if(use).alias("used"), F.count_if(use & (F.col("before") <= 0)).alias("refused"), F.count_if(use & (F.col("before") == 2)).alias("alerts"))


def usage_ledger_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = credit_logs(table(spark, sf_dir, "events")).where("credit_type <> 'simple'")
    return fold_balance(logs.select("user_id", F.col("created_at").alias("at"), F.col("log_id").alias("id"), "amount"))


def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum of every ledger row, without the floor."""
    order = Window.partitionBy("user_id").orderBy("created_at", "log_id").rowsBetween(Window.unboundedPreceding, 0)
    return credit_logs(table(spark, sf_dir, "events")).select("user_id", "log_id", "amount", F.sum("amount").over(order).alias("balance"))


def stream_quota_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers are given before they are counted: the one that breaks the limit still comes, nothing after it does."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = messages(spark, sf_dir).withColumn("total", F.sum("tokens").over(order))
    return rows.where(F.col("total") - F.col("tokens") <= DEMO_SESSION_LIMIT).select("conv_id", "turn", "tokens", "total")


def history_last_n(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages(spark, sf_dir).withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n)
    return rows.select("conv_id", "turn", "role", "tokens", "back")


def history_budget_trim(spark: SparkSession, sf_dir: str, budget: int = DEMO_BUDGET) -> DataFrame:
    """Of the newest TRIM_CAP messages, drop the two oldest while they don't fit; once TRIM_FLOOR or fewer are left and don't fit, drop all.
    That is the longest suffix, in steps of two, that fits: a reverse running sum finds it without a loop."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages(spark, sf_dir).withColumn("back", F.row_number().over(newest)).where(F.col("back") <= TRIM_CAP)
    rows = rows.withColumn("size", F.sum(F.length("text")).over(newest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    reach = ((F.col("n") - F.col("back")) % 2 == 0) & ((F.col("back") >= F.least(F.lit(TRIM_FLOOR - 1), "n")) | (F.col("back") == F.col("n"))) & (F.col("size") <= budget)
    keep = F.max(F.when(reach, F.col("back"))).over(Window.partitionBy("conv_id"))
    return rows.withColumn("keep", keep).where(F.col("back") <= F.col("keep")).select("conv_id", "turn", "role")


def capped_sessions(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", "event_id", "ts")
    return rows.withColumn("slot", F.row_number().over(newest)).where(F.col("slot") <= n).select("user_id", "event_id", "slot")


def coupon_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every package with every coupon: usable or why not, discount (percentages cut off, never clamped), final price, status."""
    packages = table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("amount"))
    coupons = spark.createDataFrame(COUPONS, "code string, discount_type string, discount_value int, max_uses int, current_uses int, is_active boolean")
    rows = packages.join(F.broadcast(coupons))  # a handful of coupons
    why = F.when(~F.col("is_active"), "inactive").when((F.coalesce("max_uses", F.lit(0)) > 0) & (F.col("current_uses") >= F.col("max_uses")), "used up").otherwise("ok")
    cut = F.when(F.col("discount_type") == "fixed", F.col("discount_value").cast("long")).otherwise((F.col("amount") * (F.col("discount_value") / 100)).cast("long"))
    rows = rows.withColumn("verdict", why).withColumn("discount", F.when(F.col("verdict") == "ok", cut).otherwise(F.lit(0).cast("long")))
    final = F.greatest(F.col("amount") - F.col("discount"), F.lit(0))
    return rows.select("p_partkey", "code", "verdict", "discount", final.alias("final"), F.when(final == 0, "completed").otherwise("pending").alias("status"))


def payment_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases confirm payments by number; unknown and repeated confirmations change nothing."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    sent = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("o_orderkey")).union(table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id")).distinct()
    done = orders.join(sent.withColumn("sent", F.lit(True)), "o_orderkey", "left")
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("sent"), "completed").otherwise("pending")
    return done.select("o_orderkey", state.alias("status"), ((F.col("o_orderstatus") != "F") & F.coalesce("sent", F.lit(False))).alias("credited"))


def fk_nullify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment go; their orders stay, without them."""
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("gone"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = orders.join(gone, orders["o_custkey"] == gone["gone"], "left")
    return joined.select("o_orderkey", F.when(F.col("gone").isNull(), F.col("o_custkey")).alias("o_custkey"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment go with their orders and the orders' lines."""
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(gone, "o_custkey", "left_anti")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values replace old ones only where they are given."""
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return old.join(new, "c_custkey", "left").select("c_custkey", F.coalesce("balance", "c_acctbal").alias("c_acctbal"))


def lookup_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A usage row for each customer that has none, with the starting balance."""
    have = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("used"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).join(have, "user_id", "left_anti")
    return have.withColumn("created", F.lit(False)).unionByName(new.select("user_id", F.lit(0).cast("long").alias("used"), F.lit(True).alias("created")))


def share_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link a session, derived from it, so that asking again gives the same."""
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return rows.select("conv_id", F.substring(F.sha2(F.concat(F.lit("share:"), F.col("conv_id").cast("string")), 256), 1, 12).alias("share_id"))


def set_for_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.lit(True).alias("is_verified"))


QUERIES = {f.__name__: f for f in (
    session_token_sum, session_titles_types, quota_gate, usage_ledger_fold, running_balance, stream_quota_cut, history_last_n, history_budget_trim,
    capped_sessions, coupon_price, payment_completion, fk_nullify, cascade_delete, partial_update, lookup_or_create, share_links, set_for_all,
)}

_M = "(SELECT conv_id, turn, role, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conversations)"
_LOGS = """(SELECT event_id AS log_id, user_id, CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) ELSE -1 END AS amount, event_type, ts
 FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""
_VALUES = ", ".join(f"('{c}', '{t}', {v}, {m}, {u}, {str(a).lower()})" for c, t, v, m, u, a in COUPONS)

ORACLES = {
    "session_token_sum": f"SELECT conv_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS messages FROM {_M} GROUP BY 1",
    "session_titles_types": f"""SELECT conv_id, arg_min(substr(text, 1, 30), turn) AS title,
 CASE WHEN bool_or(role = 'user' AND contains(text, '{MARKER}')) THEN 'draft' ELSE 'simple' END AS session_type FROM conversations GROUP BY 1""",
    "quota_gate": f"""SELECT conv_id, tokens, CASE WHEN conv_id % 4 <= 0 THEN 'no simple credits' WHEN tokens > {GLOBAL_TOKENS} THEN 'token limit'
 WHEN tokens > {DEMO_SESSION_LIMIT} THEN 'session limit' ELSE 'ok' END AS verdict FROM (SELECT conv_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM {_M} GROUP BY 1)""",
    "usage_ledger_fold": f"""WITH RECURSIVE l AS (SELECT user_id, amount, row_number() OVER (PARTITION BY user_id ORDER BY ts, log_id) AS k FROM {_LOGS} WHERE event_type <> 'view'),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST({START_BALANCE} AS BIGINT) AS balance, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS alerts FROM (SELECT DISTINCT user_id FROM l)
 UNION ALL SELECT f.user_id, l.k, CASE WHEN l.amount < 0 THEN greatest(f.balance - 1, 0) ELSE f.balance + l.amount END, f.used + CASE WHEN l.amount < 0 THEN 1 ELSE 0 END,
 f.refused + CASE WHEN l.amount < 0 AND f.balance <= 0 THEN 1 ELSE 0 END, f.alerts + CASE WHEN l.amount < 0 AND f.balance = 2 THEN 1 ELSE 0 END FROM f JOIN l ON l.user_id = f.user_id AND l.k = f.k + 1)
SELECT user_id, arg_max(balance, k) AS balance, arg_max(used, k) AS used, arg_max(refused, k) AS refused, arg_max(alerts, k) AS alerts FROM f GROUP BY 1""",
    "running_balance": f"SELECT user_id, log_id, amount, CAST(sum(amount) OVER (PARTITION BY user_id ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM {_LOGS}",
    "stream_quota_cut": f"""SELECT conv_id, turn, tokens, total FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM {_M})
 WHERE total - tokens <= {DEMO_SESSION_LIMIT}""",
    "history_last_n": f"SELECT conv_id, turn, role, tokens, CAST(back AS INTEGER) AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {_M}) WHERE back <= 3",
    "history_budget_trim": f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= {TRIM_CAP}),
s AS (SELECT conv_id, count(*) AS left_, CAST(sum(length(text)) AS BIGINT) AS size FROM h GROUP BY 1
 UNION ALL SELECT s.conv_id, CASE WHEN s.left_ <= {TRIM_FLOOR} THEN 0 ELSE s.left_ - 2 END,
  CASE WHEN s.left_ <= {TRIM_FLOOR} THEN 0 ELSE (SELECT CAST(sum(length(h.text)) AS BIGINT) FROM h WHERE h.conv_id = s.conv_id AND h.back <= s.left_ - 2) END
  FROM s WHERE s.size > {DEMO_BUDGET} AND s.left_ > 0)
SELECT h.conv_id, h.turn, h.role FROM h JOIN (SELECT conv_id, min(left_) AS keep FROM s GROUP BY 1) k ON h.conv_id = k.conv_id AND h.back <= k.keep""",
    "capped_sessions": "SELECT user_id, event_id, CAST(slot AS INTEGER) AS slot FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS slot FROM events WHERE event_type = 'signup') WHERE slot <= 5",
    "coupon_price": f"""WITH c(code, discount_type, discount_value, max_uses, current_uses, is_active) AS (VALUES {_VALUES}),
p AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS amount FROM part),
v AS (SELECT *, CASE WHEN NOT is_active THEN 'inactive' WHEN coalesce(max_uses, 0) > 0 AND current_uses >= max_uses THEN 'used up' ELSE 'ok' END AS verdict FROM p, c),
d AS (SELECT *, CAST(CASE WHEN verdict <> 'ok' THEN 0 WHEN discount_type = 'fixed' THEN discount_value ELSE trunc(amount * (discount_value::DOUBLE / 100)) END AS BIGINT) AS discount FROM v)
SELECT p_partkey, code, verdict, discount, greatest(amount - discount, 0) AS final, CASE WHEN greatest(amount - discount, 0) = 0 THEN 'completed' ELSE 'pending' END AS status FROM d""",
    "payment_completion": """WITH sent AS (SELECT event_id AS k FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'purchase')
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR k IS NOT NULL THEN 'completed' ELSE 'pending' END AS status, o_orderstatus <> 'F' AND k IS NOT NULL AS credited FROM orders LEFT JOIN sent ON k = o_orderkey""",
    "fk_nullify": "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey",
    "cascade_delete": "SELECT l_orderkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "partial_update": "SELECT c_custkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, c_acctbal) AS c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "lookup_or_create": """SELECT c_custkey AS user_id, count(o_orderkey) AS used, count(o_orderkey) = 0 AS created FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "share_links": "SELECT DISTINCT conv_id, substr(sha256('share:' || conv_id), 1, 12) AS share_id FROM conversations",
    "set_for_all": "SELECT c_custkey, true AS is_verified FROM customer",
}
