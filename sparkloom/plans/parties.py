"""Joins of parties in which both sides grow with the tables: parts and customers stand for judgments and for those who ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.operators import matching as M
from sparkloom.sources.tables import table


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey")


def fuzzy_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parties of parts and customers against those of all parts and customers; customers ask with the sides exchanged and their words in another order."""
    part, customer = table(spark, sf_dir, "part"), _customers(spark, sf_dir)
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    judgments = part.select(key("p", "p_partkey").alias("external_id"), F.concat("p_name", F.lit(" Pvt. Ltd.")).alias("petitioner"), F.concat("p_type", F.lit(" Stores")).alias("respondent")).union(
        customer.select(key("c", "c_custkey"), F.concat("c_name", F.lit(" "), "c_mktsegment"), F.concat("n_name", F.lit(" Traders Ltd.")))
    )
    queries = part.select(key("p", "p_partkey").alias("query_id"), F.concat(F.lit("M/s. "), "p_name", F.lit(" shop & Ors.")).alias("one"), F.concat("p_brand", F.lit(" "), "p_type", F.lit(" stores")).alias("two")).union(
        customer.select(key("c", "c_custkey"), F.concat("n_name", F.lit(" traders")), F.concat(F.lit("Messrs. "), "c_mktsegment", F.lit(" "), "c_name"))
    )
    found = M.match_fuzzy(queries, judgments)
    return found.select("query_id", "external_id", F.round("score", 6).alias("score"), "rank")


def parties_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every supplier, customers whose names hold its number, or are held in a longer name made of it."""
    number = lambda n: F.lpad(F.col("s_suppkey").cast("string"), n, "0")
    queries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), number(6).alias("one"), F.concat(F.lit("the customer "), number(9), F.lit(" building house")).alias("two"))
    judgments = _customers(spark, sf_dir).select(F.col("c_custkey").alias("external_id"), F.concat("c_name", F.lit(" "), "c_mktsegment").alias("petitioner"), F.concat("n_name", F.lit(" traders")).alias("respondent"))
    return M.match_substring(queries, judgments)


QUERIES = {f.__name__: f for f in (fuzzy_pairs_all, parties_containing)}


def _score(x: str, y: str) -> str:
    tokens = lambda n: f"list_distinct(string_split({n}, ' '))"
    weight = lambda t: f"coalesce(list_sum(list_transform(list_filter({t}, lambda w: length(w) > 2), lambda w: length(w))), 0)"
    a, b, both = weight(tokens(x)), weight(tokens(y)), f"list_intersect({tokens(x)}, {tokens(y)})"
    shares = f"({weight(both)}::DOUBLE / {a} + {weight(both)}::DOUBLE / {b}) / 2"
    return f"CASE WHEN {x} = {y} THEN 1.0 WHEN {a} = 0 OR {b} = 0 THEN len({both})::DOUBLE / len(list_distinct(list_concat({tokens(x)}, {tokens(y)}))) ELSE {shares} END"


def matched_sql(judgments: str, queries: str) -> str:
    """Common tables that end in k: a, b, external_id, score, rank of judgments (external_id, p, r) for queries (a, b)."""
    return f"""j AS ({judgments}), q AS ({queries}),
x AS (SELECT DISTINCT unnest([a, b]) AS x FROM q), y AS (SELECT DISTINCT unnest([p, r]) AS y FROM j),
s AS MATERIALIZED (SELECT x, y, {_score('x', 'y')} AS s FROM x, y WHERE len(list_intersect(string_split(x, ' '), string_split(y, ' '))) > 0),
ab AS (SELECT DISTINCT a, b FROM q), pr AS (SELECT DISTINCT p, r FROM j),
m AS (SELECT a, b, p, r FROM ab JOIN s ON x = a AND s >= 0.6 JOIN pr ON p = y UNION SELECT a, b, p, r FROM ab JOIN s ON x = a AND s >= 0.6 JOIN pr ON r = y),
f AS (SELECT m.*, coalesce(s1.s, 0) AS ap, coalesce(s2.s, 0) AS ar, coalesce(s3.s, 0) AS bp, coalesce(s4.s, 0) AS br FROM m
 LEFT JOIN s s1 ON s1.x = a AND s1.y = p LEFT JOIN s s2 ON s2.x = a AND s2.y = r LEFT JOIN s s3 ON s3.x = b AND s3.y = p LEFT JOIN s s4 ON s4.x = b AND s4.y = r),
c AS (SELECT a, b, p, r, least(greatest(ap, ar), greatest(bp, br)) AS score FROM f WHERE (ap > ar) <> (bp > br)),
t AS (SELECT *, max(score) OVER (PARTITION BY a, b) AS best FROM c),
k AS (SELECT a, b, external_id, score, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, external_id) AS rank FROM t JOIN j USING (p, r) WHERE score >= CASE WHEN best >= 0.75 THEN 0.75 ELSE 0.6 END
 QUALIFY rank <= 5)"""


_CUSTOMERS = "FROM customer JOIN nation ON c_nationkey = n_nationkey"
ORACLES = {
    "fuzzy_pairs_all": "WITH " + matched_sql(
        f"SELECT 'p' || p_partkey AS external_id, p_name AS p, lower(p_type) || ' stores' AS r FROM part UNION ALL SELECT 'c' || c_custkey, lower(c_name) || ' ' || lower(c_mktsegment), lower(n_name) || ' traders' {_CUSTOMERS}",
        f"SELECT 'p' || p_partkey AS query_id, p_name || ' shop' AS a, lower(p_brand) || ' ' || lower(p_type) || ' stores' AS b FROM part UNION ALL SELECT 'c' || c_custkey, lower(n_name) || ' traders', lower(c_mktsegment) || ' ' || lower(c_name) {_CUSTOMERS}",
    ) + " SELECT query_id, external_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM q JOIN k USING (a, b)",
    "parties_containing": """WITH j AS (SELECT c_custkey AS external_id, 'customer ' || substr(c_name, 10) || ' ' || lower(c_mktsegment) AS p, lower(n_name) || ' traders' AS r FROM customer JOIN nation ON c_nationkey = n_nationkey),
q AS (SELECT s_suppkey AS query_id, unnest([lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), 'the customer ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' building house']) AS n FROM supplier),
h AS (SELECT query_id, external_id, contains(p, n) OR contains(n, p) AS one, contains(r, n) OR contains(n, r) AS two FROM q, j)
SELECT query_id, external_id, CASE WHEN bool_or(one) THEN 'petitioner' ELSE 'respondent' END AS side FROM h WHERE one OR two GROUP BY 1, 2""",
}
