"""Changes to stored tables: customers dealt by key, changed by two batches of orders, then without those of some nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.sources import keyed
from sparkloom.sources.cut import new_folder
from sparkloom.sources.tables import table

PARTS = 16


def keyed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders tell of their customer: some are new, some go, of most only the name changes; even orders come first, odd ones after them."""
    path, n = new_folder(spark, "customers"), F.col("o_orderkey")
    keyed.create(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path, "c_custkey", PARTS)
    op = F.when(n % 7 == 0, "upsert").when(n % 3 == 0, "delete").otherwise("patch")
    new = F.col("op") == "upsert"
    changes = table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(n % 21 == 0, 1_000_000).otherwise(0)).alias("c_custkey"), F.concat(F.lit("order "), n.cast("string")).alias("c_name"), op.alias("op"), n.alias("place"))
    changes = changes.withColumn("c_nationkey", F.when(new, (F.col("place") % 25).cast("int"))).withColumn("c_mktsegment", F.when(new, "NEW"))
    for batch in (0, 1):
        keyed.apply(changes.where(F.col("place") % 2 == batch), path, f"orders-{batch}")
    keyed.cascade(table(spark, sf_dir, "nation").where("n_regionkey = 0").select("n_nationkey"), path, "c_nationkey", "nations")
    return keyed.read(spark, path)


QUERIES = {"keyed_changes": keyed_changes}

ORACLES = {
    "keyed_changes": """WITH c AS (SELECT o_custkey + CASE WHEN o_orderkey % 21 = 0 THEN 1000000 ELSE 0 END AS k, 'order ' || o_orderkey AS name, o_orderkey % 25 AS nation,
 CASE WHEN o_orderkey % 7 = 0 THEN 'upsert' WHEN o_orderkey % 3 = 0 THEN 'delete' ELSE 'patch' END AS op, row_number() OVER (ORDER BY o_orderkey % 2, o_orderkey) AS place FROM orders),
r AS (SELECT *, max(place) FILTER (WHERE op <> 'patch') OVER (PARTITION BY k) AS reset FROM c),
t AS (SELECT k, max(op) FILTER (WHERE place = reset) AS first, arg_max(name, place) AS name, max(nation) FILTER (WHERE place = reset) AS nation FROM r WHERE reset IS NULL OR place >= reset GROUP BY k)
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM (
 SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(name, c_name) AS c_name, CAST(CASE WHEN first = 'upsert' THEN nation ELSE c_nationkey END AS INTEGER) AS c_nationkey,
 CASE WHEN first = 'upsert' THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer FULL JOIN t ON c_custkey = k
 WHERE CASE WHEN first IS NULL THEN c_custkey IS NOT NULL ELSE first = 'upsert' END)
WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) OR c_nationkey IS NULL""",
}
