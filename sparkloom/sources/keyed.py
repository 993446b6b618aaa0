"""Tables dealt by a hash of their key, so that changes rewrite the parts they touch and no others.

A batch of changes is applied in two steps that can both be repeated. First the new rows of the touched parts are staged beside the table, with the list
of these parts; the table isn't changed yet. Then they take the parts' places, by an overwrite of these partitions alone, and parts without rows go. A run
that fails in the first step has changed nothing; one that fails in the second finds its stage complete and only publishes it again. Applying a
batch twice gives the same table, since a key's last change decides."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sparkloom.sources.cut import delete, exists

PART = "__part"


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def create(rows: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """Writes rows as a table of so many parts; rows without a key are left out, of a key's rows one must stand."""
    spark = rows.sparkSession
    dealt = rows.where(F.col(key).isNotNull()).withColumn(PART, _part(key, parts)).repartition(parts, PART)
    dealt.write.mode("overwrite").partitionBy(PART).parquet(path)
    # under a name that readers of the table pass over, and after its rows: a table without it isn't there
    spark.createDataFrame([(key, parts, rows.schema.json())], "key string, parts int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_layout")


def layout(spark: SparkSession, path: str) -> tuple[str, int, T.StructType]:
    row = spark.read.parquet(f"{path}/_layout").first()
    return row["key"], row["parts"], T.StructType.fromJson(json.loads(row["columns"]))


def read(spark: SparkSession, path: str, with_part: bool = False) -> DataFrame:
    _, _, columns = layout(spark, path)
    rows = spark.read.schema(T.StructType([*columns.fields, T.StructField(PART, T.IntegerType())])).parquet(path)
    return rows if with_part else rows.drop(PART)


def after(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows after changes (rows' columns, op, place). By place, 'upsert' sets a whole row, 'delete' takes it away, and 'patch' sets the columns that it gives (those that
    are not null) of a row that is there."""
    columns = [c for c in rows.columns if c != key]
    packed = F.struct(*[F.col(f"`{c}`") for c in columns], F.lit(True).alias("__row"))  # a struct needs a field
    rows_, new = rows.select(F.col(key).alias("key"), packed.alias("row")), changes.select(F.col(key).alias("key"), "op", "place", packed.alias("new"))
    reset = F.max(F.when(F.col("op") != "patch", F.col("place"))).over(Window.partitionBy("key"))
    # what comes before a key's last upsert or delete counts no more; null: there is none, and patches meet the row of the table
    live = new.withColumn("reset", reset).where(F.col("reset").isNull() | (F.col("place") >= F.col("reset")))
    value = lambda c: F.col("new")[c]
    last = lambda c: F.max_by(F.struct(value(c).alias("v")), F.when((F.col("op") == "upsert") | value(c).isNotNull(), F.col("place")))
    told = live.groupBy("key").agg(F.max(F.when(F.col("place") == F.col("reset"), F.col("op"))).alias("first"), F.struct(*[last(c).alias(c) for c in columns], F.lit(True).alias("__row")).alias("to"))
    both = rows_.join(told, "key", "full_outer")
    stays = F.when(F.col("first").isNull(), F.col("row").isNotNull()).otherwise(F.col("first") == "upsert")
    given = lambda c: F.when(F.col("first") == "upsert", F.col("to")[c]["v"]).otherwise(F.coalesce(F.col("to")[c]["v"], F.col("row")[c]))
    return both.where(stays).select(F.col("key").alias(key), *[given(c).alias(c) for c in columns]).select(*[F.col(f"`{c}`") for c in rows.columns])


def stage(changes: DataFrame, path: str, batch: str) -> str:
    """The new rows of all parts that changes touch, and the list of these parts; nothing is done where that is complete."""
    spark = changes.sparkSession
    folder = f"{path}/_staged/{batch}"
    if not exists(spark, f"{folder}/parts/_SUCCESS"):
        key, parts, _ = layout(spark, path)
        changes = changes.where(F.col(key).isNotNull())
        touched = sorted(r[0] for r in changes.select(_part(key, parts)).distinct().collect())  # numbers of parts
        rows = read(spark, path, with_part=True).where(F.col(PART).isin(touched)).drop(PART)
        new = after(rows, changes, key).withColumn(PART, _part(key, parts))
        new.repartition(max(1, len(touched)), PART).write.mode("overwrite").partitionBy(PART).parquet(f"{folder}/rows")
        left = {r[0] for r in spark.read.schema(f"{PART} int").parquet(f"{folder}/rows").select(PART).distinct().collect()} if touched else set()
        spark.createDataFrame([(p, p in left) for p in touched], "part int, has_rows boolean").coalesce(1).write.mode("overwrite").parquet(f"{folder}/parts")
    return folder


def publish(spark: SparkSession, path: str, folder: str) -> None:
    """Puts a complete stage in the place of the table's parts."""
    touched = spark.read.parquet(f"{folder}/parts").collect()
    if any(r["has_rows"] for r in touched):
        _, _, columns = layout(spark, path)
        rows = spark.read.schema(T.StructType([*columns.fields, T.StructField(PART, T.IntegerType())])).parquet(f"{folder}/rows")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    for r in touched:
        if not r["has_rows"]:
            delete(spark, f"{path}/{PART}={r['part']}")
    delete(spark, folder)


def apply(changes: DataFrame, path: str, batch: str) -> None:
    """Applies a batch of changes; after a failure, the same call goes on where that one ended."""
    publish(changes.sparkSession, path, stage(changes, path, batch))


def cascade(gone: DataFrame, path: str, column: str, batch: str) -> None:
    """Deletes the rows whose column is among the values of gone (one column)."""
    spark = gone.sparkSession
    key, _, _ = layout(spark, path)
    rows = read(spark, path)
    hit = rows.join(gone.select(F.col(gone.columns[0]).alias("__gone")).distinct(), rows[column] == F.col("__gone"), "left_semi")
    apply(hit.withColumn("op", F.lit("delete")).withColumn("place", F.lit(0)), path, batch)
