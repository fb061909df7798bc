"""The given Parquet tables, and the views that queries build on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staytide.functions.clock import elapsed_us


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stay per user; every third one dies 0, 3, ... 27 days after the first event."""
    u = F.col("user_id")
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
        .select(
            u.alias("stay_id"),
            (u % 50).alias("patient_id"),
            "t0",
            "t1",
            F.when(u % 3 == 0, F.col("t0") + F.make_dt_interval(days=(u % 30).cast("int"))).alias("death_ts"),
            F.when(u % 3 == 0, "Expired").when(u % 11 == 5, F.lit(None)).otherwise("Alive").alias("status"),
        )
    )


def _events(spark: SparkSession, sf_dir: str, test: Column) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter(test)
        .select("event_id", F.col("user_id").alias("stay_id"), "ts", "value")
    )


def m1_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, (F.col("event_type") == "view") & (F.col("value") <= 300))


def m2_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(
        spark, sf_dir, F.col("event_type").isin("click", "purchase") & F.col("value").between(30, 300)
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _events(spark, sf_dir, F.col("event_type") == "signup")
    return raw.select(
        "event_id",
        "stay_id",
        "ts",
        (F.floor("value").cast("int") % 6 - 1).alias("typ"),
        (F.col("value") > 100).alias("active"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _events(spark, sf_dir, F.col("event_type") == "error")
    return raw.select(
        "stay_id",
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("end_ts"),
        F.col("value").alias("score"),
    )


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("stay_id"),
        F.col("c_mktsegment").alias("ethnicity"),
        F.when(n % 2 == 0, "Male").when(n % 5 == 0, "Unknown").otherwise("Female").alias("gender"),
        F.when(k % 9 == 4, "> 89").otherwise((18 + k % 70).cast("string")).alias("age_text"),
        F.when(k % 4 != 1, (140 + n).cast("double")).alias("height"),
        F.when(k % 5 != 2, 50.0 + F.col("c_acctbal") / 200.0).alias("weight"),
    )


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature row per order, from its lines; label: the order is finished."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n_lines"),
            F.sum("l_quantity").alias("quantity"),
            F.sum("l_extendedprice").alias("price"),
            F.avg("l_discount").alias("discount"),
            F.avg("l_tax").alias("tax"),
            F.count_if(F.col("l_returnflag") == "R").cast("double").alias("n_returned"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_totalprice").alias("total"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


ORDER_FEATURES = ["n_lines", "quantity", "price", "discount", "tax", "n_returned", "total"]


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label, and their length as score."""
    return table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id"
    )


def with_offset(events: DataFrame, stays_df: DataFrame, *attributes: str, how: str = "inner") -> DataFrame:
    """Events with microseconds since admission, and attributes of their stay."""
    return (
        events.join(stays_df.select("stay_id", "t0", *attributes), "stay_id", how)
        .withColumn("off_us", elapsed_us("t0", "ts"))
        .drop("t0")
    )


def surface(df: DataFrame, models: int = 5) -> DataFrame:
    """Five analytic risk surfaces over (m1_valuenum, m2_valuenum), shifted by case and model."""
    s, m1, m2 = F.col("stay_id"), F.col("m1_valuenum").cast("double"), F.col("m2_valuenum").cast("double")
    preds = {}
    for k in range(models):
        a = m1 - (70 + 3 * k + s % 10)
        b = m2 - (115 + 2 * k + s % 15)
        preds[f"pred_{k}"] = 1 / (1 + F.exp(-(F.lit(-4.0) + 0.0009 * (a * a) + 0.0006 * (b * b))))
    return df.withColumns(preds)


PREDS = [f"pred_{k}" for k in range(5)]
