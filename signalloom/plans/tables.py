"""The given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.operators.market import daily_bars


def instant_schema(schema: T.StructType) -> T.StructType:
    """Zone-less timestamps as UTC instants, decided in the scan so that filters
    on them still reach the files."""
    return T.StructType(
        [
            T.StructField(f.name, T.TimestampType(), f.nullable) if f.dataType == T.TimestampNTZType() else f
            for f in schema.fields
        ]
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(instant_schema(spark.read.parquet(path).schema)).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """For a local session that asks for it: give a small one-split file to all cores.

    Anywhere else the input stays as it is read; raw texts are not shuffled.
    """
    if df.sparkSession.conf.get("signalloom.local.spread", "false") != "true":
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def hours_after(key: str) -> F.Column:
    """A publication time inside January 2024, spread by the key."""
    return F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col(key) * 7919, F.lit(720)) * 3600)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news items: first line as title, the whole text as description."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("desc"),
        hours_after("doc_id").alias("published_at"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("link"),
        F.col("source").alias("source_name"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as history rows: type as category, user group as entity."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("cluster_id"),
        F.col("ts").alias("published_at"),
        F.col("event_type").alias("category"),
        F.array(F.concat(F.lit("g"), F.pmod("user_id", F.lit(20)).cast("string"))).alias("entity_ids"),
        F.to_date("ts").alias("collected_on"),
        "value",
    )


def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(20)).alias("g")).distinct()
    return users.select(F.concat(F.lit("g"), F.col("g").cast("string")).alias("id"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trades of their customer's nation, as daily bars."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    by_nation = daily_bars(
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey")),
        "c_nationkey", "o_orderdate", "o_totalprice", "o_orderkey",
    )
    named = by_nation.withColumnRenamed("ticker", "n_nationkey").join(nation, "n_nationkey")
    return named.select(F.col("n_name").alias("ticker"), "date", "open", "high", "low", "close", "volume")


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker"), F.col("n_nationkey").alias("ord"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("alias"), F.col("l_quantity").alias("units"), F.col("l_extendedprice").alias("price"),
        F.to_date("l_shipdate").alias("date"),
    )


def mid_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mid price of a unit per brand."""
    unit = F.col("price") / F.col("units")
    return offers(spark, sf_dir).groupBy(F.col("alias").alias("product"), "date").agg(
        ((F.min(unit) + F.max(unit)) / 2).alias("mid")
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as comments of their thread."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    return (
        spread(table(spark, sf_dir, "conversations"))
        .select(key.alias("comment_id"), "conv_id", "turn", "role", "text")
        .withColumn("published_at", hours_after("comment_id"))
    )
