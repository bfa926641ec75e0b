"""Marketplace offers against a product catalog, and price trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions.numbers import fixed, is_real_price, per_unit_price, round_half_up


def bundle_prices(offers: DataFrame, alias: str, units: str, price: str, source: str) -> DataFrame:
    """``(source, alias, price)`` per unit, implausibly low ones dropped."""
    each = per_unit_price(F.col(price), F.col(units))
    return offers.select(F.lit(source).alias("source"), F.col(alias).alias("alias"), each.alias("price")).where(
        F.col("price") > V.MIN_PLAUSIBLE_RATE
    )


def listed_prices(offers: DataFrame, alias: str, prices: list[str], source: str) -> DataFrame:
    """``(source, alias, price)``, one row per listed price that is a real one."""
    each = F.explode(F.array(*[F.col(p).cast("double") for p in prices]))
    return offers.select(F.lit(source).alias("source"), F.col(alias).alias("alias"), each.alias("price")).where(
        is_real_price(F.col("price"))
    )


def catalog_aliases(catalog: DataFrame, lists: dict[str, str]) -> DataFrame:
    """``(product, source, alias)`` from the alias array column of each source."""
    parts = [
        catalog.select("product", F.lit(source).alias("source"), F.explode(column).alias("alias"))
        for source, column in lists.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def offer_price_range(prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Low, high and sample size per tracked product; products without offers have no row.

    Offers are reduced per alias before they meet the catalog, so a product that
    holds most offers is never one reducer's input.
    """
    per_alias = prices.groupBy("source", "alias").agg(
        F.min("price").alias("_low"), F.max("price").alias("_high"), F.count("*").alias("_n")
    )
    return (
        per_alias.join(aliases, ["source", "alias"]).groupBy("product")
        .agg(F.min("_low").alias("low"), F.max("_high").alias("high"), F.sum("_n").alias("sample_size"))
    )


def snapshot_history(history: DataFrame, today: DataFrame, keep: int = 30) -> DataFrame:
    """One mid price per product and day (today's rerun wins), newest ``keep`` kept."""
    both = history.select("product", "date", "mid", F.lit(0).alias("_new")).unionByName(
        today.select("product", "date", "mid", F.lit(1).alias("_new"))
    )
    daily = both.groupBy("product", "date").agg(F.max_by("mid", "_new").alias("mid"))
    w = Window.partitionBy("product").orderBy(F.desc("date"))
    return daily.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def asof_snapshot(history: DataFrame, days: int = 7) -> DataFrame:
    """Per product the latest snapshot and the one to compare it with: the newest
    at least ``days`` older, else the oldest."""
    # one exchange: a product's daily snapshots (bounded by the calendar) meet once, for the window and the aggregate
    whole = Window.partitionBy("product")
    dated = history.withColumn("latest_date", F.max("date").over(whole))
    old_enough = F.col("date") <= F.date_sub("latest_date", days)
    point = F.struct(F.col("date"), F.col("mid"))
    return dated.groupBy("product").agg(
        F.first("latest_date").alias("latest_date"), F.max_by("mid", "date").alias("latest_mid"), F.count("*").alias("points"),
        F.coalesce(F.max(F.when(old_enough, point)), F.min(point)).alias("_cmp"),
    ).select("product", "latest_date", "latest_mid", "points",
             F.col("_cmp.date").alias("compare_date"), F.col("_cmp.mid").alias("compare_mid"))


def price_trend(history: DataFrame, days: int = 7) -> DataFrame:
    """Change against the as-of snapshot, its class and its label."""
    asof = asof_snapshot(history, days)
    new = (F.col("points") < 2) | (F.col("compare_date") == F.col("latest_date"))
    pct = (F.col("latest_mid") - F.col("compare_mid")) / F.col("compare_mid") * 100
    gap = F.greatest(F.lit(1), F.date_diff("latest_date", "compare_date"))
    priced = asof.withColumns({"_new": new, "change_pct": F.when(~new, pct), "_gap": gap})
    band = V.TREND_BAND_PCT
    arrow = F.when(F.col("change_pct") > band, F.lit("↑")).when(F.col("change_pct") < -band, F.lit("↓")).otherwise(F.lit("→"))
    label = F.concat(
        arrow, F.lit(" "), fixed(round_half_up(F.abs("change_pct")), 0), F.lit("% vs "),
        F.col("_gap").cast("string"), F.lit("d ago"),
    )
    return priced.select(
        "product", "change_pct",
        F.when(F.col("_new"), F.lit("trend-new")).when(F.col("change_pct") > band, F.lit("trend-up"))
        .when(F.col("change_pct") < -band, F.lit("trend-down")).otherwise(F.lit("trend-flat")).alias("trend_class"),
        F.when(F.col("_new"), F.lit("New — building history")).otherwise(label).alias("trend"),
    )
