"""Price bars: changes, volumes, candles, returns, correlations.

A ticker has at most one bar per calendar day, so a window over one ticker is
bounded by the calendar, not by the raw trades; build bars with
:func:`daily_bars`, which aggregates before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions.numbers import is_finite, round_half_up


def daily_bars(trades: DataFrame, ticker: str, ts: str, price: str, tie: str) -> DataFrame:
    """``(ticker, date, open, high, low, close, volume)`` from single trades."""
    order = F.struct(F.col(ts), F.col(tie))
    return trades.groupBy(F.col(ticker).alias("ticker"), F.to_date(ts).alias("date")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.count("*").alias("volume"),
    )


def _by_date() -> Window:
    return Window.partitionBy("ticker").orderBy("date")


def _newest_first() -> Window:
    return Window.partitionBy("ticker").orderBy(F.desc("date"))


def _latest(bars: DataFrame, valid: Column, k: int) -> DataFrame:
    """The newest ``k`` bars per ticker, valid ones first, as ``_rn`` and ``_ok``.

    One pass: Spark keeps ``k`` rows per ticker and task before the shuffle, and
    a ticker without valid bars still has a row.
    """
    newest = Window.partitionBy("ticker").orderBy(F.desc("_ok"), F.desc("date"))
    return bars.withColumn("_ok", F.coalesce(valid, F.lit(False))).withColumn(
        "_rn", F.row_number().over(newest)
    ).where(F.col("_rn") <= k)


def _nth(column: str, n: int) -> Column:
    return F.max(F.when(F.col("_ok") & (F.col("_rn") == n), F.col(column)))


def _has_close() -> Column:
    return is_finite(F.col("close")) & (F.col("close") > 0)


def daily_returns(bars: DataFrame) -> DataFrame:
    """Day-over-day return; none where either close is missing or the base is 0."""
    before = F.lag("close").over(_by_date())
    r = F.try_divide(F.col("close") - F.col("_before"), F.col("_before"))
    return bars.withColumn("_before", before).select("ticker", "date", r.alias("r")).where("r IS NOT NULL")


def _live(live: DataFrame | None, last: DataFrame) -> DataFrame:
    """Attach the usable live price, if any."""
    if live is None:
        return last.withColumn("_live", F.lit(None).cast("double"))
    usable = live.where(is_finite(F.col("live_price")) & (F.col("live_price") > 0))
    return last.join(usable.select("ticker", F.col("live_price").alias("_live")), "ticker", "left")


def _differs(live: Column, close: Column) -> Column:
    return F.coalesce(F.abs(live - close) / close > V.LIVE_PRICE_TOLERANCE, F.lit(False))


def daily_change(bars: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Change of the last valid close, or of a live price that moved since."""
    last = _latest(bars, _has_close(), 2).groupBy("ticker").agg(
        _nth("close", 1).alias("_c1"), _nth("close", 2).alias("_c2")
    )
    priced = _live(live, last)
    moved = _differs(F.col("_live"), F.col("_c1"))
    priced = priced.withColumns(
        {
            "latest_close": F.when(moved, F.col("_live")).otherwise(F.col("_c1")),
            "prev_close": F.when(moved, F.col("_c1")).otherwise(F.col("_c2")),
        }
    )
    pct = (F.col("latest_close") - F.col("prev_close")) / F.col("prev_close") * 100
    return priced.withColumn("change_pct", pct).select(
        "ticker", "change_pct", "latest_close", "prev_close",
        F.coalesce(F.abs("change_pct") > V.REVIEW_CHANGE_PCT, F.lit(False)).alias("review"),
        F.when(F.col("_c1").isNull(), F.lit("no valid closes"))
        .when(F.col("prev_close").isNull(), F.lit("single valid bar")).alias("reason"),
    )


def period_change(bars: DataFrame, lookback: int, live: DataFrame | None = None) -> DataFrame:
    """Change against the valid close ``lookback`` bars earlier; null if too short."""
    ends = _latest(bars, _has_close(), lookback + 1).groupBy("ticker").agg(
        _nth("close", 1).alias("_c1"), _nth("close", lookback + 1).alias("_base")
    )
    priced = _live(live, ends)
    latest = F.when(_differs(F.col("_live"), F.col("_c1")), F.col("_live")).otherwise(F.col("_c1"))
    return priced.select(
        "ticker",
        ((latest - F.col("_base")) / F.col("_base") * 100).alias("change_pct"),
        F.when(F.col("_base").isNull(), F.lit("insufficient history")).alias("reason"),
    )


def relative_volume(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Latest positive volume against the mean of up to ``lookback`` before it."""
    kept = _latest(bars, F.col("volume") > 0, lookback + 1)
    before = F.avg(F.when(F.col("_ok") & (F.col("_rn") > 1), F.col("volume")))
    return kept.groupBy("ticker").agg(F.try_divide(_nth("volume", 1), before).alias("rel_volume"))


def volume_average(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Mean volume of the bars before the last one, missing volumes left out."""
    ranked = bars.where("close IS NOT NULL").withColumn("_rn", F.row_number().over(_newest_first()))
    return (
        ranked.where(F.col("_rn") <= lookback + 1).groupBy("ticker")
        .agg(F.avg(F.when(F.col("_rn") > 1, F.col("volume"))).alias("avg_volume"))
    )


def candle_series(bars: DataFrame, keep: int = 66) -> DataFrame:
    """Complete bars only, true extremes, cents, the newest ``keep`` per ticker."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    whole = bars.where(is_finite(o) & is_finite(h) & is_finite(l) & is_finite(c))
    return (
        whole.withColumn("_rn", F.row_number().over(_newest_first())).where(F.col("_rn") <= keep)
        .select(
            "ticker", "date", round_half_up(o, 2).alias("open"),
            round_half_up(F.greatest(o, h, l, c), 2).alias("high"),
            round_half_up(F.least(o, h, l, c), 2).alias("low"), round_half_up(c, 2).alias("close"),
        )
    )


def candle_bounds(candles: DataFrame) -> DataFrame:
    """Price range per ticker, padded when it is flat."""
    low, high = F.col("_low"), F.col("_high")
    pad = F.when(low == 0, F.lit(1.0)).otherwise(F.abs(low) * 0.01)
    flat = low == high
    return candles.groupBy("ticker").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).select(
        "ticker", F.when(flat, low - pad).otherwise(low).alias("min"),
        F.when(flat, high + pad).otherwise(high).alias("max"),
    )


def pearson(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null without variance or with one row."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when(F.count("*") >= 2, F.try_divide(F.covar_pop(x, y), spread))


def _block_correlations(window: int, threshold: float):
    def correlate(pdf):
        import numpy as np
        import pandas as pd

        wide = pdf.pivot_table(index="date", columns="ord", values="r", aggfunc="first").sort_index(ascending=False)
        block = dict(zip(pdf["ord"], pdf["block"]))
        names, values = wide.columns.to_numpy(), wide.to_numpy()
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        there = ~np.isnan(values)
        rows = []
        for a, name in enumerate(names):
            if block[name] != lo:
                continue
            # partners come later in ticker order, from the other block of the pair
            later = np.array([b for b in range(len(names)) if names[b] > name and block[names[b]] == hi], dtype=int)
            if not len(later):
                continue
            common = there[:, [a]] & there[:, later]
            recent = common & (np.cumsum(common, axis=0) <= window)
            later, recent = later[recent.sum(axis=0) == window], recent[:, recent.sum(axis=0) == window]
            x = np.where(recent, values[:, [a]], 0.0)
            y = np.where(recent, np.nan_to_num(values[:, later]), 0.0)
            dx = np.where(recent, x - x.sum(axis=0) / window, 0.0)
            dy = np.where(recent, y - y.sum(axis=0) / window, 0.0)
            spread = np.sqrt((dx * dx).sum(axis=0) * (dy * dy).sum(axis=0))
            for b, s, cov in zip(later, spread, (dx * dy).sum(axis=0)):
                if s > 0 and abs(cov / s) >= threshold:
                    rows.append((int(name), int(names[b]), float(cov / s), window))
        return pd.DataFrame(rows, columns=["a_ord", "b_ord", "r", "n"])

    return correlate


def correlation_pairs(
    returns: DataFrame, tickers: DataFrame, window: int = V.CORRELATION_WINDOW,
    threshold: float = V.CORRELATION_THRESHOLD, block: int = 64,
) -> DataFrame:
    """Ticker pairs correlated over their last ``window`` common dates.

    ``tickers(ticker, ord)`` gives the ticker order (0-based).  Tickers are cut
    into blocks and each pair of blocks is one matrix computation on at most
    ``2 * block`` series; only pairs that pass the threshold are emitted, and no
    day or ticker is joined with itself.
    """
    placed = returns.join(tickers, "ticker").withColumn("block", F.floor(F.col("ord") / block).cast("int"))
    last = F.max(F.floor(F.col("ord") / block)).cast("int").alias("_last")
    spread = placed.join(F.broadcast(tickers.agg(last))).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_last")))
    )
    series = spread.select(
        F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"),
        "block", F.col("ord").cast("bigint").alias("ord"), "date", "r",
    )
    found = series.groupBy("lo", "hi").applyInPandas(
        _block_correlations(window, threshold), "a_ord bigint, b_ord bigint, r double, n bigint"
    )
    a = tickers.select(F.col("ord").alias("a_ord"), F.col("ticker").alias("a"))
    b = tickers.select(F.col("ord").alias("b_ord"), F.col("ticker").alias("b"))
    return found.join(a, "a_ord").join(b, "b_ord").select("a", "b", round_half_up(F.col("r"), 3).alias("r"), "n")


def both_directions(pairs: DataFrame) -> DataFrame:
    sides = F.array(F.struct(F.col("a").alias("ticker"), F.col("b").alias("other"), "r"),
                    F.struct(F.col("b").alias("ticker"), F.col("a").alias("other"), "r"))
    return pairs.select(F.inline(sides))


def ticker_correlations(pairs: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` strongest positive partners and the strongest negative one."""
    edges = both_directions(pairs).where("r <> 0").withColumn(
        "kind", F.when(F.col("r") > 0, F.lit("positive")).otherwise(F.lit("negative"))
    )
    w = Window.partitionBy("ticker", "kind").orderBy(F.desc(F.abs("r")), "other")
    return (
        edges.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= F.when(F.col("kind") == "positive", F.lit(k)).otherwise(F.lit(1)))
        .where(F.col("rank") <= k)
    )


def market_values(quotes: DataFrame) -> DataFrame:
    """Adds ``market_cap`` (shares in billions) and ``dollar_volume``."""
    return quotes.withColumns(
        {
            "market_cap": F.col("shares") * 1e9 * F.col("price"),
            "dollar_volume": F.col("volume") * F.col("price"),
        }
    )


def stock_nodes(stocks: DataFrame, last_bar: DataFrame, live: DataFrame, key: str = "ticker") -> DataFrame:
    """Curated stock rows with today's figures.

    ``live(live_price, live_volume)`` comes first; a missing price stays unknown with the
    market value, a missing volume falls back to the last bar's.  ``stocks`` has ``shares`` in
    billions; a stock without shares has no market value.
    """
    joined = stocks.join(live, key, "left").join(last_bar.select(key, F.col("volume").alias("_bar_volume")), key, "left")
    priced = joined.withColumns({"price": F.col("live_price"), "volume": F.coalesce("live_volume", "_bar_volume")})
    return market_values(priced).drop("live_price", "live_volume", "_bar_volume")


def compact_stocks(nodes: DataFrame, dropped: tuple[str, ...] = ("series", "ohlc")) -> DataFrame:
    """The per-stock projection for the published document: everything but the series."""
    return nodes.drop(*dropped)
