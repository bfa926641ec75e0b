import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from signalloom.operators import market as M
from signalloom.operators import offers as O
from signalloom.operators import rankings as R

BAR = "ticker string, date date, open double, high double, low double, close double, volume bigint"


def bars(spark, closes, volumes=None, ticker="T"):
    day = date(2026, 1, 1)
    rows = [
        (ticker, day + timedelta(days=i), c, c, c, c, None if volumes is None else volumes[i]) for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, BAR)


def live(spark, price):
    return spark.createDataFrame([("T", price)], "ticker string, live_price double")


def change(df, price=None):
    r = M.daily_change(df, price).first()
    return r["change_pct"], r["latest_close"], r["prev_close"], r["review"], r["reason"]


def test_daily_change(spark):
    assert change(bars(spark, [100.0, None, 0.0, 110.0])) == (10.0, 110.0, 100.0, False, None)
    assert change(bars(spark, [100.0, 110.0]), live(spark, 121.0))[:3] == (10.0, 121.0, 110.0)
    assert change(bars(spark, [100.0, 110.0]), live(spark, 110.0))[:3] == (10.0, 110.0, 100.0)
    assert change(bars(spark, [100.0, 50.0])) == (-50.0, 50.0, 100.0, True, None)
    assert change(bars(spark, [100.0]))[4] == "single valid bar"
    assert change(bars(spark, [None, 0.0]))[4] == "no valid closes"


def test_period_and_volume(spark):
    df = bars(spark, [float(100 + i) for i in range(8)], [10, 0, None, 20, 30, 40, 50, 60])
    assert M.period_change(df, 5).first()["change_pct"] == (107 - 102) / 102 * 100
    assert M.period_change(df, 21).first()["reason"] == "insufficient history"
    assert M.relative_volume(df).first()["rel_volume"] == 60 / 30
    assert M.relative_volume(bars(spark, [1.0], [5])).first()["rel_volume"] is None


def test_candles(spark):
    rows = [("T", date(2026, 1, d + 1), o, h, l, c, 1) for d, (o, h, l, c) in enumerate(
        [(1.0, 2.0, 0.5, 1.5), (1.0, 1.1, 0.9, float("nan")), (None, 1.0, 1.0, 1.0), (2.0, 1.0, 3.0, 2.555)])]
    out = M.candle_series(spark.createDataFrame(rows, BAR)).orderBy("date").collect()
    assert [(r["open"], r["high"], r["low"], r["close"]) for r in out] == [(1.0, 2.0, 0.5, 1.5), (2.0, 3.0, 1.0, 2.56)]
    flat = M.candle_bounds(M.candle_series(bars(spark, [50.0]))).first()
    assert (flat["min"], flat["max"]) == (49.5, 50.5)


def _pearson(x, y):
    n = len(x)
    mx, my = sum(x) / n, sum(y) / n
    sxy = sum((a - mx) * (b - my) for a, b in zip(x, y))
    d = (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    return sxy / d if d else None


def test_correlations_over_blocks(spark):
    rnd = random.Random(5)
    days = [date(2026, 1, 1) + timedelta(days=i) for i in range(60)]
    common = [rnd.gauss(0, 1) for _ in days]
    series = {}
    for k in range(7):
        sign = -1 if k == 3 else 1
        series[f"t{k}"] = {d: sign * c + rnd.gauss(0, 0.2 + 0.3 * k) for d, c in zip(days, common) if rnd.random() > 0.1 * (k % 3)}
    series["few"] = {d: 1.0 for d in days[:10]}
    series["flat"] = {d: 0.0 for d in days}
    names = sorted(series, reverse=True)
    returns = spark.createDataFrame([(t, d, r) for t, s in series.items() for d, r in s.items()], "ticker string, date date, r double")
    tickers = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "ticker string, ord int")
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            last = sorted(set(series[a]) & set(series[b]))[-30:]
            if len(last) == 30:
                r = _pearson([series[a][d] for d in last], [series[b][d] for d in last])
                if r is not None and abs(r) >= 0.5:
                    want[a, b] = int(r * 1000 + 0.5 if r > 0 else r * 1000 - 0.5) / 1000
    for block in (2, 64):
        got = {(r["a"], r["b"]): r["r"] for r in M.correlation_pairs(returns, tickers, block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.0011 for k in want)
    best = M.ticker_correlations(M.correlation_pairs(returns, tickers)).where("ticker = 't0'").collect()
    assert [r["other"] for r in best if r["kind"] == "negative"] == ["t3"]


def test_offers_and_trend(spark):
    catalog = spark.createDataFrame([("big", ["B1", "B2"], ["id-b"]), ("none", ["X"], ["id-x"])], "product string, a array<string>, b array<string>")
    aliases = O.catalog_aliases(catalog, {"bundles": "a", "listed": "b"})
    bundles = spark.createDataFrame([("B1", 4, 24.0), ("B2", 0, 3.0), ("B1", 1, 0.01), ("other", 1, 1.0)], "n string, u int, p double")
    listed = spark.createDataFrame([("id-b", 0.5, 2.5), ("id-b", None, 0.1)], "id string, c double, s double")
    prices = O.bundle_prices(bundles, "n", "u", "p", "bundles").unionByName(O.listed_prices(listed, "id", ["c", "s"], "listed"))
    assert [tuple(r) for r in O.offer_price_range(prices, aliases).collect()] == [("big", 2.5, 6.0, 3)]

    def trend(points):
        rows = [("p", date(2026, 1, d), m) for d, m in points]
        return O.price_trend(spark.createDataFrame(rows, "product string, date date, mid double")).first()

    assert trend([(1, 10.0)])["trend_class"] == "trend-new"
    assert trend([(1, 9.0), (8, 10.0), (10, 5.0), (16, 11.0)])["trend"] == "↑ 10% vs 8d ago"
    assert trend([(10, 10.0), (12, 10.2)])["trend"] == "→ 2% vs 2d ago"
    assert trend([(1, 10.0), (9, 8.0)])["trend_class"] == "trend-down"


def test_rankings(spark):
    rows = spark.createDataFrame(
        [("v", 1, "a", 60.0, 5), ("v", 2, "b", 45.0, 5), ("v", 2, "c", 45.0, 5), ("w", 1, "d", None, 130)],
        "view string, rank int, item string, score double, w int",
    )
    got = {r["item"]: (r["rank_label"], r["bar_pct"]) for r in R.rank_with_ties(rows, show_index=True).collect()}
    assert got == {"a": ("01", 100.0), "b": ("T-02", 75.0), "c": ("T-02", 75.0), "d": ("01", 100.0)}
    shares = spark.createDataFrame([("s", 0, "x", 60.0), ("s", 1, "y", 39.0)], "view string, ord int, name string, pct double")
    segments = R.cumulative_share(shares, "ord")
    points = spark.createDataFrame([("s", 0.0), ("s", 60.0), ("s", 99.5)], "view string, point double")
    assert [r["name"] for r in R.segment_at_pct(segments, points).orderBy("point").collect()] == ["x", "y", "y"]
