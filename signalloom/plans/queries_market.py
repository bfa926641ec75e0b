"""Bars, correlations, offers, rankings and graph queries over the order tables."""

from pyspark.sql import functions as F

from signalloom.functions.numbers import format_rate, round_half_up
from signalloom.operators import graph as G
from signalloom.operators import market as M
from signalloom.operators import offers as O
from signalloom.operators import rankings as R
from signalloom.operators.scoring import direction, is_up
from signalloom.plans import tables as T
from signalloom.plans.registry import half_up, query

BARS = """tr AS (SELECT n_name AS ticker, n_nationkey AS ord, CAST(o_orderdate AS DATE) AS "date", o_totalprice AS p, o_orderkey AS k
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  bars AS (SELECT ticker, ord, "date", arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
    count(*) AS volume FROM tr GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY "date" DESC) AS rn FROM bars)"""
RETURNS = f"""{BARS}, ret AS (SELECT ticker, ord, "date", (close - b) / b AS r FROM (
    SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY "date") AS b FROM bars) WHERE b IS NOT NULL AND b <> 0)"""
PAIRS = f"""{RETURNS}, joined AS (SELECT x.ticker AS a, y.ticker AS b, x.r AS ra, y.r AS rb,
    row_number() OVER (PARTITION BY x.ticker, y.ticker ORDER BY x."date" DESC) AS rn
    FROM ret x JOIN ret y ON x."date" = y."date" AND x.ord < y.ord),
  cor AS (SELECT a, b, corr(ra, rb) AS c, count(*) AS n FROM joined WHERE rn <= 30 GROUP BY ALL HAVING count(*) = 30),
  pairs AS (SELECT a, b, {half_up("c", 3)} AS r, n FROM cor WHERE abs(c) >= 0.3)"""


def r6(name):
    return round_half_up(F.col(name), 6).alias(name)


@query("daily_bars", f"WITH {BARS} SELECT ticker, \"date\", open, high, low, close, volume FROM bars")
def daily_bars(spark, d):
    return T.bars(spark, d)


@query("daily_returns", f"WITH {RETURNS} SELECT ticker, \"date\", {half_up('r', 6)} AS r FROM ret")
def daily_returns(spark, d):
    return M.daily_returns(T.bars(spark, d)).select("ticker", "date", r6("r"))


@query("daily_change", f"""WITH {BARS}, e AS (SELECT ticker, max(close) FILTER (rn = 1) AS c1, max(close) FILTER (rn = 2) AS c2 FROM ranked GROUP BY ALL)
  SELECT ticker, c1 AS latest_close, c2 AS prev_close, {half_up("(c1 - c2) / c2 * 100", 6)} AS change_pct,
    abs((c1 - c2) / c2 * 100) > 25 AS review, CASE WHEN (c1 - c2) / c2 * 100 > 0.15 THEN 'up'
    WHEN (c1 - c2) / c2 * 100 < -0.15 THEN 'down' ELSE 'flat' END AS direction FROM e""")
def daily_change(spark, d):
    return M.daily_change(T.bars(spark, d)).select(
        "ticker", "latest_close", "prev_close", r6("change_pct"), "review",
        direction(F.col("change_pct")).alias("direction"),
    )


@query("daily_change_live", f"""WITH {BARS}, e AS (SELECT ticker, max(close) FILTER (rn = 1) AS c1, max(high) FILTER (rn = 1) AS live FROM ranked GROUP BY ALL),
  f AS (SELECT ticker, max(close) FILTER (rn = 2) AS c2 FROM ranked GROUP BY ALL)
  SELECT ticker, CASE WHEN abs(live - c1) / c1 > 1e-6 THEN live ELSE c1 END AS latest_close,
    CASE WHEN abs(live - c1) / c1 > 1e-6 THEN c1 ELSE c2 END AS prev_close FROM e JOIN f USING (ticker)""")
def daily_change_live(spark, d):
    bars = T.bars(spark, d)
    live = bars.groupBy("ticker").agg(F.max_by("high", "date").alias("live_price"))
    return M.daily_change(bars, live).select("ticker", "latest_close", "prev_close")


def _period(n):
    return f"""WITH {BARS}, e AS (SELECT ticker, max(close) FILTER (rn = 1) AS c1, max(close) FILTER (rn = {n + 1}) AS c2 FROM ranked GROUP BY ALL)
  SELECT ticker, {half_up("(c1 - c2) / c2 * 100", 6)} AS change_pct FROM e"""


@query("period_change", _period(5))
def week_change(spark, d):
    return M.period_change(T.bars(spark, d), 5).select("ticker", r6("change_pct"))


@query("period_change_month", _period(21))
def month_change(spark, d):
    return M.period_change(T.bars(spark, d), 21).select("ticker", r6("change_pct"))


@query("relative_volume", f"""WITH {BARS} SELECT ticker, {half_up("max(volume) FILTER (rn = 1) / avg(volume) FILTER (rn BETWEEN 2 AND 21)", 6)} AS rel_volume FROM ranked GROUP BY ALL""")
def relative_volume(spark, d):
    return M.relative_volume(T.bars(spark, d)).select("ticker", r6("rel_volume"))


@query("volume_avg_20", f"WITH {BARS} SELECT ticker, {half_up('avg(volume) FILTER (rn BETWEEN 2 AND 21)', 6)} AS avg_volume FROM ranked GROUP BY ALL")
def volume_avg(spark, d):
    return M.volume_average(T.bars(spark, d)).select("ticker", r6("avg_volume"))


CANDLES = f"""{BARS}, candles AS (SELECT ticker, "date", {half_up("open", 2)} AS open, {half_up("greatest(open, high, low, close)", 2)} AS high,
    {half_up("least(open, high, low, close)", 2)} AS low, {half_up("close", 2)} AS close FROM ranked WHERE rn <= 66)"""


@query("candle_series", f"WITH {CANDLES} SELECT *, close >= open AS is_up FROM candles")
def candle_series(spark, d):
    return M.candle_series(T.bars(spark, d)).withColumn("is_up", is_up(F.col("open"), F.col("close")))


@query("candle_bounds", f"WITH {CANDLES} SELECT ticker, min(low) AS min, max(high) AS max FROM candles GROUP BY ALL")
def candle_bounds(spark, d):
    return M.candle_bounds(M.candle_series(T.bars(spark, d)))


@query("pearson", f"WITH {BARS} SELECT ticker, {half_up('corr(open, close)', 5)} AS r FROM bars GROUP BY ALL")
def pearson(spark, d):
    r = T.bars(spark, d).groupBy("ticker").agg(M.pearson("open", "close").alias("r"))
    return r.select("ticker", round_half_up(F.col("r"), 5).alias("r"))


def _pairs(spark, d):
    return M.correlation_pairs(M.daily_returns(T.bars(spark, d)), T.tickers(spark, d), 30, 0.3)


@query("correlation_pairs", f"WITH {PAIRS} SELECT a, b, r, n FROM pairs")
def correlation_pairs(spark, d):
    return _pairs(spark, d)


@query("ticker_correlations", f"""WITH {PAIRS}, e AS (SELECT a AS ticker, b AS other, r FROM pairs UNION ALL SELECT b, a, r FROM pairs)
  SELECT ticker, kind, other, r, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker, kind ORDER BY abs(r) DESC, other) AS rank
    FROM (SELECT *, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS kind FROM e))
  WHERE rank <= CASE WHEN kind = 'positive' THEN 3 ELSE 1 END""")
def ticker_correlations(spark, d):
    return M.ticker_correlations(_pairs(spark, d)).select("ticker", "kind", "other", "r", "rank")


@query("market_cap", f"""WITH {BARS} SELECT ticker, {half_up("(1 + n.n_nationkey) * 1e9 * close", 2)} AS market_cap, {half_up("volume * close", 2)} AS dollar_volume
  FROM ranked JOIN nation n ON n.n_name = ticker WHERE rn = 1""")
def market_cap(spark, d):
    last = T.bars(spark, d).groupBy("ticker").agg(
        F.max_by("close", "date").alias("price"), F.max_by("volume", "date").alias("volume")
    )
    shares = T.tickers(spark, d).select("ticker", (F.col("ord") + 1).cast("double").alias("shares"))
    return M.market_values(last.join(shares, "ticker", "left")).select(
        "ticker", round_half_up(F.col("market_cap"), 2).alias("market_cap"),
        round_half_up(F.col("dollar_volume"), 2).alias("dollar_volume"),
    )


STOCKS = f"""{BARS}, live AS (SELECT c_nationkey AS ord, avg(c_acctbal) AS live_price, CASE WHEN any_value(c_nationkey) % 3 > 0 THEN count(*) END AS live_volume
    FROM customer WHERE c_nationkey % 5 <> 1 GROUP BY c_nationkey),
  nodes AS (SELECT n_name AS ticker, {half_up("live_price", 6)} AS price, coalesce(live_volume, b.volume) AS volume,
    {half_up("CASE WHEN n_nationkey % 4 <> 2 THEN n_nationkey + 1.0 END * 1e9 * live_price / 1e6", 1)} AS market_cap_m,
    {half_up("coalesce(live_volume, b.volume) * live_price", 2)} AS dollar_volume
    FROM nation LEFT JOIN live ON live.ord = n_nationkey LEFT JOIN (SELECT ticker, volume FROM ranked WHERE rn = 1) b ON b.ticker = n_name)"""


def _stock_nodes(spark, d):
    """Nations as stocks: some without shares, some without a live price or a live volume."""
    number = F.col("ord")
    stocks = T.tickers(spark, d).withColumn("shares", F.when(number % 4 != 2, (number + 1).cast("double")))
    bars = T.bars(spark, d)
    last = bars.groupBy("ticker").agg(F.max_by("volume", "date").alias("volume"))
    quotes = T.table(spark, d, "customer").where("c_nationkey % 5 <> 1").groupBy(F.col("c_nationkey").alias("ord")).agg(
        F.avg("c_acctbal").alias("live_price"), F.count("*").alias("_n")
    ).select("ord", "live_price", F.when(F.col("ord") % 3 > 0, F.col("_n")).alias("live_volume"))
    live = T.tickers(spark, d).join(quotes, "ord").select("ticker", "live_price", "live_volume")
    series = bars.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "close"))).alias("series"))
    return M.stock_nodes(stocks.drop("ord"), last, live).join(series, "ticker", "left")


@query("stock_meta_join", f"WITH {STOCKS} SELECT * FROM nodes")
def stock_meta_join(spark, d):
    return _stock_nodes(spark, d).select(
        "ticker", round_half_up(F.col("price"), 6).alias("price"), "volume",
        round_half_up(F.col("market_cap") / 1e6, 1).alias("market_cap_m"), round_half_up(F.col("dollar_volume"), 2).alias("dollar_volume"),
    )


@query("signal_limit_fields", f"WITH {STOCKS} SELECT ticker, CASE WHEN t.k % 4 <> 2 THEN t.k + 1.0::DOUBLE END AS shares, volume FROM nodes JOIN (SELECT n_name, n_nationkey AS k FROM nation) t ON n_name = ticker")
def signal_limit_fields(spark, d):
    compact = M.compact_stocks(_stock_nodes(spark, d))
    return compact.select(*[c for c in compact.columns if c not in ("price", "market_cap", "dollar_volume")])


@query("listed_offers", """SELECT p_brand || '-' || p_partkey AS alias, CAST(p_size AS DOUBLE) / 100 AS price FROM part WHERE p_size / 100.0 > 0.15 AND p_size <> 50
  UNION ALL SELECT p_brand || '-' || p_partkey, p_retailprice / 1000 FROM part WHERE p_retailprice / 1000 > 0.15 AND p_retailprice <> 500""")
def listed_offers(spark, d):
    """The second marketplace: landed JSON, two prices a type, placeholders dropped."""
    from signalloom.sources.media import parse_listed_offers

    part = T.table(spark, d, "part")
    kind = F.struct(
        F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size").cast("double") / 100).alias("communityPrice"),
        (F.col("p_retailprice") / 1000).alias("securePrice"),
    )
    body = F.to_json(F.struct(F.struct(F.array(kind).alias("gpuTypes")).alias("data"))).alias("body")
    listed = parse_listed_offers(part.select(body))
    return O.listed_prices(listed, "id", ["communityPrice", "securePrice"], "listed").select("alias", "price")


# ---- offers -----------------------------------------------------------------
OFFERS = """off AS (SELECT p_brand AS alias, l_extendedprice / coalesce(nullif(l_quantity, 0), 1) AS price, CAST(l_shipdate AS DATE) AS "date"
    FROM lineitem JOIN part ON l_partkey = p_partkey),
  listed AS (SELECT p_brand AS alias, unnest([CAST(p_size AS DOUBLE) / 100, p_retailprice / 1000]) AS price FROM part),
  catalog AS (SELECT DISTINCT 'group ' || (CAST(substr(p_brand, 7) AS INTEGER) % 6) AS product, p_brand AS alias FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) % 7 <> 0),
  prices AS (SELECT 'bundle' AS source, alias, price FROM off WHERE price > 0.15
    UNION ALL SELECT 'listed', alias, price FROM listed WHERE price > 0.15 AND price <> 0.5)"""
RANGE = f"""{OFFERS}, rng AS (SELECT product, min(price) AS low, max(price) AS high, count(*) AS sample_size
    FROM prices JOIN catalog USING (alias) GROUP BY ALL)"""


def _offer_range(spark, d):
    part = T.table(spark, d, "part").select("p_brand", "p_size", "p_retailprice")
    number = F.substring("p_brand", 7, 9).cast("int")
    catalog = (
        part.where(F.pmod(number, F.lit(7)) != 0)
        .select(F.concat(F.lit("group "), F.pmod(number, F.lit(6)).cast("string")).alias("product"), "p_brand")
        .distinct().groupBy("product").agg(F.collect_set("p_brand").alias("names"))
    )
    listed = part.select(F.col("p_brand").alias("id"), (F.col("p_size").cast("double") / 100).alias("community"),
                         (F.col("p_retailprice") / 1000).alias("secure"))
    prices = O.bundle_prices(T.offers(spark, d), "alias", "units", "price", "bundle").unionByName(
        O.listed_prices(listed, "id", ["community", "secure"], "listed")
    )
    return O.offer_price_range(prices, O.catalog_aliases(catalog, {"bundle": "names", "listed": "names"}))


@query("offer_price_range", f"WITH {RANGE} SELECT product, {half_up('low', 6)} AS low, {half_up('high', 6)} AS high, sample_size FROM rng")
def offer_price_range(spark, d):
    return _offer_range(spark, d).select("product", r6("low"), r6("high"), "sample_size")


@query("format_rate", f"""WITH {RANGE} SELECT product, CASE WHEN abs(high - low) < 0.01 THEN printf('$%.2f/hr', {half_up('low', 2)})
  ELSE printf('$%.2f – $%.2f/hr', {half_up('low', 2)}, {half_up('high', 2)}) END AS rate FROM rng""")
def rates(spark, d):
    return _offer_range(spark, d).select("product", format_rate(F.col("low"), F.col("high")).alias("rate"))


MIDS = """mids AS (SELECT p_brand AS product, CAST(l_shipdate AS DATE) AS "date", (min(l_extendedprice / l_quantity) + max(l_extendedprice / l_quantity)) / 2 AS mid
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
ASOF = f"""{MIDS}, l AS (SELECT product, max("date") AS latest_date, arg_max(mid, "date") AS latest_mid, count(*) AS points FROM mids GROUP BY ALL),
  c AS (SELECT m.product, coalesce(max("date") FILTER ("date" <= latest_date - 7), min("date")) AS compare_date FROM mids m JOIN l USING (product) GROUP BY ALL),
  at7 AS (SELECT l.*, c.compare_date, m.mid AS compare_mid FROM l JOIN c USING (product) JOIN mids m ON m.product = l.product AND m."date" = c.compare_date)"""


@query("append_bounded_history", f"""WITH {MIDS}, today AS (SELECT product, max("date") AS "date", avg(mid) AS mid FROM mids GROUP BY ALL),
  u AS (SELECT m.product, m."date", coalesce(t.mid, m.mid) AS mid FROM mids m LEFT JOIN today t ON t.product = m.product AND t."date" = m."date")
  SELECT product, "date", {half_up("mid", 4)} AS mid FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY "date" DESC) AS rn FROM u) WHERE rn <= 30""")
def bounded_history(spark, d):
    mids = T.mid_prices(spark, d)
    today = mids.groupBy("product").agg(F.max("date").alias("date"), F.avg("mid").alias("mid"))
    return O.snapshot_history(mids, today).select("product", "date", round_half_up(F.col("mid"), 4).alias("mid"))


@query("asof_snapshot", f"WITH {ASOF} SELECT product, latest_date, {half_up('latest_mid', 6)} AS latest_mid, points, compare_date, {half_up('compare_mid', 6)} AS compare_mid FROM at7")
def asof_snapshot(spark, d):
    return O.asof_snapshot(T.mid_prices(spark, d)).select(
        "product", "latest_date", r6("latest_mid"), "points", "compare_date", r6("compare_mid")
    )


@query("price_trend", f"""WITH {ASOF}, p AS (SELECT *, (latest_mid - compare_mid) / compare_mid * 100 AS pct FROM at7)
  SELECT product, {half_up("pct", 6)} AS change_pct, CASE WHEN pct > 3 THEN 'trend-up' WHEN pct < -3 THEN 'trend-down' ELSE 'trend-flat' END AS trend_class,
  CASE WHEN pct > 3 THEN '↑' WHEN pct < -3 THEN '↓' ELSE '→' END || ' ' || CAST(floor(abs(pct) + 0.5) AS INTEGER) || '% vs '
    || greatest(1, latest_date - compare_date) || 'd ago' AS trend FROM p""")
def price_trend(spark, d):
    return O.price_trend(T.mid_prices(spark, d)).select("product", r6("change_pct"), "trend_class", "trend")


# ---- rankings ---------------------------------------------------------------
RANKS = """rows AS (SELECT p_type AS view, p_brand AS item, CAST(rank() OVER (PARTITION BY p_type ORDER BY n DESC) AS INTEGER) AS rank, CAST(n AS DOUBLE) AS score
    FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL))"""


def _rankings(spark, d):
    from pyspark.sql import Window

    counts = T.table(spark, d, "part").groupBy(F.col("p_type").alias("view"), F.col("p_brand").alias("item")).agg(
        F.count("*").cast("double").alias("score")
    )
    return counts.withColumn("rank", F.rank().over(Window.partitionBy("view").orderBy(F.desc("score"))))


@query("rank_with_ties", f"""WITH {RANKS} SELECT view, item, rank, score, CASE WHEN count(*) OVER (PARTITION BY view, rank) > 1 THEN 'T-' ELSE '' END
    || CASE WHEN rank < 10 THEN '0' ELSE '' END || rank AS rank_label,
    floor(score / max(score) OVER (PARTITION BY view) * 100 + 0.5) AS bar_pct FROM rows""")
def rank_with_ties(spark, d):
    return R.rank_with_ties(_rankings(spark, d)).select("view", "item", "rank", "score", "rank_label", "bar_pct")


@query("rank_tie_counts", f"WITH {RANKS} SELECT view, rank, count(*) AS n FROM rows GROUP BY ALL")
def rank_tie_counts(spark, d):
    return R.rank_tie_counts(_rankings(spark, d))


@query("roster_equality", """WITH v AS (SELECT DISTINCT p_size AS view, p_brand AS item FROM part), n AS (SELECT count(DISTINCT view) AS views FROM v)
  SELECT item, views - count(*) AS missing FROM v, n GROUP BY item, views HAVING count(*) < views""")
def roster_equality(spark, d):
    rows = T.table(spark, d, "part").select(F.col("p_size").alias("view"), F.col("p_brand").alias("item"))
    return R.roster_differences(rows)


@query("registry_drift", """SELECT key, left_value, right_value FROM
  (SELECT c_nationkey AS key, count(*) AS left_value FROM customer GROUP BY ALL) a FULL JOIN
  (SELECT s_nationkey AS key, count(*) * 15 AS right_value FROM supplier GROUP BY ALL) b USING (key)
  WHERE left_value IS DISTINCT FROM right_value""")
def registry_drift(spark, d):
    a = T.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("v"))
    b = T.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg((F.count("*") * 15).alias("v"))
    return R.registry_drift(a, b, "key", "v")


SHARES = f"""sh AS (SELECT l_returnflag AS view, p_type AS item, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  shares AS (SELECT view, item, n, {half_up("n * 100.0 / sum(n) OVER (PARTITION BY view)", 3)} AS pct, row_number() OVER (PARTITION BY view ORDER BY n DESC, item) - 1 AS ord FROM sh),
  seg AS (SELECT view, item, ord, pct, sum(pct) OVER (PARTITION BY view ORDER BY ord) - pct AS start, sum(pct) OVER (PARTITION BY view ORDER BY ord) AS "end" FROM shares)"""


def _segments(spark, d):
    from pyspark.sql import Window

    line = T.table(spark, d, "lineitem").select("l_returnflag", "l_partkey")
    part = T.table(spark, d, "part").select("p_partkey", "p_type")
    counts = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_returnflag").alias("view"), F.col("p_type").alias("item")
    ).agg(F.count("*").alias("n"))
    whole = counts.groupBy("view").agg(F.sum("n").alias("_all"))
    shares = counts.join(whole, "view").select(
        "view", "item", round_half_up(F.col("n") * 100.0 / F.col("_all"), 3).alias("pct"),
        (F.row_number().over(Window.partitionBy("view").orderBy(F.desc("n"), "item")) - 1).alias("ord"),
    )
    return R.cumulative_share(shares, "ord")


@query("cumulative_share", f"WITH {SHARES} SELECT view, item, {half_up('start', 3)} AS start, {half_up(chr(34) + 'end' + chr(34), 3)} AS \"end\" FROM seg")
def cumulative_share(spark, d):
    return _segments(spark, d).select(
        "view", "item", round_half_up(F.col("start"), 3).alias("start"), round_half_up(F.col("end"), 3).alias("end")
    )


@query("segment_at_pct", f"""WITH {SHARES}, pts AS (SELECT DISTINCT l_returnflag AS view, l_linenumber * 12 AS point FROM lineitem)
  SELECT view, point, item FROM seg JOIN pts USING (view) WHERE point >= start AND point < "end\"""")
def segment_at_pct(spark, d):
    line = T.table(spark, d, "lineitem")
    points = line.select(F.col("l_returnflag").alias("view"), (F.col("l_linenumber") * 12).alias("point")).distinct()
    return R.segment_at_pct(_segments(spark, d), points).select("view", "point", "item")


@query("scale_to_max", f"""WITH s AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
  SELECT o_orderpriority, o_orderstatus, n, {half_up("n / max(n) OVER (PARTITION BY o_orderpriority)", 6)} AS scaled,
  {half_up("sqrt(n / max(n) OVER (PARTITION BY o_orderpriority))", 6)} AS area FROM s""")
def scale_to_max(spark, d):
    counts = T.table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    scaled = R.scale_to_max(counts, "n", ["o_orderpriority"])
    both = R.scale_to_max(scaled, "n", ["o_orderpriority"], "area", root=True)
    return both.select("o_orderpriority", "o_orderstatus", "n", r6("scaled"), r6("area"))


# ---- graph ------------------------------------------------------------------
EDGES = """edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'partner' AS type FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || (s_nationkey + 3), 'depends' FROM supplier)"""
NODES = """nodes AS (SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region
    UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0)"""


def _tag(letter, column):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def _graph(spark, d):
    nation, supplier, region = (T.table(spark, d, t) for t in ("nation", "supplier", "region"))
    edges = nation.select(_tag("n", "n_nationkey").alias("src"), _tag("r", "n_regionkey").alias("dst"), F.lit("partner").alias("type")).unionByName(
        supplier.withColumn("k", F.col("s_nationkey") + 3).select(_tag("s", "s_suppkey").alias("src"), _tag("n", "k").alias("dst"), F.lit("depends").alias("type"))
    )
    nodes = nation.select(_tag("n", "n_nationkey").alias("id")).unionByName(region.select(_tag("r", "r_regionkey").alias("id"))).unionByName(
        supplier.where("s_acctbal > 0").select(_tag("s", "s_suppkey").alias("id"))
    )
    return edges, nodes


@query("layer_edges", f"WITH {EDGES}, {NODES} SELECT * FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def layer_edges(spark, d):
    return G.layer_edges(*_graph(spark, d))


@query("neighbors", f"""WITH {EDGES}, {NODES}, k AS (SELECT * FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))
  SELECT src AS id, dst AS other, type, 'out' AS dir FROM k UNION ALL SELECT dst, src, type, 'in' FROM k""")
def neighbors(spark, d):
    return G.neighbors(G.layer_edges(*_graph(spark, d)))


@query("model_registry_lookup", """SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey + 3""")
def registry_lookup(spark, d):
    from signalloom.sources.readers import model_lookup

    ids = T.table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") + 3).alias("entity_id"))
    registry = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("entity_id"), "n_name")
    return model_lookup(ids, registry).select("s_suppkey", "n_name")


@query("keep_previous_on_failure", """SELECT coalesce(n.k, p.k) AS k, CASE WHEN n.k IS NOT NULL AND n.k % 4 <> 0 THEN 'new' ELSE 'previous' END AS state
  FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0) n FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'MACHINERY') p ON n.k = p.k
  WHERE (n.k IS NOT NULL AND n.k % 4 <> 0) OR p.k IS NOT NULL""")
def keep_previous(spark, d):
    from signalloom.operators.videos import keep_previous as keep

    customer = T.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    new = customer.where("k % 3 = 0").select("k", F.lit("new").alias("state"))
    previous = customer.where("c_mktsegment <> 'MACHINERY'").select("k", F.lit("previous").alias("state"))
    return keep(new, previous, "k", customer.where("k % 4 = 0"))
