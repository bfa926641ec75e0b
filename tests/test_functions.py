from datetime import date, datetime

from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions import dates as D
from signalloom.functions import numbers as N
from signalloom.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def many(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_decode_entities(spark):
    got = many(spark, [
        "<p>hello <b>world</b></p>", "AT&amp;T &lt;3 &quot;quotes&quot;", "by Orb &lt;noreply@orb.example&gt; 377 files",
        "<![CDATA[<i>note</i>]]>", "  a\n\n  b   c  ", "", None, "&#x1F600; &#38;#60; &#233;t&#xe9; &#1114112;",
    ], X.decode_entities)
    assert got == ["hello world", 'AT&T <3 "quotes"', "by Orb 377 files", "note", "a b c", "", "", "😀 &#60; été &#1114112;"]


def test_boundaries_are_ascii(spark):
    assert many(spark, ["écourt", "court", "courts", "é court."], lambda c: X.matches(c, r"\bcourt\b")) == [True, True, False, True]


def test_tokens_and_phrases(spark):
    assert many(spark, ["The Red-Star’s new A.I. Red star"], X.token_set) == [["red", "stars", "star"]]
    assert many(spark, ["Ada Lovelace steps down from Orb Labs"], X.name_phrases) == [["ada lovelace", "orb labs"]]


def test_truncate_and_excerpt(spark):
    assert many(spark, ["abcdef", "abc", None], lambda c: X.truncate(c, 5)) == ["abcd…", "abc", ""]
    text = "word " * 80 + "needle " + "tail " * 60
    got = many(spark, [text, "short"], lambda c: X.excerpt(c, 180, "needle"))
    assert got[1] == "short"
    assert "needle" in got[0] and got[0].startswith("…") and got[0].endswith("…") and len(got[0]) <= 182


def test_stable_id_is_fnv(spark):
    def reference(text):
        h = 0x811C9DC5
        units = text.encode("utf-16-be")
        for k in range(0, len(units), 2):
            h = ((h ^ (units[k] << 8 | units[k + 1])) * 0x01000193) & 0xFFFFFFFF
        digits = ""
        while h:
            h, r = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
        return digits

    texts = ["https://a.example/1", "é", "😀 smile", "x" * 500]
    assert many(spark, texts, X.stable_id) == [reference(t) for t in texts]


def test_quotes_words_escape(spark):
    assert many(spark, ["> a\n\n> b", "> a\nb"], X.is_quote_only) == [True, False]
    assert many(spark, [" a  b\tc ", ""], X.word_count) == [3, 0]
    assert many(spark, ["<a href='x'>&\"</a>"], X.html_escape) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;"]


def test_numbers(spark):
    assert many(spark, [-2.5, 2.5, 0.285], N.round_half_up, "double") == [-2.0, 3.0, 0.0]
    assert one(spark, N.round_half_up(F.lit(0.285), 2)) == 0.28
    assert many(spark, ["7", "x", None, "inf"], N.num_or_zero) == [7.0, 0.0, 0.0, 0.0]
    assert one(spark, N.format_rate(F.lit(1.47), F.lit(3.19))) == "$1.47 – $3.19/hr"
    assert one(spark, N.format_rate(F.lit(2.0), F.lit(2.005))) == "$2.00/hr"
    assert many(spark, [999, 3400, 1250000], N.format_views, "bigint") == ["999", "3.4K", "1.3M"]
    assert many(spark, [0.5, 0.1, 0.51, None], N.is_real_price, "double") == [False, False, True, False]
    assert one(spark, N.per_unit_price(F.lit(24.0), F.lit(4))) == 6.0
    assert one(spark, N.per_unit_price(F.lit(24.0), F.lit(0))) == 24.0


def test_dates(spark):
    assert many(spark, ["PT1H2M3S", "PT45S", "PT", "P1D", None], D.iso_duration_seconds) == [3723, 45, None, None, None]
    at = datetime(2026, 7, 10, 14)
    texts = ["2026-07-10T14:00:00Z", "Fri, 10 Jul 2026 14:00:00 GMT", "Fri, 10 Jul 2026 16:00:00 +0200", "soon"]
    assert many(spark, texts, D.parse_instant) == [at, at, at, None]
    ts = F.lit("2026-07-10 14:00:00").cast("timestamp")
    assert one(spark, D.short_date(ts)) == "JUL 10 2026"
    assert one(spark, D.needed_days(2, "2026-03-01 05:00:00")) == [date(2026, 3, 1), date(2026, 2, 28), date(2026, 2, 27)]
    ago = ["2026-07-10 13:59:40", "2026-07-10 13:20:00", "2026-07-10 09:00:00", "2026-07-07 14:00:00"]
    got = many(spark, ago, lambda c: D.time_ago(c.cast("timestamp"), "2026-07-10 14:00:00"))
    assert got == ["just now", "40 min ago", "5 h ago", "3 d ago"]


def test_fixed_values_are_consistent():
    assert set(V.CATEGORY_RULES) | {"general"} == set(V.CATEGORIES) == set(V.CATEGORY_WEIGHT)
    assert set(V.CONSEQUENCE_BY_CATEGORY) == set(V.CATEGORIES)
    assert set(V.CONSEQUENCE_BY_ACTION) == {a for a, _ in V.ACTION_RULES}
