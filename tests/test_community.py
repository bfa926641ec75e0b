import random
from datetime import datetime

import brute
from pyspark.sql import functions as F

from signalloom.operators import community as K
from signalloom.operators import videos as Vd
from signalloom.operators.history import merge_today
from signalloom.sources import feeds, forums, media


def coverage(spark, raw, fetched, validated, sample):
    df = spark.createDataFrame([(raw, fetched, validated, sample)], "raw_hits int, fetched_count int, validated_count int, sample_size int")
    r = K.story_coverage(df).first()
    return r["coverage"], r["is_estimated"], r["relevant_discussions"]


def test_coverage(spark):
    assert coverage(spark, 42, 42, 30, 42) == (1.0, False, 30)
    assert coverage(spark, 900, 300, 60, 300)[1:] == (True, 180)
    assert coverage(spark, 0, 0, 0, 0) == (1.0, False, 0)
    assert coverage(spark, 10, 50, 40, 50) == (1.0, False, 40)


def _greedy(rows, models, k):
    used, out = set(), []
    for m in models:
        texts = []
        for _, c, text in sorted(((s, c, t) for mm, c, t, s in rows if mm == m), reverse=True):
            a = brute.tokens(text)
            near = any(a and b and len(a & b) / len(a | b) > 0.6 for b in texts)
            if c in used or near or len(texts) == k:
                continue
            texts.append(a)
            used.add(c)
            out.append((m, c, len(texts)))
    return sorted(out)


def test_picks_equal_the_greedy_reading(spark):
    rnd = random.Random(11)
    words = [f"word{i}" for i in range(12)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(2, 6))) for _ in range(30)]
    rows = [(m, c, texts[c % 30], round(rnd.random(), 6)) for c in range(80) for m in ("a", "b", "c") if rnd.random() < 0.6]
    df = spark.createDataFrame(rows, "model string, comment_id bigint, text string, relevance double")
    got = K.representative_comments(df, ["a", "b", "c"]).select("model", "comment_id", "rank").collect()
    assert sorted(map(tuple, got)) == _greedy(rows, ["a", "b", "c"], 4)


def test_forum_posts_one_per_topic(spark):
    rows = [("a", i, f"text number{i} alpha{i}", i // 3, datetime(2026, 1, 1 + i)) for i in range(6)]
    df = spark.createDataFrame(rows, "model string, post_id bigint, text string, topic_id bigint, published_at timestamp")
    picks = K.newest_per_topic(df, ["a"], [("a", 1, ["text", "number5", "alpha5"], 0)])
    assert [(m, i) for m, i, _, _ in picks] == [("a", 4), ("a", 2)]


def test_videos(spark):
    rows = [
        ("m", "v1", "Horoscope for Gemini", "your stars"), ("m", "v2", "Long talk", "model review"),
        ("m", "v3", "Short clip", "model"), ("m", "v4", "новости дня", "model"), ("m", "v5", "Other talk", "agent"), ("m", "v6", "Unknown", "app"),
    ]
    videos = spark.createDataFrame(rows, "model string, video_id string, title string, description string")
    details = spark.createDataFrame([("v1", 900, 999), ("v2", 50, 600), ("v3", 800, 30), ("v4", 700, 600), ("v5", 70, 600)], "video_id string, view_count bigint, duration_s bigint")
    got = Vd.top_videos(videos, details).orderBy("rank").collect()
    assert [(r["video_id"], r["view_count"]) for r in got] == [("v5", 70), ("v2", 50), ("v6", None)]


def test_keep_previous(spark):
    new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    old = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "k string, v int")
    failed = spark.createDataFrame([("b",)], "k string")
    assert sorted(map(tuple, Vd.keep_previous(new, old, "k", failed).collect())) == [("a", 1), ("b", 0), ("c", 0)]


def test_merge_today(spark):
    old = spark.createDataFrame([("c1", 1), ("c2", 1)], "cluster_id string, v int")
    new = spark.createDataFrame([("c2", 2), ("c3", 2)], "cluster_id string, v int")
    assert sorted(map(tuple, merge_today(old, new).collect())) == [("c1", 1), ("c2", 2), ("c3", 2)]


def test_feed_rss_and_atom(spark):
    rss = "<rss><item><title>Big - News &amp; more - Daily</title><link> https://a </link><pubDate>Fri, 10 Jul 2026 14:00:00 GMT</pubDate><description>&lt;b&gt;bold&lt;/b&gt; text</description></item><item><title>no link</title></item></rss>"
    atom = '<feed><entry><title>T2</title><link rel="alternate" href="https://b"/><updated>bad</updated><summary>s</summary></entry></feed>'
    docs = spark.createDataFrame([("S", rss), ("S", atom)], "source_name string, xml string")
    items = feeds.parse_feed(docs, "2026-07-11 00:00:00")
    got = [tuple(r) for r in items.select("title", "link", "desc", "published_at").orderBy("link").collect()]
    assert got == [
        ("Big - News & more - Daily", "https://a", "bold text", datetime(2026, 7, 10, 14)),
        ("T2", "https://b", "s", datetime(2026, 7, 11)),
    ]
    split = feeds.split_publisher(items, F.lit(True)).orderBy("link").first()
    assert (split["title"], split["source_name"], split["desc"]) == ("Big - News & more", "Daily", "")


def test_forum_and_board(spark):
    body = '{"topics":[{"id":1,"title":"T","slug":"t-one","created_at":"2026-07-01T00:00:00Z","views":"x"},{"id":2,"title":null}],"posts":[{"id":9,"blurb":"b","created_at":"2026-07-02T00:00:00Z","topic_id":1},{"id":10,"blurb":"b","created_at":"2026-07-02T00:00:00Z","topic_id":7},{"id":11,"blurb":"old","created_at":"2026-01-02T00:00:00Z","topic_id":1}],"grouped_search_result":{"more_full_page_results":true}}'
    responses = spark.createDataFrame([("m", "https://f/", body)], "model string, base string, body string")
    topics, posts, more = forums.parse_forum(responses, F.lit("2026-06-01").cast("timestamp"))
    assert [(r["url"], r["views"]) for r in topics.collect()] == [("https://f/t/t-one/1", 0)]
    assert sorted((r["post_id"], r["username"], r["url"]) for r in posts.collect()) == [(9, "member", "https://f/t/t-one/1"), (10, "member", "https://f/t/7")]
    assert more.first()["more"] is True
    boards = spark.createDataFrame([
        ("a", "o/r", '{"data":{"repository":{"discussions":{"nodes":[{"id":"1","title":"x","createdAt":"2026-07-01T00:00:00Z"},{"id":"2"}]}}}}'),
        ("b", "o/r", '{"errors":[{"message":"m1"},{"message":"m2"}]}'), ("c", "o/r", '{"data":{"repository":null}}'),
    ], "model string, repo string, body string")
    found, status = forums.parse_board(boards)
    assert [(r["id"], r["author"], r["url"]) for r in found.collect()] == [("1", "member", "https://github.com/o/r/discussions")]
    assert {r["model"]: (r["ok"], r["error"]) for r in status.collect()} == {"a": (True, None), "b": (False, "m1; m2"), "c": (False, "no discussions data")}


def test_price_bars(spark):
    body = '{"chart":{"result":[{"timestamp":[86400,172800],"meta":{"regularMarketPrice":5.0},"indicators":{"quote":[{"close":[1.5,null],"open":[1,2],"high":[2,2],"low":[1,1],"volume":[7,8]}]}}]}}'
    df = spark.createDataFrame([("T", body)], "ticker string, body string")
    assert [(str(r["date"]), r["close"], r["volume"]) for r in media.parse_price_bars(df).collect()] == [("1970-01-02", 1.5, 7)]
    assert media.parse_live_prices(df).first()["live_price"] == 5.0
