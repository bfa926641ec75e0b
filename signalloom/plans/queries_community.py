"""Discussion, video and source-parsing queries over ``conversations``, ``pages``, ``documents``."""

from pyspark.sql import functions as F

from signalloom.functions.numbers import round_half_up
from signalloom.functions.text import is_quote_only  # noqa: F401
from signalloom.operators import classify as C
from signalloom.operators import community as K
from signalloom.operators import scoring as S
from signalloom.operators import videos as Vd
from signalloom.operators.rankings import scale_to_max, top_k
from signalloom.plans import sample as L
from signalloom.plans import tables as T
from signalloom.plans.registry import COMMENTS, clamp01, half_up, has, lit, query, tokens
from signalloom.session import written
from signalloom.sources import feeds, forums, media

MODELS = list(L.MATCHERS)


# ---- model mentions ---------------------------------------------------------
def _confidence(m):
    strong = " OR ".join(has("t", p) for p in m["strong"])
    ctx = has("t", L.CONTEXT)

    def part(name):
        return has("t", m[name]) if m.get(name) else "false"

    if m.get("ambiguous"):
        return f"CASE WHEN {strong} THEN 0.9 WHEN {part('base')} AND NOT {part('reject')} AND ({ctx} OR {part('org')}) THEN 0.6 ELSE 0 END::DOUBLE"
    gains = " + ".join(
        f"(CASE WHEN {c} THEN {g}::DOUBLE ELSE 0 END)" for c, g in [(part("org"), 0.15), (part("version"), 0.15), (part("product"), 0.1), (ctx, 0.05)]
    )
    return f"CASE WHEN {strong} THEN least(1.0, 0.55::DOUBLE + {gains}) ELSE 0 END::DOUBLE"


MENTIONS = f"""{COMMENTS}, tx AS (SELECT *, text AS t FROM comments),
  mentions AS ({" UNION ALL ".join(f"SELECT *, {lit(k)} AS model, {_confidence(m)} AS match_confidence FROM tx" for k, m in L.MATCHERS.items())}),
  valid AS (SELECT *, list_slice(list_filter([{", ".join(f"CASE WHEN {has('text', r)} THEN {lit(t)} END" for t, _, r in L.TOPICS)}], lambda x: x IS NOT NULL), 1, 2) AS topics
    FROM mentions WHERE match_confidence >= 0.5),
  themes AS (SELECT model, theme, count(*) AS n FROM (SELECT model, unnest(topics) AS theme FROM valid) GROUP BY ALL)"""


def validated(spark, d):
    found = C.match_models(T.comments(spark, d), "text", L.MATCHERS, L.CONTEXT)
    return K.with_topics(found, "text", L.TOPICS)


@query("match_model_mention", f"WITH {MENTIONS} SELECT comment_id, model, {half_up('match_confidence', 4)} AS match_confidence FROM valid")
def match_model_mention(spark, d):
    return C.match_models(T.comments(spark, d), "text", L.MATCHERS, L.CONTEXT).select(
        "comment_id", "model", round_half_up(F.col("match_confidence"), 4).alias("match_confidence")
    )


@query("theme_counts", f"WITH {MENTIONS} SELECT * FROM themes")
def theme_counts(spark, d):
    return K.theme_counts(validated(spark, d))


SPEC = f"""{MENTIONS}, totals AS (SELECT model, count(*) AS total FROM valid GROUP BY ALL),
  spec AS (SELECT comment_id, model, avg({clamp01("1.0 - n / CAST(total AS DOUBLE)")}) AS specificity
    FROM (SELECT comment_id, model, unnest(topics) AS theme FROM valid) JOIN themes USING (model, theme) JOIN totals USING (model) GROUP BY ALL)"""


@query("theme_specificity", f"WITH {SPEC} SELECT comment_id, model, {half_up('specificity', 6)} AS specificity FROM spec")
def theme_specificity(spark, d):
    spec = K.theme_specificities(validated(spark, d), ["comment_id"])
    return spec.select("comment_id", "model", round_half_up(F.col("specificity"), 6).alias("specificity"))


WORDS = "len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> ''))"
COMPLETE = f"""CASE WHEN trim(text) = '' THEN 0 ELSE {clamp01(f'''0.5::DOUBLE + (CASE WHEN {WORDS} >= 15 THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN {WORDS} >= 30 THEN 0.1::DOUBLE ELSE 0 END)
  + (CASE WHEN regexp_matches(trim(text), '[.!?]["'')\\]]?$') OR regexp_matches(text, '[.!?]["'')\\]]?\\s+[A-Z]') THEN 0.15::DOUBLE ELSE 0 END)
  - (CASE WHEN len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND NOT starts_with(trim(l), '>'))) = 0 THEN 0.4::DOUBLE ELSE 0 END)
  - (CASE WHEN length(trim(text)) < 40 THEN 0.3::DOUBLE ELSE 0 END)''')} END"""
RECENCY = clamp01(f"1.0 - (epoch_us(TIMESTAMP '{L.AS_OF}') - epoch_us(published_at)) / 1000000.0 / 3600.0 / 720.0")


@query("comment_completeness", f"WITH {COMMENTS} SELECT comment_id, {half_up(COMPLETE, 4)} AS completeness, {half_up(RECENCY, 6)} AS recency FROM comments")
def comment_completeness(spark, d):
    return T.comments(spark, d).select(
        "comment_id", round_half_up(S.comment_completeness(F.col("text")), 4).alias("completeness"),
        round_half_up(S.community_recency(F.col("published_at"), L.AS_OF), 6).alias("recency"),
    )


def _scored(spark, d):
    """Texts are matched once: weights, scores and picks read the rows that were found."""
    found = validated(spark, d).select("comment_id", "model", "match_confidence", "topics", "text", "published_at")
    return K.score_comments(written(found, "validated"), L.AS_OF)


@query("comment_relevance", f"""WITH {SPEC} SELECT comment_id, model, {half_up(f"0.40 * match_confidence + 0.25 * specificity + 0.20 * {COMPLETE} + 0.15 * {RECENCY}", 5)} AS relevance
  FROM valid JOIN spec USING (comment_id, model)""")
def comment_relevance(spark, d):
    return _scored(spark, d).select("comment_id", "model", round_half_up(F.col("relevance"), 5).alias("relevance"))


_ORDER = f"list_position([{', '.join(map(lit, MODELS))}], model)"
_ALIKE = "len(list_intersect(s.t, l.words)) / CAST(len(s.t) + len(l.words) - len(list_intersect(s.t, l.words)) AS DOUBLE)"
# line by line, best first: ``seen`` holds what a model shows already, ``used`` comments and ``topics`` that are taken
GREEDY = f"""walk AS (
    SELECT CAST(0 AS BIGINT) AS pos, CAST(NULL AS INTEGER) AS phase, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS n, false AS ok,
      CAST([] AS STRUCT(m VARCHAR, t VARCHAR[])[]) AS seen, CAST([] AS BIGINT[]) AS used, CAST([] AS VARCHAR[]) AS topics
    UNION ALL
    SELECT pos, phase, model, id, CAST(n0 + CASE WHEN good THEN 1 ELSE 0 END AS BIGINT), good,
      CASE WHEN good THEN list_append(seen, struct_pack(m := model, t := words)) ELSE seen END, CASE WHEN good THEN list_append(used, id) ELSE used END,
      CASE WHEN good AND topic IS NOT NULL THEN list_append(topics, topic) ELSE topics END
    FROM (SELECT *, n0 < k AND NOT list_contains(used, id) AND NOT coalesce(list_contains(topics, topic), false) AND near = 0 AS good
      FROM (SELECT l.*, w.seen, w.used, w.topics, CASE WHEN w.phase = l.phase AND w.model = l.model THEN w.n ELSE 0 END AS n0,
          len(list_filter(w.seen, lambda s: s.m = l.model AND len(s.t) > 0 AND len(l.words) > 0 AND {_ALIKE} > 0.6)) AS near
        FROM walk w JOIN line l ON l.pos = w.pos + 1) a) b)"""


def _relevance(valid, spec):
    """Validated rows with a topic and their relevance, to nine decimals."""
    return f"""SELECT model, comment_id AS id, {tokens('text')} AS words, round(0.40 * match_confidence + 0.25 * specificity + 0.20 * {COMPLETE} + 0.15 * {RECENCY}, 9) AS merit, published_at
  FROM {valid} JOIN {spec} USING (comment_id, model)"""


@query("representative_comments", f"""WITH RECURSIVE {SPEC}, ranked AS ({_relevance('valid', 'spec')}),
  line AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {_ORDER}, merit DESC, id DESC) AS pos, 1 AS phase, model, id, words, CAST(NULL AS VARCHAR) AS topic, 4 AS k FROM ranked),
  {GREEDY} SELECT model, CAST(n AS INTEGER) AS rank, id AS comment_id FROM walk WHERE ok""")
def representative_comments(spark, d):
    return K.representative_comments(_scored(spark, d), MODELS).select("model", "rank", "comment_id")


def _record(spark, d):
    """User turns are comments, assistant turns forum posts of their thread, system turns a board."""
    turns = T.comments(spark, d).select("comment_id", "conv_id", "role", "text", "published_at")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.pmod("conv_id", F.lit(len(MODELS))) + 1).cast("int")).alias("model")
    first_party = K.with_topics(turns.select("*", model, F.col("conv_id").alias("topic_id")), "text", L.TOPICS)
    validated = K.release_talk(turns.where("role = 'user'"), "text", L.MATCHERS, L.CONTEXT, L.TOPICS, L.RELEASE_TALK)
    return K.community_record(validated, MODELS, L.AS_OF, first_party.where("role = 'assistant'"), first_party.where("role = 'system'"))


_TOPICS = ", ".join(f"CASE WHEN {has('text', r)} THEN {lit(t)} END" for t, _, r in L.TOPICS)
_TOPIC_LIST = f"list_slice(list_filter([{_TOPICS}], lambda x: x IS NOT NULL), 1, 2)"
_OWN_MODEL = f"[{', '.join(map(lit, MODELS))}][conv_id % {len(MODELS)} + 1]"


@query("community_voices", f"""WITH RECURSIVE {MENTIONS}, rv AS (SELECT * FROM valid WHERE role = 'user' AND {has("text", L.RELEASE_TALK)}),
  rthemes AS (SELECT model, theme, count(*) AS n FROM (SELECT model, unnest(topics) AS theme FROM rv) GROUP BY ALL), rtotals AS (SELECT model, count(*) AS total FROM rv GROUP BY ALL),
  rspec AS (SELECT comment_id, model, avg({clamp01("1.0 - n / CAST(total AS DOUBLE)")}) AS specificity
    FROM (SELECT comment_id, model, unnest(topics) AS theme FROM rv) JOIN rthemes USING (model, theme) JOIN rtotals USING (model) GROUP BY ALL),
  ranked AS ({_relevance('rv', 'rspec')}),
  own AS (SELECT {_OWN_MODEL} AS model, comment_id AS id, {tokens('text')} AS words, epoch_us(published_at) AS merit, conv_id, role FROM comments WHERE role <> 'user' AND len({_TOPIC_LIST}) > 0),
  line AS MATERIALIZED (SELECT row_number() OVER (ORDER BY phase, {_ORDER}, merit DESC, id DESC) AS pos, * EXCLUDE (merit) FROM (
    SELECT 1 AS phase, model, id, words, CAST(merit AS DOUBLE) AS merit, CAST(NULL AS VARCHAR) AS topic, 4 AS k FROM ranked
    UNION ALL SELECT CASE WHEN role = 'assistant' THEN 2 ELSE 3 END, model, id, words, CAST(merit AS DOUBLE), CASE WHEN role = 'assistant' THEN model || '|' || conv_id END, 2 FROM own)),
  {GREEDY}, voices AS (SELECT model, ['comments', 'forum', 'board'][phase] AS source, n, id AS comment_id FROM walk WHERE ok)
  SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY n, list_position(['forum', 'board', 'comments'], source)) AS INTEGER) AS position, source, comment_id FROM voices""")
def community_voices(spark, d):
    return _record(spark, d)[1].select("model", "position", "source", "comment_id")


@query("community_themes", f"""WITH {MENTIONS} SELECT model, theme, count(*) AS n FROM (
    SELECT model, unnest(topics) AS theme FROM valid WHERE role = 'user' AND {has("text", L.RELEASE_TALK)}
    UNION ALL SELECT [{", ".join(map(lit, MODELS))}][conv_id % {len(MODELS)} + 1], unnest({_TOPIC_LIST}) FROM comments WHERE role IN ('assistant', 'system')) GROUP BY ALL""")
def community_themes(spark, d):
    return _record(spark, d)[0]


# ---- counts and coverage ----------------------------------------------------
SOURCES = """src AS (SELECT *, fetched_count * (1 + source) AS raw_hits, fetched_count AS sample_size FROM (SELECT role AS model, conv_id % 3 AS source,
    count(*) AS fetched_count, count(*) FILTER (length(text) > 300) AS validated_count FROM conversations GROUP BY ALL)),
  cov AS (SELECT *, greatest(0.0, least(1.0, fetched_count / CAST(raw_hits AS DOUBLE))) AS coverage FROM src),
  est AS (SELECT *, coverage < 1 AS is_estimated, CAST(CASE WHEN coverage >= 1 THEN validated_count ELSE floor(raw_hits * (validated_count / CAST(sample_size AS DOUBLE)) + 0.5) END AS BIGINT) AS relevant_discussions FROM cov)"""


def _coverage(spark, d):
    third = F.pmod("conv_id", F.lit(3))
    counts = T.table(spark, d, "conversations").groupBy(F.col("role").alias("model"), third.alias("source")).agg(
        F.count("*").alias("fetched_count"), F.count_if(F.length("text") > 300).alias("validated_count")
    )
    return K.story_coverage(
        counts.withColumns({"raw_hits": F.col("fetched_count") * (F.col("source") + 1), "sample_size": F.col("fetched_count")})
    )


@query("story_coverage", f"WITH {SOURCES} SELECT model, source, {half_up('coverage', 6)} AS coverage, is_estimated, relevant_discussions FROM est")
def story_coverage(spark, d):
    return _coverage(spark, d).select(
        "model", "source", round_half_up(F.col("coverage"), 6).alias("coverage"), "is_estimated", "relevant_discussions"
    )


@query("model_totals", f"WITH {SOURCES} SELECT model, CAST(sum(relevant_discussions) AS BIGINT) AS discussions, bool_or(is_estimated) AS is_estimated, sum(relevant_discussions) < 8 AS limited FROM est GROUP BY ALL")
def model_totals(spark, d):
    return K.model_totals(_coverage(spark, d).withColumnRenamed("relevant_discussions", "discussions"))


@query("models_by_volume", f"WITH {SOURCES}, t AS (SELECT model, CAST(sum(relevant_discussions) AS BIGINT) AS discussions FROM est GROUP BY ALL) SELECT model, discussions, {half_up('sqrt(discussions / CAST((SELECT max(discussions) FROM t) AS DOUBLE))', 6)} AS area FROM t")
def models_by_volume(spark, d):
    totals = K.model_totals(_coverage(spark, d).withColumnRenamed("relevant_discussions", "discussions"))
    sized = scale_to_max(totals.withColumn("all", F.lit(1)), "discussions", ["all"], "area", root=True)
    return sized.orderBy(F.desc("discussions"), "model").select(
        "model", "discussions", round_half_up(F.col("area"), 6).alias("area")
    )


@query("board_window_coverage", f"""WITH {COMMENTS} SELECT role, count(*) FILTER (published_at >= TIMESTAMP '2024-01-20 00:00:00') AS discussions,
  min(published_at) >= TIMESTAMP '2024-01-20 00:00:00' AS is_estimated FROM comments GROUP BY ALL""")
def board_window(spark, d):
    since = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return K.board_window(T.comments(spark, d), since, ["role"], "published_at")


@query("story_points_sum", "SELECT event_type AS model, sum(user_id)::BIGINT AS points FROM events GROUP BY ALL")
def story_points(spark, d):
    rows = T.table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("points"))
    return K.story_points(rows)


@query("top_threads", """SELECT event_type, event_id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 2""")
def top_threads(spark, d):
    return top_k(T.table(spark, d, "events"), 2, ["event_type"], F.desc("value"), F.col("event_id")).select(
        "event_type", "event_id", "rank"
    )


@query("paginate_sample", """WITH p AS (SELECT user_id AS query, CAST(date_part('day', ts) AS INTEGER) - 1 AS page, count(*) AS page_hits FROM events GROUP BY ALL),
  k AS (SELECT *, query % 90 + 20 AS nb_hits, page <> row_number() OVER (PARTITION BY query ORDER BY page) - 1 AS gap,
    page_hits < 2 OR sum(page_hits) OVER (PARTITION BY query ORDER BY page) >= query % 90 + 20 AS ends FROM p WHERE page < 31),
  u AS (SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY query ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS stopped FROM k)
  SELECT query, CAST(max(nb_hits) AS BIGINT) AS raw_hits, CAST(sum(page_hits) AS BIGINT) AS fetched_count FROM u WHERE NOT stopped AND NOT gap GROUP BY ALL""")
def paginate_sample(spark, d):
    """A page is a day of the month: users without an event on a day miss a page, quiet days are short, totals differ by user."""
    events = T.table(spark, d, "events")
    pages = events.groupBy(F.col("user_id").alias("query"), (F.dayofmonth("ts") - 1).alias("page")).agg(F.count("*").alias("page_hits"))
    return K.paginate(pages.withColumn("nb_hits", F.col("query") % 90 + 20), ["query"], 31, 2)


@query("interleave_sources", f"""WITH {COMMENTS}, r AS (SELECT conv_id, role, comment_id, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rank FROM comments)
  SELECT conv_id, comment_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY rank, list_position(['user', 'system', 'assistant'], role)) AS INTEGER) AS position FROM r""")
def interleave(spark, d):
    from pyspark.sql import Window

    lists = T.comments(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")))
    merged = K.interleave(lists, "conv_id", "role", "rank", ["user", "system", "assistant"])
    return merged.select("conv_id", "comment_id", "position")


@query("already_used_anti", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60)")
def already_used(spark, d):
    events = T.table(spark, d, "events")
    return K.unused(events.select("user_id").distinct(), events.where("event_type = 'error' AND value > 60"), "user_id")


# ---- videos -----------------------------------------------------------------
def _any(words):
    return "(" + " OR ".join(f"contains(lower(title || ' ' || d), {lit(w)})" for w in words) + ")"


VIDEOS = f"""vid AS (SELECT doc_id, 'v' || doc_id AS video_id, lang AS model, split_part(text, chr(10), 1) AS title, source AS d, n_chars % 700 AS duration,
    CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (doc_id * 7919) % 100003 END AS views FROM documents),
  ok AS (SELECT *, {_any(L.VIDEO_CONTEXT)} OR NOT {_any(L.VIDEO_OFF_TOPIC)} AS relevant FROM vid)"""


def _videos(spark, d):
    return T.spread(T.table(spark, d, "documents").select("doc_id", "lang", "text", "source")).select(
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id"), F.col("lang").alias("model"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("source").alias("description"),
    )


def _details(spark, d):
    key = F.col("doc_id")
    return T.table(spark, d, "documents").select(
        F.concat(F.lit("v"), key.cast("string")).alias("video_id"),
        F.when(F.pmod(key, F.lit(13)) != 0, F.pmod(key * 7919, F.lit(100003))).alias("view_count"),
        F.pmod("n_chars", F.lit(700)).alias("duration_s"),
    )


@query("filter_ai_relevant", f"WITH {VIDEOS} SELECT video_id FROM ok WHERE relevant")
def filter_relevant(spark, d):
    keep = Vd.is_relevant(F.col("title"), F.col("description"), L.VIDEO_CONTEXT, L.VIDEO_OFF_TOPIC)
    return _videos(spark, d).where(keep).select("video_id")


@query("filter_shorts", f"WITH {VIDEOS} SELECT video_id FROM vid WHERE duration > 180")
def filter_shorts(spark, d):
    return _details(spark, d).where(~Vd.is_short(F.col("duration_s"))).select("video_id")


_LETTERS = "len(regexp_extract_all(text, '[" + "".join(f"\\p{{{s}}}" for s in ("Han", "Cyrillic", "Greek", "Arabic", "Thai")) + "]'))"


@query("filter_english", f"SELECT doc_id FROM documents WHERE {_LETTERS} = 0 OR len(regexp_extract_all(text, '\\p{{Latin}}')) >= {_LETTERS}")
def filter_english(spark, d):
    return T.table(spark, d, "documents").where(Vd.is_likely_english(F.col("text"))).select("doc_id")


@query("merge_video_details", f"WITH {VIDEOS} SELECT video_id, CAST(coalesce(views, -1) AS BIGINT) AS view_count, duration AS duration_s FROM vid")
def merge_details(spark, d):
    return Vd.merge_details(_videos(spark, d), _details(spark, d)).select(
        "video_id", F.coalesce("view_count", F.lit(-1)).cast("bigint").alias("view_count"), "duration_s"
    )


@query("top_videos", """WITH vid AS (SELECT 'v' || doc_id AS video_id, lang AS model, lower(split_part(text, chr(10), 1) || ' ' || source) AS t, n_chars % 700 AS duration,
    CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (doc_id * 7919) % 100003 END AS views FROM documents)
  SELECT model, video_id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY views DESC NULLS LAST, video_id) AS rn FROM vid
    WHERE duration > 180 AND NOT regexp_matches(t, '(horoscope|zodiac|astrology|tarot|star sign|birth chart)')) WHERE rn <= 5""")
def top_videos(spark, d):
    return Vd.top_videos(_videos(spark, d), _details(spark, d)).select("model", "video_id", "rank")


@query("parse_video_search", f"WITH {VIDEOS} SELECT video_id, model, title, 'https://www.youtube.com/watch?v=' || video_id AS url FROM vid")
def parse_video_search(spark, d):
    item = F.struct(
        F.struct(F.col("video_id").alias("videoId")).alias("id"),
        F.struct("title", "description", F.lit("2024-01-01T00:00:00Z").alias("publishedAt")).alias("snippet"),
    )
    bodies = _videos(spark, d).select("model", F.to_json(F.struct(F.array(item).alias("items"))).alias("body"))
    return media.parse_video_search(bodies).select("video_id", "model", "title", "url")


@query("parse_video_details", f"WITH {VIDEOS} SELECT video_id, CAST(coalesce(views, -1) AS BIGINT) AS view_count, CASE WHEN duration % 5 = 0 THEN -1 ELSE duration END AS duration_s FROM vid")
def parse_video_details(spark, d):
    s = F.col("duration_s")
    text = F.when(F.pmod(s, F.lit(5)) == 0, F.lit("soon")).otherwise(
        F.concat(F.lit("PT"), F.floor(s / 60).cast("string"), F.lit("M"), F.pmod(s, F.lit(60)).cast("string"), F.lit("S"))
    )
    item = F.struct(
        F.col("video_id").alias("id"), F.struct(F.col("view_count").cast("string").alias("viewCount")).alias("statistics"),
        F.struct(text.alias("duration")).alias("contentDetails"),
    )
    bodies = _details(spark, d).select(F.to_json(F.struct(F.array(item).alias("items"))).alias("body"))
    return media.parse_video_details(bodies).select(
        "video_id", F.coalesce("view_count", F.lit(-1)).cast("bigint").alias("view_count"),
        F.coalesce("duration_s", F.lit(-1)).cast("bigint").alias("duration_s"),
    )


# ---- landed responses -------------------------------------------------------
@query("parse_price_bars", """SELECT n_name AS ticker, CAST(o_orderdate AS DATE) AS "date", max(o_totalprice) AS close FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL HAVING max(o_totalprice) > 100000""")
def parse_price_bars(spark, d):
    bars = T.bars(spark, d)
    close = F.when(F.col("high") > 100000, F.col("high"))
    per_bar = F.sort_array(F.collect_list(F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("ts"), close.alias("c"), "open", "low")))
    arrays = bars.groupBy("ticker").agg(per_bar.alias("b"))
    quote = F.struct(F.col("b.open").alias("open"), F.col("b.c").alias("high"), F.col("b.low").alias("low"), F.col("b.c").alias("close"))
    result = F.struct(F.col("b.ts").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    chart = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    # nulls inside the arrays have to be kept
    body = F.to_json(chart, {"ignoreNullFields": "false"})
    return media.parse_price_bars(arrays.select("ticker", body.alias("body"))).select("ticker", "date", "close")


@query("parse_offers", """SELECT p_brand AS alias, count(*) AS n, sum(l_quantity)::BIGINT AS units FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def parse_offers(spark, d):
    offers = T.offers(spark, d).select(
        F.col("alias").alias("gpu_name"), F.col("units").cast("int").alias("num_gpus"), F.col("price").alias("dph_total")
    )
    bodies = offers.select(F.to_json(F.struct(F.array(F.struct("*")).alias("offers"))).alias("body"))
    return media.parse_bundle_offers(bodies).groupBy(F.col("gpu_name").alias("alias")).agg(
        F.count("*").alias("n"), F.sum("num_gpus").alias("units")
    )


@query("parse_forum_search", f"""WITH {COMMENTS} SELECT conv_id AS topic_id, turn AS post_id, coalesce(nullif(role, 'system'), 'member') AS username,
  'https://f.example/t/' || CASE WHEN conv_id % 4 = 0 THEN '' ELSE 'c' || conv_id || '/' END || conv_id AS url FROM comments WHERE published_at >= TIMESTAMP '2024-01-10 00:00:00'""")
def parse_forum(spark, d):
    rows = T.comments(spark, d)
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    slug = F.when(F.pmod("conv_id", F.lit(4)) != 0, F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    topic = F.struct(F.col("conv_id").alias("id"), F.lit("t").alias("title"), slug.alias("slug"), at.alias("created_at"))
    name = F.when(F.col("role") != "system", F.col("role"))
    post = F.struct(F.col("turn").alias("id"), name.alias("username"), F.lit("b").alias("blurb"), at.alias("created_at"), F.col("conv_id").alias("topic_id"))
    doc = F.struct(F.array(topic).alias("topics"), F.array(post).alias("posts"))
    bodies = rows.select(F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("model"), F.lit("https://f.example/").alias("base"), F.to_json(doc).alias("body"))
    _, posts, _ = forums.parse_forum(bodies, F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return posts.select("topic_id", "post_id", "username", "url")


@query("parse_forum_topics", f"""WITH {COMMENTS} SELECT comment_id, conv_id AS topic_id, 'topic ' || turn AS title,
  'https://f.example/t/' || CASE WHEN turn % 3 = 0 THEN '' ELSE 's' || turn || '/' END || conv_id AS url, CAST(CASE WHEN turn % 3 = 1 THEN 0 ELSE conv_id + turn END AS BIGINT) AS views,
  published_at AS last_posted_at, turn % 2 = 0 AS more FROM comments WHERE published_at >= TIMESTAMP '2024-01-10 00:00:00' AND turn % 4 <> 3""")
def parse_forum_topics(spark, d):
    """A response per comment: topics without title drop out, view counts that are no numbers are 0, and whether there are more pages."""
    rows = T.comments(spark, d)
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    title = F.when(F.pmod("turn", F.lit(4)) != 3, F.concat(F.lit("topic "), F.col("turn").cast("string")))
    slug = F.when(F.pmod("turn", F.lit(3)) != 0, F.concat(F.lit("s"), F.col("turn").cast("string")))
    views = F.when(F.pmod("turn", F.lit(3)) == 1, F.lit("many")).otherwise((F.col("conv_id") + F.col("turn")).cast("string"))
    topic = F.struct(F.col("conv_id").alias("id"), title.alias("title"), slug.alias("slug"), at.alias("created_at"), views.alias("views"))
    result = F.struct((F.pmod("turn", F.lit(2)) == 0).alias("more_full_page_results"))
    doc = F.struct(F.array(topic).alias("topics"), F.when(F.pmod("turn", F.lit(2)) == 0, result).alias("grouped_search_result"))
    bodies = rows.select(F.col("comment_id").cast("string").alias("model"), F.lit("https://f.example/").alias("base"), F.to_json(doc).alias("body"))
    topics, _, more = forums.parse_forum(bodies, F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return topics.join(more.select("model", "more"), "model").select(
        F.col("model").cast("bigint").alias("comment_id"), "topic_id", "title", "url", "views", "last_posted_at", "more"
    )


@query("parse_board_discussions", """SELECT conv_id, count(*) FILTER (turn % 5 <> 4) AS discussions, bool_and(turn % 5 <> 4) AS all_ok FROM conversations GROUP BY ALL""")
def parse_board(spark, d):
    rows = T.comments(spark, d)
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    node = F.struct(F.col("comment_id").cast("string").alias("id"), F.lit("t").alias("title"), at.alias("createdAt"), F.col("text").alias("bodyText"))
    repository = F.struct(F.struct(F.array(node).alias("nodes")).alias("discussions")).alias("repository")
    failed = F.when(F.pmod("turn", F.lit(5)) == 4, F.array(F.struct(F.lit("refused").alias("message"))))
    body = F.to_json(F.struct(F.struct(repository).alias("data"), failed.alias("errors")))
    responses = rows.select(F.col("conv_id").cast("string").alias("model"), F.lit("o/n").alias("repo"), body.alias("body"))
    found, status = forums.parse_board(responses)
    oks = status.groupBy("model").agg(F.bool_and("ok").alias("all_ok"))
    counts = found.groupBy("model").agg(F.count("*").alias("n"))
    return oks.join(counts, "model", "left").select(
        F.col("model").cast("bigint").alias("conv_id"), F.coalesce("n", F.lit(0)).alias("discussions"), "all_ok"
    )


def _feed_documents(spark, d):
    pages = T.table(spark, d, "pages")
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    item = F.concat(
        F.lit("<rss><channel><item><title><![CDATA["), title, F.lit(" - Site"), F.col("page_id").cast("string"),
        F.lit("]]></title><link>"), F.col("url"), F.lit("</link><pubDate>Fri, 05 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>"),
    )
    return pages.select("page_id", F.lit("feed").alias("source_name"), item.alias("xml"))


_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
_DECODED = f"trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace({_TITLE}, '&#39;', ''''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))"
_URL = "trim(regexp_replace(replace(replace(replace(url, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))"


@query("parse_feed", f"SELECT page_id, {_DECODED} || ' - Site' || page_id AS title, {_URL} AS link, TIMESTAMP '2024-01-05 10:00:00' AS published_at FROM pages")
def parse_feed(spark, d):
    items = feeds.parse_feed(_feed_documents(spark, d), L.AS_OF, carry=("page_id", "source_name"))
    return items.select("page_id", "title", "link", "published_at")


@query("split_publisher_suffix", f"SELECT page_id, {_DECODED} AS title, 'Site' || page_id AS source_name FROM pages")
def split_publisher(spark, d):
    items = feeds.parse_feed(_feed_documents(spark, d), L.AS_OF, carry=("page_id", "source_name"))
    return feeds.split_publisher(items, F.lit(True)).select("page_id", "title", "source_name")


@query("feed_gate_video", f"""SELECT doc_id FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 1) || ' ' || text AS t FROM documents)
  WHERE doc_id % 2 = 0 OR ((({" OR ".join(has('t', r) for _, r in L.LABS)})) AND NOT regexp_matches(title, '(?i)^\\s*(how|why|what|when|who|is|are|does|did|should|could|would|will|can|has|have)\\b') AND {has('t', L.SHIPPING)})""")
def video_gate(spark, d):
    odd = F.pmod("doc_id", F.lit(2)) == 1
    return feeds.video_gate(T.items(spark, d), odd, L.LABS, L.SHIPPING).select("doc_id")
