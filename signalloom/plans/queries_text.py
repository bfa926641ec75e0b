"""Text, classification, similarity, scoring and section queries over ``documents``."""

from pyspark.sql import functions as F

from signalloom.functions import dates as D
from signalloom.functions import numbers as N
from signalloom.functions import text as X
from signalloom.functions.numbers import round_half_up
from signalloom.operators import classify as C
from signalloom.operators import entities as E
from signalloom.operators import scoring as S
from signalloom.operators import sections as P
from signalloom.operators import similarity as Y
from signalloom import fixed_values as V
from signalloom.plans import sample as L
from signalloom.plans import tables as T
from signalloom.session import written
from signalloom.plans.registry import COMMENTS, ITEMS, clamp01, first_match, half_up, has, lit, nouns, phrases, query, tokens

AS_OF = f"TIMESTAMP '{L.AS_OF}'"


def both_texts():
    return X.headline_text(F.col("title"), F.col("desc"))


def joined(column):
    return F.array_join(F.sort_array(column), ",")


# ---- scalars ----------------------------------------------------------------
@query("normalize_title", """SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents""")
def normalize_title(spark, d):
    return T.items(spark, d).select("doc_id", X.normalize_title(F.col("desc")).alias("norm"))


@query("token_set", f"SELECT doc_id, list_aggregate(list_sort({tokens('text')}), 'string_agg', ',') AS tokens, len({tokens('text')}) AS n FROM documents WHERE len({tokens('text')}) > 0")
def token_set(spark, d):
    sets = T.items(spark, d).select("doc_id", X.token_set(F.col("desc")).alias("t")).where(F.size("t") > 0)
    return sets.select("doc_id", joined("t").alias("tokens"), F.size("t").cast("bigint").alias("n"))


@query("doc_freq", f"""WITH {ITEMS}, t AS (SELECT unnest({tokens('title')}) AS token FROM items UNION ALL SELECT unnest({tokens('descr')}) FROM items)
  SELECT token, count(*) AS df FROM t GROUP BY ALL""")
def doc_freq(spark, d):
    return Y.doc_freq(T.items(spark, d), "title", "desc")


@query("idf", f"""WITH {ITEMS}, t AS (SELECT unnest({tokens('title')}) AS token FROM items UNION ALL SELECT unnest({tokens('descr')}) FROM items),
  f AS (SELECT token, count(*) AS df FROM t GROUP BY ALL)
  SELECT token, {half_up("ln(((SELECT count(*) FROM items) + 1) / (df + 0.5)) + 1", 6)} AS idf FROM f""")
def idf(spark, d):
    items = T.items(spark, d)
    weight = Y.idf(F.col("df"), F.col("n"))
    freq = Y.doc_freq(items, "title", "desc").join(F.broadcast(items.agg(F.count("*").alias("n"))))
    return freq.select("token", round_half_up(weight, 6).alias("idf"))


@query("stable_id", """SELECT page_id, lower(to_base(list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS HUGEINT))),
   lambda h, u: (xor(h, u) * 16777619) & 4294967295)::BIGINT, 36)) AS id FROM pages""")
def stable_id(spark, d):
    return T.table(spark, d, "pages").select("page_id", X.stable_id(F.col("url")).alias("id"))


_ENT = "regexp_extract(html, '<title>(.*?)</title>', 1)"


@query("decode_entities", f"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace({_ENT}, '&#39;', ''''),
  '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS title FROM pages""")
def decode_entities(spark, d):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return T.table(spark, d, "pages").select("page_id", X.decode_entities(title).alias("title"))


@query("truncate", f"WITH {ITEMS} SELECT doc_id, CASE WHEN length(title) > 60 THEN rtrim(substr(title, 1, 59)) || '…' ELSE title END AS headline FROM items")
def truncate(spark, d):
    return T.items(spark, d).select("doc_id", X.truncate(F.col("title"), 60).alias("headline"))


@query("word_count", """SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS words,
  len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND NOT starts_with(trim(l), '>'))) = 0 AS quote_only FROM documents""")
def word_count(spark, d):
    return T.items(spark, d).select(
        "doc_id", X.word_count(F.col("desc")).alias("words"), X.is_quote_only(F.col("desc")).alias("quote_only")
    )


@query("html_escape", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM pages""")
def html_escape(spark, d):
    return T.table(spark, d, "pages").select("page_id", X.html_escape(F.col("html")).alias("html"))


EXCERPT = f"""WITH {ITEMS}, t AS (SELECT doc_id, {{clean}} AS t FROM items),
  f AS (SELECT doc_id, t, strpos(lower(t), 'thre') - 1 AS hit FROM t),
  s AS (SELECT doc_id, t, CASE WHEN hit > 90 THEN hit - 62 ELSE 0 END AS start FROM f),
  g AS (SELECT *, strpos(substr(t, start + 1, 180), ' ') - 1 AS gap FROM s),
  h AS (SELECT *, CASE WHEN start > 0 AND gap > 0 AND gap < 25 THEN gap + 1 ELSE 0 END AS skip FROM g),
  b AS (SELECT *, substr(t, start + 1 + skip, 180 - skip) AS head FROM h),
  l AS (SELECT *, length(head) - strpos(reverse(head), ' ') AS gap_at FROM b)
  SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE (CASE WHEN start > 0 THEN '…' ELSE '' END)
    || rtrim(CASE WHEN strpos(head, ' ') > 0 AND gap_at > 108 THEN substr(head, 1, gap_at) ELSE head END) || '…' END AS excerpt FROM l"""


@query("excerpt", EXCERPT.replace("{clean}", "trim(regexp_replace(regexp_replace(descr, '<[^>]+>', '', 'g'), '[\\s]+', ' ', 'g'))"))
def excerpt(spark, d):
    return T.items(spark, d).select("doc_id", X.excerpt(F.col("desc"), 180, "thre").alias("excerpt"))


@query("dates", f"""WITH {ITEMS} SELECT doc_id, upper(strftime(published_at, '%b %d %Y')) AS short_date, CAST(published_at AS DATE) AS day,
  CASE WHEN h < 24 THEN (CASE WHEN h = 0 THEN 'just now' ELSE h || ' h ago' END) ELSE CAST(floor(h / 24.0 + 0.5) AS INTEGER) || ' d ago' END AS ago,
  CASE WHEN h < 1 THEN 'fresh' WHEN h < 24 THEN 'recent' ELSE 'old' END AS freshness
  FROM (SELECT *, date_diff('hour', published_at, {AS_OF}) AS h FROM items)""")
def dates(spark, d):
    at = F.col("published_at")
    return T.items(spark, d).select(
        "doc_id", D.short_date(at).alias("short_date"), D.day_key(at).alias("day"),
        D.time_ago(at, L.AS_OF).alias("ago"), D.freshness_class(at, L.AS_OF).alias("freshness"),
    )


@query("iso_duration_seconds", """SELECT doc_id, CASE WHEN n_chars % 11 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS seconds FROM documents""")
def iso_duration(spark, d):
    n = F.col("n_chars")
    text = F.concat(
        F.lit("PT"), F.when(n >= 3600, F.concat(F.floor(n / 3600).cast("string"), F.lit("H"))).otherwise(F.lit("")),
        F.floor(F.pmod(n, F.lit(3600)) / 60).cast("string"), F.lit("M"), F.pmod(n, F.lit(60)).cast("string"), F.lit("S"),
    )
    broken = F.when(F.pmod(n, F.lit(11)) == 0, F.lit("P1D")).otherwise(text)
    return T.table(spark, d, "documents").select("doc_id", D.iso_duration_seconds(broken).cast("double").alias("seconds"))


@query("normalize_iso", """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate AS at FROM lineitem""")
def normalize_iso(spark, d):
    at = F.col("l_shipdate")
    text = F.when(F.pmod("l_orderkey", F.lit(2)) == 0, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    return T.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", D.parse_instant(text).alias("at")
    )


@query("numbers", f"""SELECT c_custkey, {half_up("c_acctbal", 0)} AS rounded, {clamp01("c_acctbal / 5000")} AS clamped,
  CASE WHEN c_custkey * 997 >= 1000000 THEN printf('%.1fM', {half_up('c_custkey * 997 / 1000000.0', 1)}) WHEN c_custkey * 997 >= 1000 THEN printf('%.1fK', {half_up('c_custkey * 997 / 1000.0', 1)})
  ELSE CAST(c_custkey * 997 AS VARCHAR) END AS views, coalesce(TRY_CAST(substr(c_name, 10, 9) AS DOUBLE), 0) AS num FROM customer""")
def numbers(spark, d):
    return T.table(spark, d, "customer").select(
        "c_custkey", N.round_half_up(F.col("c_acctbal")).alias("rounded"),
        N.clamp(F.col("c_acctbal") / 5000, 0.0, 1.0).alias("clamped"),
        N.format_views(F.col("c_custkey") * 997).alias("views"),
        N.num_or_zero(F.substring("c_name", 10, 9)).alias("num"),
    )


@query("needed_days", "SELECT DISTINCT o_orderkey, unnest(generate_series(CAST(o_orderdate AS DATE) - 2, CAST(o_orderdate AS DATE), INTERVAL 1 DAY))::DATE AS day FROM orders")
def needed_days(spark, d):
    return T.table(spark, d, "orders").select("o_orderkey", F.explode(D.needed_days(2, F.col("o_orderdate"))).alias("day"))


# ---- classification ---------------------------------------------------------
NAMES = list(L.CATEGORIES)
_TOTALS = ", ".join(
    "(" + " + ".join(f"CASE WHEN {has('btxt', p)} THEN {float(w)} ELSE 0 END" for p, w in L.CATEGORIES[n]) + ")::DOUBLE" for n in NAMES
)
CATEGORISED = f"""{ITEMS}, tot AS (SELECT *, [{_TOTALS}] AS totals FROM items),
  rk AS (SELECT *, list_reverse_sort(totals) AS r FROM tot),
  cat AS (SELECT doc_id, title, descr, btxt, published_at, link, source_name,
    CASE WHEN r[1] < 1.5 THEN 'general' ELSE ([{", ".join(lit(n) for n in NAMES)}])[list_position(totals, r[1])] END AS category,
    CASE WHEN r[1] < 1.5 THEN 0.3::DOUBLE ELSE {half_up("greatest(0, least(1, r[1] / (r[1] + r[2] + 1)))", 2)} END AS cat_confidence FROM rk)"""
FAMILY = "CASE WHEN category = 'research' THEN 'research' WHEN category IN ('market', 'capital', 'compute', 'policy', 'orggov') THEN 'market' ELSE 'product' END"


def categorised(spark, d):
    return C.categorize(T.items(spark, d), L.CATEGORIES)


@query("categorize", f"WITH {CATEGORISED} SELECT doc_id, category, cat_confidence FROM cat")
def categorize(spark, d):
    return categorised(spark, d).select("doc_id", "category", "cat_confidence")


@query("wave_family", f"WITH {CATEGORISED} SELECT {FAMILY} AS family, count(*) AS n FROM cat GROUP BY ALL")
def wave_family(spark, d):
    return categorised(spark, d).groupBy(C.wave_family(F.col("category")).alias("family")).agg(F.count("*").alias("n"))


@query("extract_action", f"WITH {ITEMS} SELECT doc_id, coalesce({first_match('btxt', L.ACTIONS)}, 'none') AS action FROM items")
def extract_action(spark, d):
    return T.items(spark, d).select("doc_id", F.coalesce(C.extract_action(both_texts(), L.ACTIONS), F.lit("none")).alias("action"))


@query("classify_topics", f"""WITH {COMMENTS} SELECT comment_id, concat_ws(',', {", ".join(f"CASE WHEN {has('text', r)} THEN {lit(t)} END" for t, _, r in L.TOPICS)}) AS topics FROM comments""")
def classify_topics(spark, d):
    return T.comments(spark, d).select("comment_id", F.array_join(C.classify_topics(F.col("text"), L.TOPICS), ",").alias("topics"))


@query("detect_lab", f"WITH {ITEMS} SELECT coalesce({first_match('btxt', L.LABS)}, 'none') AS lab, count(*) AS n FROM items GROUP BY ALL")
def detect_lab(spark, d):
    lab = F.coalesce(C.detect_lab(both_texts(), L.LABS), F.lit("none"))
    return T.items(spark, d).groupBy(lab.alias("lab")).agg(F.count("*").alias("n"))


@query("detect_license", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\bapache(\s*2(\.0)?)?\b') THEN 'apache' WHEN regexp_matches(text, '(?i)\bmit licen[cs]e\b') THEN 'mit'
  WHEN regexp_matches(text, '(?i)\bopen.?weight|open.?source|weights (are|now)? ?(public|available|released)\b') THEN 'open weights'
  WHEN regexp_matches(text, '(?i)\bhugging ?face\b') THEN 'open weights' ELSE 'see model card' END AS license FROM documents""")
def detect_license(spark, d):
    return T.items(spark, d).select("doc_id", C.detect_license(F.col("desc"))["lic"].alias("license"))


@query("infer_field", f"WITH {ITEMS} SELECT doc_id, {first_match('btxt', L.FIELDS, lit('Research'))} AS field FROM items")
def infer_field(spark, d):
    return T.items(spark, d).select("doc_id", C.infer_field(both_texts(), L.FIELDS).alias("field"))


@query("is_product_release", f"""WITH {ITEMS} SELECT doc_id, NOT {has("title", L.QUESTION)} AND {has("btxt", L.SHIPPING)} AS is_release, {has("btxt", L.RELEASE_TALK)} AS is_talk FROM items""")
def is_product_release(spark, d):
    return T.items(spark, d).select(
        "doc_id", C.is_product_release(F.col("title"), F.col("desc"), L.SHIPPING, L.QUESTION).alias("is_release"),
        C.is_release_discussion(both_texts(), L.RELEASE_TALK).alias("is_talk"),
    )


@query("salient_objects", f"""WITH {ITEMS} SELECT doc_id, coalesce(list_aggregate(list_sort(list_distinct(list_concat(list_concat({phrases('title')}, {nouns('btxt', L.STRONG)}), {nouns('btxt', L.WEAK)}))), 'string_agg', ','), '') AS salient,
  coalesce(list_aggregate(list_sort(list_distinct(list_concat({phrases('title')}, {nouns('btxt', L.STRONG)}))), 'string_agg', ','), '') AS distinctive FROM items""")
def salient_objects(spark, d):
    return T.items(spark, d).select(
        "doc_id", joined(C.salient_objects(F.col("title"), F.col("desc"), L.STRONG, L.WEAK)).alias("salient"),
        joined(C.distinctive_objects(F.col("title"), F.col("desc"), L.STRONG)).alias("distinctive"),
    )


# ---- entities ---------------------------------------------------------------
def _entity_cases(expr):
    return [(e, has(expr, E.entity_pattern(e["match"]).replace("(?:", "("))) for e in L.ENTITIES]


HITS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {lit(e['id'])} END" for e, c in _entity_cases("btxt")) + "], lambda x: x IS NOT NULL)"
IMPORTANCE = "greatest(0, " + ", ".join(f"CASE WHEN {c} THEN {e['importance']} ELSE 0 END" for e, c in _entity_cases("btxt")) + ")"


@query("match_entities", f"WITH {ITEMS} SELECT doc_id, array_to_string({HITS}, ',') AS entity_ids, CAST({IMPORTANCE} AS INTEGER) AS max_importance FROM items")
def match_entities(spark, d):
    linked = E.match_entities(T.items(spark, d), L.ENTITIES)
    return linked.select("doc_id", F.array_join("entity_ids", ",").alias("entity_ids"), "max_importance")


@query("entity_activity", f"""WITH {ITEMS}, e AS (SELECT unnest({HITS}) AS id FROM items)
  SELECT k.id, count(e.id) AS n FROM (VALUES {", ".join(f"({lit(e['id'])})" for e in L.ENTITIES)}) k(id) LEFT JOIN e ON e.id = k.id GROUP BY k.id""")
def entity_activity(spark, d):
    dimension = spark.createDataFrame([(e["id"],) for e in L.ENTITIES], "id string")
    return E.entity_activity(E.match_entities(T.items(spark, d), L.ENTITIES), dimension)


@query("signals_for_entity", f"WITH {ITEMS} SELECT doc_id, published_at FROM items WHERE list_contains({HITS}, 'e-elle')")
def signals_for_entity(spark, d):
    return E.signals_for_entity(E.match_entities(T.items(spark, d), L.ENTITIES), "e-elle").select("doc_id", "published_at")


_NORM = "' ' || trim(regexp_replace(regexp_replace(lower(btxt), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query("link_terms", f"""WITH {ITEMS}, terms AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS term FROM part UNION SELECT 'on the' UNION SELECT 'than'),
  n AS (SELECT doc_id, {_NORM} AS t FROM items)
  SELECT doc_id, term AS id FROM n JOIN terms ON contains(t, ' ' || term || ' ')""")
def link_terms(spark, d):
    first = T.table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term"))
    terms = first.unionByName(spark.createDataFrame([("on the",), ("than",)], "term string")).distinct()
    items = T.items(spark, d).withColumn("btxt", both_texts())
    return E.link_terms(items, "doc_id", "btxt", terms.select(F.lower("term").alias("id"), "term"))


# ---- similarity of neighbouring documents -----------------------------------
def _neighbours(spark, d, **made):
    """What is ``made`` of a document beside the same of the document after it; it is made once a document, and no text is shuffled."""
    once = X.add_once(T.items(spark, d), {"s": F.struct(*[c.alias(name) for name, c in made.items()])})
    items = written(once.select("doc_id", "s"), "neighbours")
    return items.select("doc_id", F.col("s").alias("a")).join(
        items.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("b")), "doc_id"
    )


def _pair(body):
    return f"""WITH {CATEGORISED}, {{extra}}p AS (SELECT x.doc_id, x.title AS xt, y.title AS yt, x.descr AS xd, y.descr AS yd, x.btxt AS xb, y.btxt AS yb,
    x.published_at AS xp, y.published_at AS yp, x.category AS xc, y.category AS yc FROM cat x JOIN cat y ON y.doc_id = x.doc_id + 1) {body}"""


JACCARD = "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) END"
OVERLAP = "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / CAST(least(len(a), len(b)) AS DOUBLE) END"


@query("jaccard_similarity", _pair(f"SELECT doc_id, {half_up(JACCARD, 6)} AS sim FROM (SELECT doc_id, {tokens('xd')} AS a, {tokens('yd')} AS b FROM p)").replace("{extra}", ""))
def jaccard_similarity(spark, d):
    sets = _neighbours(spark, d, words=X.token_set(F.col("desc")))
    return sets.select("doc_id", round_half_up(Y.jaccard(F.col("a.words"), F.col("b.words")), 6).alias("sim"))


@query("phrase_overlap", _pair(f"SELECT doc_id, {half_up(OVERLAP, 6)} AS overlap FROM (SELECT doc_id, {phrases('xd')} AS a, {phrases('yd')} AS b FROM p)").replace("{extra}", ""))
def phrase_overlap(spark, d):
    sets = _neighbours(spark, d, phrases=X.name_phrases(F.col("desc")))
    return sets.select("doc_id", round_half_up(Y.overlap_coefficient(F.col("a.phrases"), F.col("b.phrases")), 6).alias("overlap"))


_EV = f"""e AS (SELECT *, {first_match('xb', L.ACTIONS)} AS xa, {first_match('yb', L.ACTIONS)} AS ya,
    list_distinct(list_concat({phrases('xt')}, {nouns('xb', L.STRONG)})) AS a, list_distinct(list_concat({phrases('yt')}, {nouns('yb', L.STRONG)})) AS b FROM p),
  o AS (SELECT *, {OVERLAP} AS ov FROM e)"""


@query("event_relation", _pair(f""", {_EV} SELECT doc_id, coalesce(xa = ya AND ov > 0, false) AS match, coalesce(xa <> ya AND ov < 0.6, false) AS conflict, {half_up('ov', 6)} AS object_overlap FROM o""").replace("{extra}", ""))
def event_relation(spark, d):
    side = Y.event_side(F.col("title"), F.col("desc"), L.ACTIONS, L.STRONG)
    pairs = Y.related(_neighbours(spark, d, action=side["action"], objects=side["objects"]))
    return pairs.select("doc_id", "match", "conflict", round_half_up(F.col("object_overlap"), 6).alias("object_overlap"))


_W = f"""N AS (SELECT count(*) AS n FROM items),
  tk AS (SELECT doc_id, 't' AS f, unnest({tokens('title')}) AS tok FROM items UNION ALL SELECT doc_id, 'd', unnest({tokens('descr')}) FROM items),
  w AS (SELECT tok, ln((n + 1) / (count(*) + 0.5)) + 1 AS w FROM tk, N GROUP BY tok, n),
  tot AS_ (SELECT doc_id, f, sum(w) AS s FROM tk JOIN w USING (tok) GROUP BY ALL),
  inter AS (SELECT x.doc_id, x.f, sum(w) AS i FROM tk x JOIN tk y ON y.doc_id = x.doc_id + 1 AND y.f = x.f AND y.tok = x.tok JOIN w ON w.tok = x.tok GROUP BY ALL),
  ws AS (SELECT x.doc_id, x.f, coalesce(i, 0) / (x.s + y.s - coalesce(i, 0)) AS sim FROM tots x JOIN tots y ON y.doc_id = x.doc_id + 1 AND y.f = x.f
    LEFT JOIN inter z ON z.doc_id = x.doc_id AND z.f = x.f), """.replace("tot AS_ (", "tots AS (")
_SIM = "coalesce((SELECT sim FROM ws WHERE ws.doc_id = o.doc_id AND ws.f = '{f}'), 0)"


def _features(spark, d):
    """Features of the categorised items, which are written, as the rules of all categories would run again for each use; ``pos`` is the document."""
    from signalloom.operators.clusters import item_features

    pool = written(categorised(spark, d).withColumn("pos", F.col("doc_id")), "pool")
    n_items = pool.count()
    return item_features(pool, L.ENTITIES, n_items, L.ACTIONS, L.STRONG), n_items


def _beside(features):
    """Features by ``pos`` beside those of the next, as structs ``x`` and ``y``; they are made once, for both sides."""
    side = written(features.select("pos", F.struct(*[c for c in features.columns if c != "pos"]).alias("f")), "sides")
    return side.select(F.col("pos").alias("doc_id"), F.col("f").alias("x")).join(
        side.select((F.col("pos") - 1).alias("doc_id"), F.col("f").alias("y")), "doc_id"
    )


@query("weighted_similarity", _pair(f"SELECT o.doc_id, {half_up(_SIM.format(f='t'), 6)} AS title_sim, {half_up(_SIM.format(f='d'), 6)} AS desc_sim FROM p o").replace("{extra}", _W))
def weighted_similarity(spark, d):
    n = T.table(spark, d, "documents").count()
    items = T.items(spark, d).withColumn("pos", F.col("doc_id"))
    weights = Y.token_totals(items, "pos", {"title": "title", "desc": "desc"}, n)
    pairs = _beside(items.select("pos").join(weights, "pos", "left"))

    def sim(f):
        sides = [c for s in "xy" for c in (F.coalesce(f"{s}.{f}_tokens", F.array().cast("array<bigint>")), F.col(f"{s}.{f}_total"))]
        return round_half_up(Y.weighted_jaccard(*sides, n), 6)

    return pairs.select("doc_id", sim("title").alias("title_sim"), sim("desc").alias("desc_sim"))


_ENTS = {s: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {lit(e['id'])} END" for e, c in _entity_cases(s)) + "], lambda x: x IS NOT NULL)" for s in ("xb", "yb")}


@query("cluster_score", _pair(f""", {_EV}, s AS (SELECT *, abs(epoch_us(xp) - epoch_us(yp)) / 3600000000.0 AS hours,
    0.5 * {_SIM.format(f='t')} + 0.3 * (SELECT {OVERLAP} FROM (SELECT {phrases('xt')} AS a, {phrases('yt')} AS b)) + 0.2 * {_SIM.format(f='d')} AS content,
    (SELECT {JACCARD} FROM (SELECT {_ENTS['xb']} AS a, {_ENTS['yb']} AS b)) AS ent FROM o)
  SELECT doc_id, {half_up("CASE WHEN coalesce(xa <> ya AND ov < 0.6, false) THEN least(content, 0.15) "
  "WHEN hours <= 72 AND (coalesce(xa = ya AND ov > 0, false) OR (ov >= 0.5 AND ent > 0)) THEN greatest(content, 0.55) WHEN content < 0.02 THEN content "
  "ELSE content + (0.4 * ent + 0.35 * greatest(0, least(1, 1 - hours / 48)) + 0.25 * (CASE WHEN xc = yc THEN 1 ELSE 0 END)) * least(content, 0.5) * 1.4 END", 6)} AS score FROM s""").replace("{extra}", _W))
def cluster_score(spark, d):
    features, n = _features(spark, d)
    return Y.pair_score(_beside(features), n).select("doc_id", round_half_up(F.col("score"), 6).alias("score"))


# ---- scores, verification, caps, sections -----------------------------------
_WEIGHTS = "CASE category WHEN 'policy' THEN 0.9 WHEN 'capital' THEN 0.8 WHEN 'compute' THEN 0.8 WHEN 'research' THEN 0.75 WHEN 'market' THEN 0.7 WHEN 'orggov' THEN 0.65 WHEN 'product' THEN 0.65 WHEN 'adoption' THEN 0.6 WHEN 'opensource' THEN 0.7 WHEN 'analysis' THEN 0.4 WHEN 'general' THEN 0.35 ELSE 0.6 END::DOUBLE"
_REC = clamp01(f"1.0 - (epoch_us({AS_OF}) - epoch_us(published_at)) / 1000000.0 / 3600.0 / 72.0")
def _signal_steps(official, hedging, job, speculative):
    """Significance, verification and caps of ``sc``, as CTEs that end in ``signals``."""
    return f"""sg AS (SELECT *, CAST(floor({clamp01("(0.35::DOUBLE * recency + 0.25::DOUBLE * (least(source_count, 4) / 4.0::DOUBLE) + 0.25::DOUBLE * (importance / 100.0::DOUBLE) + 0.15::DOUBLE * weight) * (CASE WHEN cat_confidence < 0.45 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END)")} * 100 + 0.5) AS INTEGER) AS raw,
    CASE WHEN category = 'analysis' THEN 'analysis' WHEN {official} THEN 'official' WHEN {has("btxt", hedging)} THEN 'uncertain'
      WHEN source_count >= 2 THEN 'corroborated' ELSE 'single' END AS verification FROM sc),
  cp AS (SELECT *, (category IN ('general', 'analysis') AND NOT (verification = 'official' OR source_count >= 2)) AS weak,
    {has("btxt", job)} OR {has("btxt", speculative)} AS soft FROM sg),
  cq AS (SELECT *, CASE WHEN weak AND raw > 55 THEN 55 ELSE raw END AS significance FROM cp),
  signals AS (SELECT *, CASE WHEN significance >= 70 AND NOT weak AND NOT soft THEN 'high' WHEN significance >= 45 THEN 'notable' ELSE 'emerging' END AS impact,
    CASE WHEN weak AND raw > 55 THEN 'single-source-general' WHEN weak AND significance >= 70 THEN 'general-without-evidence'
      WHEN soft AND significance >= 70 THEN 'job-or-speculative' END AS cap_reason, {FAMILY} AS family FROM cq)"""


SIGNALS = f"""{CATEGORISED}, sc AS (SELECT *, CAST(1 + doc_id % 3 AS BIGINT) AS source_count, {IMPORTANCE} AS importance, {_REC} AS recency, {_WEIGHTS} AS weight FROM cat),
  {_signal_steps("source_name IN ('src0', 'src7')", L.HEDGING, L.JOB, L.SPECULATIVE)}"""


def scored(spark, d):
    base = E.match_entities(categorised(spark, d), L.ENTITIES).withColumns(
        {"source_count": (F.pmod("doc_id", F.lit(3)) + 1), "cluster": F.col("doc_id")}
    )
    return X.add_once(
        base,
        {
            "significance": S.significance(
                F.col("published_at"), F.col("source_count"), F.col("max_importance"), F.col("category"),
                F.col("cat_confidence"), L.AS_OF,
            ),
            "verification": C.classify_verification(
                F.col("title"), F.col("desc"), F.col("category"), F.col("source_count"),
                F.col("source_name").isin(L.OFFICIAL), L.HEDGING,
            ),
        },
    )


def signals(spark, d):
    """Documents as scored signals, each its own story."""
    capped = C.apply_integrity_caps(scored(spark, d), job=L.JOB, speculative=L.SPECULATIVE)
    return capped.withColumn("family", C.wave_family(F.col("category")))


@query("recency_score", f"WITH {ITEMS} SELECT doc_id, {half_up(_REC, 6)} AS recency FROM items")
def recency_score(spark, d):
    return T.items(spark, d).select("doc_id", round_half_up(S.recency_score(F.col("published_at"), L.AS_OF), 6).alias("recency"))


@query("significance", f"WITH {SIGNALS} SELECT doc_id, raw AS significance FROM signals")
def significance(spark, d):
    return scored(spark, d).select("doc_id", "significance")


@query("classify_verification", f"WITH {SIGNALS} SELECT doc_id, verification FROM signals")
def verification(spark, d):
    return signals(spark, d).select("doc_id", "verification")


@query("integrity_caps", f"WITH {SIGNALS} SELECT doc_id, significance, impact, cap_reason IS NOT NULL AS capped, coalesce(cap_reason, '') AS cap_reason FROM signals")
def integrity_caps(spark, d):
    return signals(spark, d).select("doc_id", "significance", "impact", "capped", F.coalesce("cap_reason", F.lit("")).alias("cap_reason"))


@query("impact_labels", f"""WITH {SIGNALS} SELECT CASE impact WHEN 'high' THEN 'High impact' WHEN 'notable' THEN 'Notable' ELSE 'Emerging' END AS impact,
  CASE verification WHEN 'official' THEN 'Official' WHEN 'corroborated' THEN 'Corroborated' WHEN 'single' THEN 'Single report' WHEN 'analysis' THEN 'Analysis' ELSE 'Uncertain' END AS verification,
  count(*) AS n FROM signals GROUP BY ALL""")
def impact_labels(spark, d):
    named = signals(spark, d).select(
        C.label_of(F.col("impact"), V.IMPACT_LABEL).alias("impact"),
        C.label_of(F.col("verification"), V.VERIFICATION_LABEL).alias("verification"),
    )
    return named.groupBy("impact", "verification").agg(F.count("*").alias("n"))


_BY_ACTION = {"shutdown": "Users move on.", "launch": "It could raise the bar."}
_BY_CATEGORY = {"market": "Prices follow.", "general": "The effect may stay small."}


def _sentence(table, key):
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + " END"


@query("why_it_matters", f"""WITH {SIGNALS}, b AS (SELECT *, coalesce({_sentence(_BY_ACTION, '(' + first_match('btxt', L.ACTIONS) + ')')}, {_sentence(_BY_CATEGORY, 'category')}, {lit(_BY_CATEGORY['general'])}) AS base FROM signals)
  SELECT doc_id, CASE WHEN (impact = 'emerging' OR verification IN ('single', 'uncertain')) AND NOT regexp_matches(base, '(?i)\\b(could|may)\\b')
    THEN 'If it holds up, ' || lower(substr(base, 1, 1)) || substr(base, 2) ELSE base END AS why FROM b""")
def why_it_matters(spark, d):
    told = C.why_it_matters(signals(spark, d), _BY_ACTION, _BY_CATEGORY, actions=L.ACTIONS, name="why")
    return told.select("doc_id", "why")


ROUTED = f"""{SIGNALS}, lab AS (SELECT *, {first_match('btxt', L.LABS)} AS lab FROM signals),
  routed AS (SELECT *, CASE WHEN coalesce(lab IN ('openai', 'google', 'anthropic'), false) AND NOT {has("title", L.QUESTION)} AND {has("btxt", L.SHIPPING)} THEN 'release'
    WHEN category = 'opensource' THEN 'opensource' WHEN category = 'research' THEN 'research' ELSE 'wire' END AS section FROM lab)"""
_CUT = "CASE WHEN length({c}) > {n} THEN rtrim(substr({c}, 1, {m})) || '…' ELSE {c} END"


def cut(c, n):
    return _CUT.format(c=c, n=n, m=n - 1)


def routed(spark, d):
    return P.section_routing(signals(spark, d), L.LABS, L.LAB_NAMES, L.SHIPPING, L.QUESTION)


@query("section_routing", f"WITH {ROUTED} SELECT doc_id, section, coalesce(lab, '') AS lab FROM routed")
def section_routing(spark, d):
    return routed(spark, d).select("doc_id", "section", F.coalesce("lab", F.lit("")).alias("lab"))


@query("releases_per_lab", f"""WITH {ROUTED}, k AS (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY published_at DESC, link) AS rn FROM routed WHERE section = 'release')
  SELECT v.lab, CAST(coalesce(rn, 0) AS INTEGER) AS rank, coalesce(link, '') AS link, coalesce({cut('title', 90)}, '') AS headline
  FROM (VALUES ('openai'), ('google'), ('anthropic')) v(lab) LEFT JOIN k ON k.lab = v.lab AND rn <= 5""")
def releases_per_lab(spark, d):
    labs = spark.createDataFrame([(n,) for n in L.LAB_NAMES], "lab string")
    rows = P.releases_per_lab(routed(spark, d), labs)
    return rows.select("lab", F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("link", F.lit("")).alias("link"),
                       F.coalesce("headline", F.lit("")).alias("headline"))


@query("wire_top", f"WITH {ROUTED} SELECT doc_id, {cut('title', 80)} AS headline, CASE WHEN descr = '' THEN title ELSE {cut('descr', 260)} END AS body FROM routed WHERE section = 'wire' ORDER BY doc_id LIMIT 8")
def wire_top(spark, d):
    return P.wire_top(routed(spark, d)).select("doc_id", "headline", "body")


@query("open_weight_feed", f"WITH {ROUTED} SELECT doc_id, {cut('title', 60)} AS headline FROM routed WHERE section = 'opensource' ORDER BY doc_id LIMIT 8")
def open_weight_feed(spark, d):
    return P.open_weight_feed(routed(spark, d)).select("doc_id", "headline")


@query("research_top", f"WITH {ROUTED} SELECT doc_id, {first_match('btxt', L.FIELDS, lit('Research'))} AS field FROM routed WHERE section = 'research' ORDER BY published_at DESC, link LIMIT 6")
def research_top(spark, d):
    return P.research_top(routed(spark, d), fields=L.FIELDS).select("doc_id", "field")


@query("signals_by_significance", f"WITH {SIGNALS} SELECT doc_id, significance FROM signals ORDER BY significance DESC, doc_id LIMIT 40")
def signals_by_significance(spark, d):
    return P.signals_by_significance(signals(spark, d)).select("doc_id", "significance")


@query("ticker_top", f"WITH {SIGNALS} SELECT doc_id, upper({cut('title', 110)}) AS headline FROM signals ORDER BY significance DESC, doc_id LIMIT 10")
def ticker_top(spark, d):
    return P.ticker_top(signals(spark, d)).select("doc_id", "headline")


@query("top_wave_per_family", f"""WITH {SIGNALS} SELECT family, doc_id, significance FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY significance DESC, doc_id) AS rn
  FROM signals WHERE category NOT IN ('analysis', 'general')) WHERE rn = 1""")
def top_wave(spark, d):
    return P.top_wave_per_family(signals(spark, d)).select("family", "doc_id", "significance")


@query("family_groups", f"""WITH {SIGNALS} SELECT family, doc_id, significance FROM signals WHERE category NOT IN ('analysis', 'general')
  AND published_at BETWEEN {AS_OF} - INTERVAL 240 HOUR AND {AS_OF}""")
def family_groups(spark, d):
    return P.family_groups(signals(spark, d), L.AS_OF, 240, tie="doc_id").select("family", "doc_id", "significance")


@query("family_sorted", f"""WITH {SIGNALS} SELECT family, doc_id, CAST(row_number() OVER (PARTITION BY family ORDER BY significance DESC, doc_id) AS INTEGER) AS rank
  FROM signals WHERE category NOT IN ('analysis', 'general') AND published_at BETWEEN {AS_OF} - INTERVAL 240 HOUR AND {AS_OF}""")
def family_sorted(spark, d):
    return P.ranked_families(signals(spark, d), L.AS_OF, 240, tie="doc_id").select("family", "doc_id", "rank")


@query("latest_previews", f"""WITH {SIGNALS}, w AS (SELECT doc_id, significance FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY significance DESC, doc_id) AS rn
    FROM signals WHERE category NOT IN ('analysis', 'general')) WHERE rn = 1),
  a AS (SELECT 'ticker' AS panel, row_number() OVER (ORDER BY significance DESC, doc_id) AS rank, doc_id AS id FROM signals QUALIFY rank <= 12
    UNION ALL SELECT 'waves', row_number() OVER (ORDER BY significance DESC, doc_id) AS rank, doc_id FROM w QUALIFY rank <= 3
    UNION ALL SELECT 'river', row_number() OVER (ORDER BY published_at DESC, doc_id) AS rank, doc_id FROM signals QUALIFY rank <= 3)
  SELECT panel, CAST(rank AS INTEGER) AS rank, id FROM a""")
def latest_previews(spark, d):
    # three panels and their limits read the same few columns, made once
    live = written(signals(spark, d).select("doc_id", "category", "significance", "published_at"), "previewed")
    return P.latest_previews(live, P.leading_waves(live, tie="doc_id"), tie="doc_id")


@query("family_counts", f"""WITH {SIGNALS}, g AS (SELECT family FROM signals WHERE category NOT IN ('analysis', 'general') AND published_at BETWEEN {AS_OF} - INTERVAL 24 HOUR AND {AS_OF})
  SELECT v.family, count(g.family) AS n FROM (VALUES ('product'), ('market'), ('research')) v(family) LEFT JOIN g ON g.family = v.family GROUP BY ALL""")
def family_counts(spark, d):
    return P.family_counts(P.family_groups(signals(spark, d), L.AS_OF, 24, tie="doc_id"))


@query("resolve_sources", f"""WITH {SIGNALS}, s AS (SELECT source AS family, unnest([max(doc_id) + 1000000007, min(doc_id), max(doc_id)]) AS doc_id, unnest([0, 1, 2]) AS position FROM documents GROUP BY source)
  SELECT s.family, CAST(position AS INTEGER) AS position, doc_id, title FROM s JOIN (SELECT doc_id, title FROM signals) USING (doc_id)""")
def resolve_sources(spark, d):
    """Every source lists an id nobody has, its first document and its last."""
    live = signals(spark, d)
    listed = T.table(spark, d, "documents").groupBy(F.col("source").alias("family")).agg(
        F.array(F.max("doc_id") + 1000000007, F.min("doc_id"), F.max("doc_id")).alias("source_ids")
    )
    found = P.resolve_sources(listed, live.select(F.col("doc_id").alias("id"), "title"))
    return found.select("family", "position", F.col("id").cast("bigint").alias("doc_id"), "title")


@query("summary_usable", """SELECT conv_id AS summary_id, count(DISTINCT role) FILTER (length(trim(text)) > 0) = 3 AS usable FROM conversations GROUP BY ALL""")
def summary_usable(spark, d):
    rows = T.table(spark, d, "conversations").select(
        F.col("conv_id").alias("summary_id"), F.lit("ai-written").alias("method"),
        F.lit("2024-01-30 12:00:00").cast("timestamp").alias("generated_at"), F.col("role").alias("family"),
        F.array("text").alias("bullets"),
    )
    return P.summary_usable(rows, L.AS_OF, ["user", "assistant", "system"])


@query("feed_health", """SELECT (SELECT count(*) FROM (SELECT source FROM documents GROUP BY ALL HAVING min(n_chars) > 20)) AS feeds_succeeded, (SELECT count(DISTINCT source) FROM documents) AS feeds_configured,
  (SELECT count(DISTINCT lang) FROM documents) AS models_available, (SELECT count(*) FROM (SELECT lang FROM documents GROUP BY ALL HAVING count(*) < 300)) AS estimated_datasets,
  (SELECT count(*) FROM nation) AS nodes_available,
  (SELECT floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(CAST(CAST(min(ts) AS DATE) AS TIMESTAMP))) / 86400000000.0 * 10 + 0.5) / 10 FROM events) AS history_depth_days""")
def feed_health(spark, d):
    docs = T.table(spark, d, "documents")
    feeds = docs.groupBy(F.col("source").alias("name")).agg((F.min("n_chars") > 20).alias("ok"))
    models = docs.groupBy(F.col("lang").alias("model")).agg((F.count("*") < 300).alias("is_estimated"))
    from signalloom.operators.history import history_depth

    depth = history_depth(T.events(spark, d), L.AS_OF).first()["history_depth_days"]
    return P.feed_health(feeds, models, T.table(spark, d, "nation"), depth)


# ---- the whole pipeline -----------------------------------------------------
_STABLE = """lower(to_base(list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(link, ''), lambda c: CAST(unicode(c) AS HUGEINT))),
   lambda h, u: (xor(h, u) * 16777619) & 4294967295)::BIGINT, 36))"""


def _ratio(kind, a, b):
    return (JACCARD if kind == "jaccard" else OVERLAP).replace("(a)", f"({a})").replace("(b)", f"({b})").replace("(a, b)", f"({a}, {b})")


# all pairs of the pool: wording by shared tokens, structure by comparing everything with everything
SCORED_PAIRS = f"""{CATEGORISED},
  pool AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY published_at DESC, link) - 1 AS pos FROM cat),
  ft AS MATERIALIZED (SELECT pos, doc_id, published_at, category, {first_match('btxt', L.ACTIONS)} AS act, {phrases('title')} AS ph,
    list_distinct(list_concat({phrases('title')}, {nouns('btxt', L.STRONG)})) AS ob, {HITS} AS en FROM pool),
  tk AS MATERIALIZED (SELECT pos, 't' AS f, unnest({tokens('title')}) AS tok FROM pool UNION ALL SELECT pos, 'd', unnest({tokens('descr')}) FROM pool),
  idfs AS (SELECT tok, ln((n + 1) / (count(*) + 0.5)) + 1 AS w FROM tk, (SELECT count(*) AS n FROM pool) GROUP BY tok, n),
  tw AS MATERIALIZED (SELECT tk.*, w FROM tk JOIN idfs USING (tok)),
  whole AS MATERIALIZED (SELECT pos, f, sum(w) AS s FROM tw GROUP BY ALL),
  common AS (SELECT x.pos AS i, y.pos AS j, x.f, sum(x.w) AS s FROM tw x JOIN tw y ON x.tok = y.tok AND x.f = y.f AND x.pos > y.pos GROUP BY ALL),
  sims AS MATERIALIZED (SELECT i, j, c.f, c.s / (a.s + b.s - c.s) AS sim FROM common c JOIN whole a ON a.pos = i AND a.f = c.f JOIN whole b ON b.pos = j AND b.f = c.f),
  versus AS (SELECT x.pos AS i, y.pos AS j, x.published_at AS i_at, y.published_at AS j_at, x.doc_id AS i_doc, y.doc_id AS j_doc,
      x.act AS xa, y.act AS ya, {_ratio("overlap", "x.ob", "y.ob")} AS ov, {_ratio("jaccard", "x.en", "y.en")} AS ent,
      abs(epoch_us(x.published_at) - epoch_us(y.published_at)) / 3600000000.0 AS hours, coalesce(x.category = y.category, false) AS one,
      0.5 * coalesce(t.sim, 0) + 0.3 * {_ratio("overlap", "x.ph", "y.ph")} + 0.2 * coalesce(d.sim, 0) AS content
    FROM ft x JOIN ft y ON x.pos > y.pos LEFT JOIN sims t ON t.i = x.pos AND t.j = y.pos AND t.f = 't' LEFT JOIN sims d ON d.i = x.pos AND d.j = y.pos AND d.f = 'd'),
  scored AS MATERIALIZED (SELECT *, round(CASE WHEN coalesce(xa <> ya AND ov < 0.6, false) THEN least(content, 0.15)
      WHEN hours <= 72 AND (coalesce(xa = ya AND ov > 0, false) OR (ov >= 0.5 AND ent > 0)) THEN greatest(content, 0.55) WHEN content < 0.02 THEN content
      ELSE content + (0.4 * ent + 0.35 * greatest(0, least(1, 1 - hours / 48)) + 0.25 * (CASE WHEN one THEN 1 ELSE 0 END)) * least(content, 0.5) * 1.4 END, 9) AS score
    FROM versus)"""
# the pool is read item by item; ``reps`` maps current representatives to the founders of their groups
CLUSTERED = f"""{SCORED_PAIRS},
  offers AS (SELECT i, list(struct_pack(score := score, j := j, newer := i_at < j_at)) AS c FROM scored WHERE score >= 0.34 GROUP BY i),
  line AS MATERIALIZED (SELECT pos, coalesce(c, []) AS c FROM ft LEFT JOIN offers ON i = pos),
  walk AS (
    SELECT CAST(-1 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS cluster, CAST(MAP {{}} AS MAP(BIGINT, BIGINT)) AS reps
    UNION ALL
    SELECT pos, coalesce(-best.nf, pos),
      CASE WHEN best IS NULL THEN map_concat(reps, MAP {{pos: pos}})
        WHEN best.newer THEN map_concat(map_from_entries(list_filter(map_entries(reps), lambda e: e.key <> best.j)), MAP {{pos: -best.nf}}) ELSE reps END
    FROM (SELECT l.pos, w.reps, list_sort(list_transform(list_filter(l.c, lambda x: map_contains(w.reps, x.j)),
        lambda x: struct_pack(score := x.score, nf := -map_extract_value(w.reps, x.j), j := x.j, newer := x.newer)), 'DESC')[1] AS best
      FROM walk w JOIN line l ON l.pos = w.pos + 1) s),
  grouped AS MATERIALIZED (SELECT w.pos, w.cluster FROM walk w WHERE w.pos >= 0),
  lasting AS (SELECT unnest(map_keys(reps)) AS pos FROM (SELECT reps FROM walk ORDER BY pos DESC LIMIT 1))"""


@query("near_dup_pair_join", f"""WITH {SCORED_PAIRS} SELECT greatest(i_doc, j_doc) AS doc_id, least(i_doc, j_doc) AS other_id, {half_up('score', 6)} AS score
  FROM scored WHERE score >= 0.34""")
def near_dup_pair_join(spark, d):
    from signalloom.operators.clusters import near_dup_pairs

    features, n_items = _features(spark, d)
    features = written(features, "features")
    pairs = near_dup_pairs(features, 0.34, n_items)
    return pairs.select(F.col("i").alias("doc_id"), F.col("j").alias("other_id"), round_half_up(F.col("score"), 6).alias("score"))


@query("event_clusters", f"WITH RECURSIVE {CLUSTERED} SELECT doc_id, pos, cluster FROM grouped JOIN pool USING (pos)")
def event_clusters(spark, d):
    from signalloom.operators.clusters import event_clusters as cluster

    groups = cluster(categorised(spark, d), L.ENTITIES, 0.34, actions=L.ACTIONS, strong=L.STRONG)
    return groups.items.select("doc_id", "pos", "cluster")


def _built(spark, d):
    from signalloom.plans.signals import Lexicon, build_signals as build

    lexicon = Lexicon(L.CATEGORIES, L.ACTIONS, L.STRONG, L.OFFICIAL)
    return build(T.items(spark, d), L.ENTITIES, L.AS_OF, lexicon)[0]


BUILT = f"""{CLUSTERED},
  merged AS (SELECT cluster, count(DISTINCT link) AS source_count, bool_or(source_name IN ('src0', 'src7')) AS official FROM grouped JOIN pool USING (pos) GROUP BY ALL),
  sc AS (SELECT pool.*, cluster, source_count, official, {IMPORTANCE} AS importance, {HITS} AS hits, {_REC} AS recency, {_WEIGHTS} AS weight
    FROM lasting JOIN grouped USING (pos) JOIN pool USING (pos) JOIN merged USING (cluster)),
  {_signal_steps("official", V.HEDGING, V.JOB_POSTING, V.SPECULATIVE)}"""


@query("build_signals", f"WITH RECURSIVE {BUILT} SELECT {_STABLE} AS cluster_id, cluster, title, category, family, significance, impact, verification, source_count FROM signals")
def build_signals(spark, d):
    return _built(spark, d).select("cluster_id", "cluster", "title", "category", "family", "significance", "impact", "verification", "source_count")


@query("project_signal", f"""WITH RECURSIVE {BUILT} SELECT link AS id, {_STABLE} AS cluster_id, cluster, descr AS "desc", link, published_at, {half_up("cat_confidence", 6)} AS cat_confidence,
  cap_reason IS NOT NULL AS capped, coalesce(cap_reason, '') AS cap_reason, source_name, array_to_string(hits, ',') AS entity_ids FROM signals""")
def project_signal(spark, d):
    """What :func:`build_signals` publishes beside the columns of its own query."""
    return _built(spark, d).select(
        "id", "cluster_id", "cluster", "desc", "link", "published_at", round_half_up(F.col("cat_confidence"), 6).alias("cat_confidence"), "capped",
        F.coalesce("cap_reason", F.lit("")).alias("cap_reason"), "source_name", F.array_join("entity_ids", ",").alias("entity_ids"),
    )


# ---- merged stories by a given grouping: documents of one length class ------
STORIES = f"""{ITEMS}, st AS (SELECT *, length(descr) % 40 AS cluster, doc_id AS pos FROM items),
  srcs AS (SELECT cluster, source_name AS link, min(pos) AS first_pos, arg_min(doc_id, pos) AS first_doc FROM st GROUP BY ALL)"""


def _stories(spark, d):
    return T.items(spark, d).withColumns(
        {"cluster": F.pmod(F.length("desc"), F.lit(40)).cast("bigint"), "pos": F.col("doc_id"), "name": F.col("source_name")}
    )


def _sources(spark, d):
    from signalloom.operators.clusters import cluster_sources as sources

    marked = F.when(F.col("name").isin("src3", "src11"), F.lit("Lab (YouTube)")).otherwise(F.col("name"))
    return sources(_stories(spark, d).withColumns({"link": F.col("name"), "source_name": marked}))


@query("cluster_sources", f"WITH {STORIES} SELECT cluster, link, first_pos FROM srcs")
def cluster_sources(spark, d):
    return _sources(spark, d).select("cluster", "link", "first_pos")


@query("source_counts", f"WITH {STORIES} SELECT cluster, count(*) AS source_count FROM srcs GROUP BY ALL")
def source_counts(spark, d):
    return _sources(spark, d).groupBy("cluster").agg(F.count("*").alias("source_count"))


@query("video_attachment", f"""WITH {STORIES}, v AS (SELECT cluster, arg_min(link, first_pos) AS video FROM srcs WHERE link IN ('src3', 'src11') GROUP BY ALL)
  SELECT doc_id, coalesce(video = source_name, false) AS is_video, CASE WHEN video IS NULL OR video = source_name THEN '' ELSE video END AS video_url
  FROM st LEFT JOIN v USING (cluster)""")
def video_attachment(spark, d):
    stories = _stories(spark, d).withColumn("link", F.col("name"))
    found = P.video_attachment(stories, _sources(spark, d))
    return found.select("doc_id", "is_video", F.coalesce("video_url", F.lit("")).alias("video_url"))


@query("exclude_commentary", f"WITH {CATEGORISED} SELECT doc_id, category FROM cat WHERE category NOT IN ('analysis', 'general')")
def exclude_commentary(spark, d):
    kept = categorised(spark, d).where(~F.col("category").isin(V.COMMENTARY_CATEGORIES))
    return kept.select("doc_id", "category")


@query("union_feeds", "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT lang FROM documents WHERE doc_id % 3 = 0) GROUP BY ALL")
def union_feeds(spark, d):
    from signalloom.sources.readers import union_feeds as union

    docs = T.table(spark, d, "documents").select("doc_id", "lang")
    return union(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0")).groupBy("lang").agg(F.count("*").alias("n"))


@query("token_union_intersect", _pair(f"SELECT doc_id, len(list_intersect(a, b)) AS shared, len(a) + len(b) - len(list_intersect(a, b)) AS united FROM (SELECT doc_id, {tokens('xt')} AS a, {tokens('yt')} AS b FROM p)").replace("{extra}", ""))
def token_union_intersect(spark, d):
    sets = _neighbours(spark, d, words=X.token_set(F.col("title")))
    return sets.select("doc_id", F.size(F.array_intersect("a.words", "b.words")).cast("bigint").alias("shared"),
                       F.size(F.array_union("a.words", "b.words")).cast("bigint").alias("united"))
