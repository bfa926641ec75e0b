"""The operators over their whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import (
    bwt_dedup, chat_format, decontaminate, html_extract, jaccard_join, mixture, multi_index, pair_maxscore, rule_ledger, secret_scan, sharding, tree_weighting, whitening,
)
from signalloom.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _attacks(text: str) -> str:
    """How often an attacking word stands alone in the text; a doubled guard keeps neighbours apart."""
    words = "|".join(rule_ledger.ABUSE)
    return f"len(list_filter(regexp_extract_all({text}, '[a-z]+'), lambda w: regexp_full_match(w, '{words}')))"


RULES_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, {_WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM twice) GROUP BY r),
m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST({_attacks("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS BIGINT) AS n_abuse
  FROM d LEFT JOIN covered USING (r)),
f AS (
  SELECT *, CAST(
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 4 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_abuse >= 2 AND 250 * n_abuse > n_words THEN 32 ELSE 0 END AS BIGINT) AS failed
  FROM m)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM f
"""


@query("op7_rule_ledger", RULES_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.apply_rules(table(spark, sf_dir, "documents"))


@query("op7_learnt_ledger")
def op7_learnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_ledger.apply_rules(docs, "v2", rule_ledger.learn(docs, table(spark, sf_dir, "labels")))


_CONTROL = r"[<\[]\\*(?:\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(role) + length(text) + 17 + len(regexp_extract_all(text, '{_CONTROL}'))) AS chars,
    sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS words
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(words AS BIGINT) AS n_tokens
FROM l
"""


@query("op1_chat_format", CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hostile).alias("text"),
    )
    turns = given.unionByName(added).select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    return chat_format.digests(chat_format.format_chat(turns))


#: The tree of the mixture and its target weights; unlisted sources weigh the same.
def levels() -> dict:
    return {
        "domain": F.when(F.contains(F.coalesce("text", F.lit("")), F.lit(" | ")), "table").otherwise("prose"),
        "lang": F.col("lang"), "source": F.col("source"),
    }


WEIGHTS = {"domain": {"prose": 0.9, "table": 0.1}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 7


def _weight_sql(level: str) -> str:
    listed = WEIGHTS.get(level, {})
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in listed.items()) + " ELSE 1.0 END" if listed else "CAST(1.0 AS DOUBLE)"


def _mix_sql() -> str:
    names = ["domain", "lang", "source"]
    sql = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' ELSE 'prose' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len({_WORDS}) AS BIGINT) AS n_tokens
  FROM documents),
l AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM d GROUP BY ALL),
b0 AS (SELECT least(sum(supply * {MIX_EPOCHS}) * {MIX_SHARE} / {MIX_EPOCHS}, sum(supply * {MIX_EPOCHS})) AS budget FROM l)"""
    for k, level in enumerate(names):
        path, above = ", ".join(names[: k + 1]), ", ".join(names[:k])
        family = f"PARTITION BY {above}" if above else ""
        before = f"({family} ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        sql += f""",
c{k} AS (
  SELECT *, {_weight_sql(level)} AS weight
  FROM (SELECT {path}, CAST(sum(supply * {MIX_EPOCHS}) AS DOUBLE) AS capacity FROM l GROUP BY ALL)
  {f"JOIN b{k} USING ({above})" if above else "CROSS JOIN b0"}),
r{k} AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER {before}, 0))
    / greatest(sum(weight) OVER ({family}) - coalesce(sum(weight) OVER {before}, 0), 1e-12) AS reach
  FROM c{k} WHERE weight > 0 AND capacity > 0),
b{k + 1} AS (
  SELECT {path}, CASE WHEN capacity / weight <= reach THEN capacity ELSE greatest(water, 0) * weight END AS budget
  FROM (SELECT *, max(CASE WHEN capacity / weight > reach THEN reach END) OVER ({family}) AS water FROM r{k}))"""
    last = len(names)
    return sql + f""",
p AS (
  SELECT l.*, CASE WHEN supply > 0 THEN floor(round(coalesce(budget, 0), 6)) ELSE 0 END AS got
  FROM l LEFT JOIN b{last} USING (domain, lang, source)),
q AS (
  SELECT *, CASE WHEN supply > 0 THEN CAST(floor(got / supply) AS BIGINT) ELSE 0 END AS epochs FROM p),
o AS (
  SELECT d.*, epochs, got - epochs * supply AS rest,
    CAST('0x' || substr(md5('{MIX_SEED}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM d JOIN q USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, least(CAST({MIX_EPOCHS} AS BIGINT), epochs + CASE
    WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id) <= rest THEN 1 ELSE 0 END) AS copies
FROM o
"""


@query("op9_mixture", _mix_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), levels(), WEIGHTS, share=MIX_SHARE, epochs=MIX_EPOCHS, seed=MIX_SEED)


SHARD_BYTES = 1 << 20
SHARD_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
    CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes
  FROM documents),
e AS (SELECT *, unnest(range(0, 61)) AS depth FROM d),
s AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes) AS bytes FROM e GROUP BY ALL),
f AS (SELECT * FROM s WHERE bytes <= {SHARD_BYTES} OR depth = 60),
m AS (
  SELECT doc_id, e.h, n_bytes, min(struct_pack(depth := f.depth, prefix := f.prefix, bytes := f.bytes)) AS b
  FROM e JOIN f ON f.depth = e.depth AND f.prefix = e.h >> (60 - e.depth) GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN b.depth = 0 THEN '' ELSE right(bin(b.prefix + (1::BIGINT << b.depth)), b.depth) END AS shard,
  CAST(b.bytes AS BIGINT) AS shard_bytes, b.bytes > {SHARD_BYTES} AS oversize
FROM m
"""


@query("op10_extendible_sharding", SHARD_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sharding.assign(sizes, SHARD_BYTES).select("doc_id", "n_bytes", "shard", "shard_bytes", "oversize")


_SHINGLES = 4
JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + {_SHINGLES - 1}], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {_SHINGLES - 2}, CASE WHEN len(words) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 85 * (x.n + y.n - o)),
c AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT l.v, c.root FROM c JOIN l ON l.u = c.doc_id AND l.v > c.root)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(c.root) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id) GROUP BY ALL
"""


@query("op6_jaccard_join", JACCARD_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"), _SHINGLES, 85)


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


@query("op2_html_extract")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op4_tree_weighting")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = tree_weighting.score(docs, ~tree_weighting.held_out(F.col("doc_id")))
    return out.withColumn("held_out", tree_weighting.held_out(F.col("doc_id"))).withColumn("bits_a_byte", -F.col("score") * F.log2(F.lit(10.0)) / F.greatest("n_bytes", F.lit(1)))


@query("op3_latent_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_bwt_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.digests(table(spark, sf_dir, "documents"))


EMBEDDINGS_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
w AS (
  SELECT * FROM e
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM w a JOIN w b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
c AS (SELECT vec_id, vec_id AS root FROM e UNION SELECT l.v, c.root FROM c JOIN l ON l.u = c.vec_id AND l.v > c.root),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u),
m AS (SELECT vec_id, min(root) AS component_id FROM c GROUP BY vec_id)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN m USING (vec_id) LEFT JOIN n ON n.u = e.vec_id
"""


@query("op11_multi_index", EMBEDDINGS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.link(table(spark, sf_dir, "embeddings"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (term) CROSS JOIN s),
m AS (SELECT r, doc_id, 10 + (90 * len(terms) * s.n) // s.l AS m FROM d CROSS JOIN s WHERE len(terms) > 0),
g AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM w JOIN t USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place, doc_id, score FROM g WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM k WHERE place <= 10
"""


@query("op12_pair_maxscore", SEARCH_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_maxscore.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
