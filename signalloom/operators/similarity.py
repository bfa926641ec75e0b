"""Token statistics and pairwise similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions.dates import hours_between
from signalloom.functions.numbers import clamp
from signalloom.functions.text import add_once, headline_text, let, name_phrases, token_set
from signalloom.operators.classify import distinctive_objects, extract_action
from signalloom.operators.ordering import with_positions
from signalloom.session import written

#: Bits of a token's code below its document frequency: how many different tokens there can be.
CODE_BITS = 36
#: Words in so many texts are frequent; so many of them are held by every task.
FREQUENT, MOST_FREQUENT = 4096, 65_536


def doc_freq(df: DataFrame, *texts: str) -> DataFrame:
    """``(token, df)``: in how many texts a token occurs; each column is its own text."""
    sets = F.array(*[token_set(F.col(t)) for t in texts])
    return df.select(F.explode(F.flatten(sets)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def idf(df_count: Column, n_items: Column) -> Column:
    """Smoothed inverse document frequency; unseen tokens count as seen once."""
    return F.log((n_items + 1) / (F.coalesce(df_count, F.lit(1)) + F.lit(0.5))) + 1


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard overlap of two sets, 0 when either is empty."""
    either_empty = (F.size(a) == 0) | (F.size(b) == 0)
    shared = F.size(F.array_intersect(a, b))
    ratio = let(shared, lambda s: s / (F.size(a) + F.size(b) - s))
    return F.when(either_empty, F.lit(0.0)).otherwise(ratio)


def overlap_coefficient(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def similarity(a: Column, b: Column) -> Column:
    sets = F.struct(token_set(a).alias("a"), token_set(b).alias("b"))
    return let(sets, lambda s: jaccard(s["a"], s["b"]))


def phrase_overlap(a: Column, b: Column) -> Column:
    sets = F.struct(name_phrases(a).alias("a"), name_phrases(b).alias("b"))
    return let(sets, lambda s: overlap_coefficient(s["a"], s["b"]))


def token_codes(rows: DataFrame) -> DataFrame:
    """``(token, df, code)`` of rows with ``token``: numbers that sort by document frequency, rarest first.

    The code holds the frequency above :data:`CODE_BITS` bits of a dense number, so a code carries its weight.
    """
    counts = rows.groupBy("token").agg(F.count("*").alias("df"))
    dense = with_positions(counts, F.col("df"), F.col("token"), name="_place")
    return dense.select("token", "df", (F.shiftleft("df", CODE_BITS) + F.col("_place")).alias("code"))


def coded(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows with ``token`` and their ``code``; a very common word stays spread over all tasks.

    The most frequent words, at most :data:`MOST_FREQUENT`, are one small table that every task
    holds; what remains meets its code by key, and no key has more rows than the least frequent of those.
    """
    top = codes.where(F.col("df") >= FREQUENT).orderBy(F.desc("df"), "token").limit(MOST_FREQUENT)
    head = written(top.select("token", "code"), "frequent")
    told = rows.join(F.broadcast(head), "token", "left")
    rest = told.where("code IS NULL").drop("code").join(codes.join(head, "token", "left_anti").select("token", "code"), "token")
    return told.where("code IS NOT NULL").select(*rows.columns, "code").unionByName(rest.select(*rows.columns, "code"))


def _token_rows(df: DataFrame, key: str, texts: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``(key, field, token)`` of all texts, and their :func:`token_codes`.  Texts are cut once, into a row of sets that is written."""
    fields = F.array(
        *[F.struct(F.lit(f).alias("field"), token_set(F.col(c)).alias("t")) for f, c in texts.items()]
    )
    sets = written(df.select(key, F.inline(fields)), "tokens")
    rows = sets.select(key, "field", F.explode("t").alias("token"))
    return rows, written(token_codes(rows), "codes")


def token_totals(df: DataFrame, key: str, texts: dict[str, str], n_items: int) -> DataFrame:
    """Per row its texts' tokens as codes, rarest first, and the sum of their idf: ``key``, ``<field>_tokens``, ``<field>_total``.

    Rows without any token are left out.
    """
    rows, codes = _token_rows(df, key, texts)
    told = coded(rows, codes)

    def of(field: str, column) -> Column:
        return F.when(F.col("field") == field, column)

    columns = []
    for f in texts:
        columns.append(F.sort_array(F.collect_list(of(f, F.col("code")))).alias(f"{f}_tokens"))
        columns.append(F.coalesce(F.sum(of(f, code_weight(F.col("code"), n_items))), F.lit(0.0)).alias(f"{f}_total"))
    return told.groupBy(key).agg(*columns)


def code_weight(code: Column, n_items: int) -> Column:
    return idf(F.shiftright(code, CODE_BITS), F.lit(n_items))


def weighted_jaccard(a: Column, a_total: Column, b: Column, b_total: Column, n_items: int) -> Column:
    """idf-weighted Jaccard of two arrays of token codes."""
    shared = F.aggregate(
        F.array_intersect(a, b), F.lit(0.0), lambda acc, e: acc + code_weight(e, n_items)
    )
    score = let(shared, lambda s: F.coalesce(F.try_divide(s, a_total + b_total - s), F.lit(0.0)))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.0)).otherwise(score)


def event_side(title: Column, desc: Column, actions=V.ACTION_RULES, strong: str = V.STRONG_OBJECTS) -> Column:
    """What :func:`related` compares of a report: struct of ``action`` and ``objects``."""
    return F.struct(
        extract_action(headline_text(title, desc), actions).alias("action"), distinctive_objects(title, desc, strong).alias("objects")
    )


def related(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Add ``match``, ``conflict`` and ``object_overlap`` for pairs of structs of :func:`event_side`."""
    both = F.col(f"{a}.action").isNotNull() & F.col(f"{b}.action").isNotNull()
    same = both & (F.col(f"{a}.action") == F.col(f"{b}.action"))
    return pairs.withColumn("object_overlap", overlap_coefficient(F.col(f"{a}.objects"), F.col(f"{b}.objects"))).withColumns(
        {
            "match": F.coalesce(same & (F.col("object_overlap") > 0), F.lit(False)),
            "conflict": F.coalesce(both & ~same & (F.col("object_overlap") < 0.6), F.lit(False)),
        }
    )


def event_relation(pairs: DataFrame, a: str = "a", b: str = "b", actions=V.ACTION_RULES, strong: str = V.STRONG_OBJECTS) -> DataFrame:
    """Add ``match``, ``conflict`` and ``object_overlap`` for pairs of structs
    with ``title`` and ``desc``."""
    sides = {to: event_side(F.col(f"{c}.title"), F.col(f"{c}.desc"), actions, strong) for to, c in (("_a", a), ("_b", b))}
    return related(add_once(pairs, sides), "_a", "_b").drop("_a", "_b")


#: The fields of an item that a score compares.
COMPARED = [
    "published_at", "category", "entity_ids", "action", "objects", "phrases", "title_tokens", "title_total", "desc_tokens", "desc_total",
]


def _of(side: str, field: str) -> Column:
    return F.col(f"_{side}_{field}")


def _text_similarity(field: str, n_items: int) -> Column:
    a, b = (_of(side, f"{field}_tokens") for side in "xy")
    return weighted_jaccard(a, _of("x", f"{field}_total"), b, _of("y", f"{field}_total"), n_items)


def amplified(content: Column, structure: Column) -> Column:
    return content + structure * F.least(content, F.lit(0.5)) * 1.4


def nearness(hours: Column) -> Column:
    return clamp(F.lit(1.0) - hours / 48.0, 0.0, 1.0)


def _without_descriptions(pairs: DataFrame, n_items: int) -> DataFrame:
    """Add ``_pair``: all of a pair's score that needs no description."""
    both_act = _of("x", "action").isNotNull() & _of("y", "action").isNotNull()
    same_act = F.coalesce(both_act & (_of("x", "action") == _of("y", "action")), F.lit(False))
    one_category = F.coalesce(_of("x", "category") == _of("y", "category"), F.lit(False))
    basics = add_once(
        pairs,
        {
            "_title": F.lit(0.5) * _text_similarity("title", n_items)
            + F.lit(0.3) * overlap_coefficient(_of("x", "phrases"), _of("y", "phrases")),
            "_objects": overlap_coefficient(_of("x", "objects"), _of("y", "objects")),
            "_entity": jaccard(_of("x", "entity_ids"), _of("y", "entity_ids")),
            "_hours": hours_between(_of("x", "published_at"), _of("y", "published_at")),
            "_same": same_act,
            "_clash": both_act & ~same_act,
        },
    )
    objects, entity = F.col("_objects"), F.col("_entity")
    near = nearness(F.col("_hours"))
    agreed = (F.col("_same") & (objects > 0)) | ((objects >= 0.5) & (entity > 0))
    summary = F.struct(
        F.col("_title").alias("title"),
        (F.lit(0.4) * entity + F.lit(0.35) * near + F.lit(0.25) * one_category.cast("double")).alias("structure"),
        (F.col("_clash") & (objects < 0.6)).alias("clash"),
        ((F.col("_hours") <= 72) & agreed).alias("forced"),
    )
    return add_once(basics, {"_pair": summary}).drop("_title", "_objects", "_entity", "_hours", "_same", "_clash")


def pair_score(pairs: DataFrame, n_items: int, x: str = "x", y: str = "y", name: str = "score") -> DataFrame:
    """Same-event score of two feature structs (see ``clusters.item_features``), to nine decimals.

    Agreement in entity, time and category only amplifies shared wording; a
    clash of actions blocks a merge and a shared action on a shared object
    forces one.  Scores are rounded, so that equal wording ties whatever the order its weights were added in.
    """
    def score(content: Column) -> Column:
        return (
            F.when(F.col("_pair.clash"), F.least(content, F.lit(0.15)))
            .when(F.col("_pair.forced"), F.greatest(content, F.lit(0.55)))
            .when(content < 0.02, content)
            .otherwise(amplified(content, F.col("_pair.structure")))
        )

    fields = {f"_{to}_{f}": F.col(f"{side}.{f}") for side, to in ((x, "x"), (y, "y")) for f in COMPARED}
    told = _without_descriptions(pairs.select("*", *[c.alias(n) for n, c in fields.items()]), n_items)
    compared = F.col("_pair.title") + F.lit(0.2) * _text_similarity("desc", n_items)
    return told.withColumn(name, F.round(let(compared, score), 9)).drop("_pair", *fields)
