"""Linking texts to a dimension of entities.

``entities`` is a list of dicts or rows with ``id``, ``importance`` and ``match``
(the terms).  The curated dimension is part of the plan as literals: each entity
is one compiled alternation, so linking is a scan without a join.  For a large
dimension of plain words use :func:`link_terms`, an equi-join on token n-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions.text import add_once, headline_text, literal_term_pattern, matches, normalize_title, plain_words
from signalloom.session import written


#: So many first words of longer terms are looked up in each text; of more, every n-gram is made.
FIRST_WORDS = 1024


def entity_pattern(terms) -> str:
    return "(?:" + "|".join(literal_term_pattern(t) for t in terms) + ")"


def entity_hits(text: Column, entities) -> Column:
    """Matched entities in dimension order: array of ``(id, importance)``."""
    hits = [
        F.when(
            matches(text, entity_pattern(e["match"])),
            F.struct(F.lit(e["id"]).alias("id"), F.lit(int(e["importance"])).alias("importance")),
        )
        for e in entities
    ]
    if not hits:
        return F.array().cast("array<struct<id:string,importance:int>>")
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def match_entities(df: DataFrame, entities, title: str = "title", desc: str = "desc") -> DataFrame:
    """Add ``entity_ids`` and ``max_importance`` (0 without a match)."""
    text = headline_text(F.col(title), F.col(desc))
    return (
        add_once(df, {"_hits": entity_hits(text, entities)})
        .withColumns(
            {
                "entity_ids": F.transform("_hits", lambda h: h["id"]),
                "max_importance": F.coalesce(
                    F.array_max(F.transform("_hits", lambda h: h["importance"])), F.lit(0)
                ),
            }
        )
        .drop("_hits")
    )


def link_terms(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """``(key, id)`` for each entity one of whose plain terms occurs in the text.

    ``terms(id, term)`` may be large: texts become n-grams of as many words as
    the terms have (the sizes that occur are a one-row aggregate) and meet the
    terms in an equi-join; the optimizer broadcasts the terms when they are small
    and splits skewed words otherwise.  Words are compared after normalisation, so
    "gpt 5" also finds "gpt-5": unlike :func:`match_entities`, which looks at the text.
    """
    # written, so that its size is known and small terms go to the words in place of all n-grams to the terms
    known = written(terms.select("id", normalize_title(F.col("term")).alias("_gram")).where("_gram <> ''").distinct(), "terms")
    parts = known.select(F.split("_gram", " ").alias("_parts"))
    sizes = parts.agg(F.collect_set(F.size("_parts")).alias("_sizes"))
    # n-grams are made where a longer term's first word stands, if those are few, and else everywhere
    few = parts.where(F.size("_parts") > 1).select(F.get("_parts", F.lit(0)).alias("_first")).distinct().limit(FIRST_WORDS + 1)
    firsts = few.agg(F.when(F.count("*") <= FIRST_WORDS, F.collect_set("_first")).alias("_firsts"))
    gram = "concat_ws(' ', slice(_w, p + 1, n))"
    starts = "filter(sequence(0, size(_w) - n), p -> _begin IS NULL OR array_contains(_begin, _w[p]))"
    longer = F.expr(f"flatten(transform(filter(_sizes, n -> n > 1 AND n <= size(_w)), n -> transform({starts}, p -> {gram})))")
    single = F.when(F.array_contains("_sizes", 1), F.col("_w")).otherwise(F.array().cast("array<string>"))
    wordy = add_once(df.select(F.col(key), F.col(text).alias("_t")), {"_w": plain_words(F.col("_t"))}).drop("_t")
    told = add_once(wordy.join(F.broadcast(sizes)).join(F.broadcast(firsts)), {"_begin": F.array_intersect("_firsts", "_w")})
    exploded = add_once(told, {"_grams": F.array_distinct(F.concat(single, longer))}).select(key, F.explode("_grams").alias("_gram"))
    return exploded.join(known, "_gram").select(key, "id").distinct()


def entity_activity(linked: DataFrame, entities: DataFrame, ids: str = "entity_ids") -> DataFrame:
    """Signals per entity, zero-filled from the dimension."""
    counts = linked.select(F.explode(ids).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return (
        entities.select("id").distinct().join(counts, "id", "left")
        .select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )


def signals_for_entity(signals: DataFrame, entity_id: str, ids: str = "entity_ids", when: str = "published_at") -> DataFrame:
    """All signals that mention one entity, newest first."""
    return signals.where(F.array_contains(ids, entity_id)).orderBy(F.col(when).desc_nulls_last())
