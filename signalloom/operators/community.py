"""Discussion counts and representative comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions.numbers import clamp, round_half_up
from signalloom.functions.text import add_once, token_set
from signalloom.operators.classify import classify_topics, is_release_discussion, match_models
from signalloom.operators.ordering import grouped_rank
from signalloom.operators.scoring import (
    comment_completeness, comment_relevance, community_recency, theme_specificity,
)
from signalloom.session import written


def story_coverage(counts: DataFrame) -> DataFrame:
    """Exact only when everything was fetched, else scaled from the sample.

    Needs ``raw_hits``, ``fetched_count``, ``validated_count``, ``sample_size``.
    """
    raw = F.coalesce("raw_hits", F.lit(0))
    coverage = F.when(raw == 0, F.lit(1.0)).otherwise(clamp(F.try_divide("fetched_count", raw), 0.0, 1.0))
    ratio = F.coalesce(F.try_divide("validated_count", "sample_size"), F.lit(0.0))
    return counts.withColumn("coverage", coverage).withColumns(
        {
            "is_estimated": F.col("coverage") < 1,
            "relevant_discussions": F.when(F.col("coverage") >= 1, F.col("validated_count")).otherwise(
                round_half_up(raw * ratio)
            ).cast("bigint"),
        }
    )


def board_window(rows: DataFrame, since: Column, by: list[str], when: str = "created_at") -> DataFrame:
    """Discussions since a moment; estimated while even the oldest is that recent."""
    return rows.groupBy(*by).agg(
        F.count_if(F.col(when) >= since).alias("discussions"),
        F.coalesce(F.min(when) >= since, F.lit(False)).alias("is_estimated"),
    )


def with_topics(rows: DataFrame, text: str, topics=V.TOPICS, at_most: int = 2) -> DataFrame:
    return rows.withColumn("topics", F.slice(classify_topics(F.col(text), topics), 1, at_most))


def theme_counts(rows: DataFrame, by: str = "model", topics: str = "topics") -> DataFrame:
    return rows.select(by, F.explode(topics).alias("theme")).groupBy(by, "theme").agg(F.count("*").alias("n"))


def story_points(rows: DataFrame, by: str = "model", points: str = "points") -> DataFrame:
    return rows.groupBy(by).agg(F.sum(F.coalesce(points, F.lit(0))).alias("points"))


def model_totals(sources: DataFrame, by: str = "model", limited_below: int = V.LIMITED_SAMPLE) -> DataFrame:
    """Totals over a model's sources; one estimate makes the total an estimate."""
    return sources.groupBy(by).agg(
        F.sum("discussions").alias("discussions"), F.bool_or("is_estimated").alias("is_estimated")
    ).withColumn("limited", F.col("discussions") < limited_below)


def theme_weights(rows: DataFrame, by: str = "model", topics: str = "topics") -> DataFrame:
    """One row per model: its themes' specificities as a map.

    Rows are counted by their list of topics first (a few lists per model), so one pass
    over the texts gives theme counts and totals.
    """
    patterns = rows.groupBy(by, F.col(topics).alias("_topics")).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(by)).alias("_total")  # a few rows per model
    summed = patterns.select(by, total, "_n", "_topics")
    counts = summed.select(by, "_total", "_n", F.explode_outer("_topics").alias("theme")).groupBy(by, "_total", "theme").agg(F.sum("_n").alias("n"))
    entry = F.struct("theme", theme_specificity(F.col("n"), F.col("_total")).alias("w"))
    return counts.where("theme IS NOT NULL").groupBy(by).agg(F.map_from_entries(F.collect_list(entry)).alias("_weights"))


def _mean_weight(topics: str) -> Column:
    weights = F.transform(topics, lambda t: F.element_at("_weights", t))
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a + w) / F.size(topics)


def theme_specificities(rows: DataFrame, key: list[str], by: str = "model", topics: str = "topics") -> DataFrame:
    """Mean specificity of each row's themes; rows without any drop out.

    The weights are one small map per model that is joined to the rows; rows are not
    exploded and not shuffled.
    """
    return rows.where(F.size(topics) > 0).join(theme_weights(rows, by, topics), by).select(*key, by, _mean_weight(topics).alias("specificity"))


def score_comments(
    validated: DataFrame, as_of, key: str = "comment_id", by: str = "model", text: str = "text",
    when: str = "published_at",
) -> DataFrame:
    """Relevance of validated comments that carry a topic.

    Needs ``match_confidence`` and ``topics``; counts cover all validated rows.  Texts are
    matched twice: for the weights and for the rows.
    """
    told = validated.where(F.size("topics") > 0).join(theme_weights(validated, by), by)
    return told.withColumn("specificity", _mean_weight("topics")).drop("_weights").withColumn(
        "relevance",
        comment_relevance(
            F.col("match_confidence"), F.col("specificity"), comment_completeness(F.col(text)),
            community_recency(F.col(when), as_of),
        ),
    )


def _leaders(ready: DataFrame, models: list[str], by: str, key: str, depth: int, copies: Column, most: int) -> DataFrame:
    """Per model the ``depth`` first rows and one more, numbered by ``_at``; ``copies``, ``most`` at most: so many rows of one wording are enough."""
    first = [F.desc("_rank"), F.desc(key)]
    alike = Window.partitionBy(by, "_topic", "_wording").orderBy(*first)
    # the literal bound is what Spark can apply per task, before the shuffle
    different = ready.withColumn("_n", F.row_number().over(alike)).where((F.col("_n") <= most) & (F.col("_n") <= copies)).drop("_n")
    if depth < 1000:  # Spark keeps the first rows of a group per task, before the shuffle
        return different.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(*first))).where(F.col("_at") <= depth + 1)
    tops = [different.where(F.col(by) == m).orderBy(*first).limit(depth + 1) for m in models]
    return reduce(DataFrame.unionByName, tops).withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(*first)))


def pick_distinct(
    rows: DataFrame, k: int, by: str, key: str, text: str, order: Column,
    models: list[str], limit_similarity: float = V.NEAR_DUPLICATE_SIMILARITY,
    chosen: list | None = None, unique: str | None = None, depth: int = 64,
) -> list:
    """Best rows per model that differ from each other and from what is chosen.

    Greedy by ``order``: a row too similar to an earlier pick is passed over, and
    a comment goes to the first model in ``models`` that picks it.

    One pass over the rows keeps each model's ``depth`` first ones; the driver gets those, models x depth
    rows, and picks from them.  Rows of equal wording block each other, so that of each wording only as many are kept
    as models may take them.  The picks are certain where a model got its ``k``, or where nothing was left
    behind.  Models of which neither holds, and those after them, are asked again, eight times as deep; what was picked so far stays.
    """
    topic = F.col(unique).cast("string") if unique else F.lit("")
    told = add_once(rows.select(by, key, F.col(text).alias("_text"), topic.alias("_topic"), order.alias("_rank")), {"_tokens": token_set(F.col("_text"))}).drop("_text")
    ready = told.withColumn("_wording", F.xxhash64(F.array_sort("_tokens")))
    held = {m: [] for m in models}
    for m, _, t, *_ in chosen or []:
        held.setdefault(m, []).append(frozenset(t))
    # texts without words are like no other, themselves included
    single = F.lit(False) if limit_similarity >= 1 else F.size("_tokens") > 0
    copies = F.when(single, F.lit(len(models))).otherwise(F.lit(len(models) * k))
    picks: list = []
    taken: set = set()
    open_models = list(models)
    while open_models:
        found = _leaders(ready.where(F.col(by).isin(open_models)), open_models, by, key, depth, copies, len(models) * k).collect()
        by_model: dict = {m: [] for m in open_models}
        for row in sorted(found, key=lambda r: r["_at"]):
            by_model[row[by]].append(row)
        for m in list(open_models):
            mine, seen, topics = [], list(held[m]), set()
            for row in by_model[m]:
                if len(mine) == k or row["_at"] > depth:
                    break
                words = frozenset(row["_tokens"])
                near = any(_jaccard(words, s) > limit_similarity for s in seen)
                if row[key] in taken or near or row["_topic"] in topics or any(row[key] == i for _, i, _, _ in mine):
                    continue
                mine.append((m, row[key], row["_tokens"], len(mine)))
                seen.append(words)
                if unique and row["_topic"] is not None:
                    topics.add(row["_topic"])
            if len(mine) < k and len(by_model[m]) > depth:
                break  # rows behind the leaders may still be picked
            picks += mine
            taken |= {i for _, i, _, _ in mine}
            open_models.remove(m)
        depth *= 8
    return picks


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def representative_comments(
    comments: DataFrame, models: list[str], k: int = 4, key: str = "comment_id", by: str = "model", text: str = "text",
) -> DataFrame:
    """The ``k`` most relevant, mutually different comments per model, ranked; relevance counts to nine decimals."""
    picks = pick_distinct(comments, k, by, key, text, F.round("relevance", 9), models)
    spark = comments.sparkSession
    chosen = spark.createDataFrame(
        [(m, i, n + 1) for m, i, _, n in picks], f"{by} string, {key} {dict(comments.dtypes)[key]}, rank int"
    )
    return comments.join(F.broadcast(chosen), [by, key])


def release_talk(comments: DataFrame, text: str, matchers: dict, context: str, topics, release: str) -> DataFrame:
    """Comments validly about a model that talk about a release, with up to two topics."""
    found = match_models(comments, text, matchers, context).where(is_release_discussion(F.col(text), release))
    return with_topics(found, text, topics)


def community_record(
    validated: DataFrame, models: list[str], as_of, posts: DataFrame | None = None, board: DataFrame | None = None,
    k: int = 4, first_party: int = 2, key: str = "comment_id", by: str = "model", text: str = "text", when: str = "published_at",
) -> tuple[DataFrame, DataFrame]:
    """The record of all models: ``(themes, voices)``.

    ``validated`` comes from :func:`release_talk`; ``posts`` (with ``topic_id``) and ``board`` are
    first-party voices with ``topics``.  Themes are counted over all three.  Voices are up
    to ``k`` comments by relevance, then up to ``first_party`` posts and board threads by
    date, each unlike what its model shows already; posts come one per topic.  They are
    merged turn by turn, first-party sources first.  Texts are matched once: the narrow
    rows are written and read by all parts.
    """
    narrow = written(validated.select(key, by, "match_confidence", "topics", text, when), "validated")
    spark = narrow.sparkSession
    kind = dict(narrow.dtypes)[key]
    picked = {"comments": pick_distinct(score_comments(narrow, as_of, key, by, text, when), k, by, key, text, F.round("relevance", 9), models)}
    shown, themes = list(picked["comments"]), narrow.select(by, "topics")
    for name, source, unique in (("forum", posts, "topic_id"), ("board", board, None)):
        if source is not None:
            themes = themes.unionByName(source.select(by, "topics"))
            told = source.where(F.size("topics") > 0)
            picked[name] = pick_distinct(
                told, first_party, by, key, text, F.unix_micros(when).cast("double"), models, chosen=shown, unique=unique
            )
            shown = shown + list(picked[name])
    rows = [(m, name, i, n + 1) for name, picks in picked.items() for m, i, _, n in picks]
    voices = spark.createDataFrame(rows, f"{by} string, source string, {key} {kind}, rank int")
    return theme_counts(themes, by), interleave(voices, by, "source", "rank", ["forum", "board", "comments"])


def newest_per_topic(
    posts: DataFrame, models: list[str], chosen: list, k: int = 2, key: str = "post_id", by: str = "model",
    text: str = "text", topic: str = "topic_id", when: str = "published_at",
) -> list:
    """Forum voices: newest first, one per topic, unlike what is already chosen."""
    return pick_distinct(posts, k, by, key, text, F.unix_micros(when).cast("double"), models,
                         chosen=chosen, unique=topic)


def interleave(rows: DataFrame, by: str, source: str, rank: str, priority: list[str]) -> DataFrame:
    """Round-robin over ranked lists: all firsts in source order, then all seconds.

    A model may hold most rows, so positions come from one sort across all tasks.
    """
    turn = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(source))
    placed = grouped_rank(rows.withColumn("_turn", turn), [by], F.col(rank), F.col("_turn"), name="position")
    return placed.withColumn("position", F.col("position").cast("int")).drop("_turn")


def unused(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return rows.join(used.select(key).distinct(), key, "left_anti")


def paginate(pages: DataFrame, by: list[str], max_pages: int = 3, page_size: int = 100) -> DataFrame:
    """Fetch totals per query from landed pages ``(query, page, nb_hits, page_hits)``.

    Pages after a short one, after a missing one, after the reported total is
    reached, or beyond the page limit do not count, as they would not have been
    requested.  A query has at most ``max_pages`` pages, which bounds the window.
    """
    before = Window.partitionBy(*by).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy(*by).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    fetched = F.sum("page_hits").over(until)
    ends = (F.col("page_hits") < page_size) | (fetched >= F.max("nb_hits").over(until))
    gap = F.col("page") != F.row_number().over(Window.partitionBy(*by).orderBy("page")) - 1
    marked = pages.where(F.col("page") < max_pages).withColumn("_ends", ends).withColumn("_gap", gap)
    stopped = F.coalesce(F.bool_or("_ends").over(before), F.lit(False)) | F.col("_gap")
    used = marked.withColumn("_stopped", stopped).where(~F.col("_stopped"))
    return used.groupBy(*by).agg(F.max("nb_hits").alias("raw_hits"), F.sum("page_hits").alias("fetched_count"))
