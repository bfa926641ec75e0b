"""Grouping reports of one event.

Semantics: items are visited in pool order; each joins the group whose current
representative scores best against it (first group on ties) if the score reaches
the threshold, else it founds a group; a joining item dated strictly earlier
becomes the representative.

Scoring is the work, and it is distributed: blocks of items meet blocks of items, and no pair travels before its score is known (``tiles``).

The reading itself is sequential: whether an item is still a representative depends on all choices
before it, and those choices on others before them.  So the pool is read in slices.  A slice's items meet each
other and the representatives that the slices before left, in parallel; the scored pairs of a slice fall into
connected components, which are read in order, one task a component.  The work of a slice is bounded by its
rows times itself and the representatives; pairs of items in different slices, of which one no longer
represents anything, are never looked at.  A third of all rows being copies costs linear work
for that reason.  There are as many rounds as slices.  Nothing is capped or sampled.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions.text import headline_text, name_phrases
from signalloom.operators.classify import distinctive_objects, extract_action
from signalloom.operators.entities import match_entities
from signalloom.operators.ordering import with_positions
from signalloom.operators.similarity import COMPARED, pair_score, token_totals
from signalloom.operators.tiles import packed, scores
from signalloom.session import discard, written

ROWS_PER_SALT = 4096  # rows that one task gets of one side at a time
SLICE_ROWS = 4096  # of the pool, read against each other and the representatives
COMPONENT_PAIRS = 4_000_000  # a slice with more scored pairs is cut into components


@dataclass
class Clustering:
    """``items`` with ``pos`` and ``cluster`` (position of the founder), the
    ``clusters`` (representatives) and the ``sources`` as long tables."""

    items: DataFrame
    clusters: DataFrame
    sources: DataFrame
    rounds: int


def item_features(items: DataFrame, entities, n_items: int, actions=V.ACTION_RULES, strong: str = V.STRONG_OBJECTS) -> DataFrame:
    """What a pair comparison needs, one row per item keyed by ``pos``."""
    texts = {"title": "title", "desc": "desc"}
    per_item = token_totals(items, "pos", texts, n_items)
    title, desc = F.col("title"), F.col("desc")
    described = match_entities(items, entities).select(
        "pos", "published_at", "category", "entity_ids",
        extract_action(headline_text(title, desc), actions).alias("action"),
        distinctive_objects(title, desc, strong).alias("objects"),
        name_phrases(title).alias("phrases"),
    )
    blank = {"tokens": F.array().cast("array<bigint>"), "total": F.lit(0.0)}
    return described.join(per_item, "pos", "left").withColumns(
        {f"{name}_{column}": F.coalesce(f"{name}_{column}", empty) for name in texts for column, empty in blank.items()}
    )


def scored_pairs(pairs: DataFrame, features: DataFrame, threshold: float, n_items: int) -> DataFrame:
    """``(i, j, score, i_ts, j_ts)`` of the pairs that reach the threshold."""
    def side(end: str, name: str) -> DataFrame:
        return features.select(F.col("pos").alias(end), F.struct(*COMPARED).alias(name), F.unix_micros("published_at").alias(f"{end}_ts"))

    both = pairs.join(side("i", "x"), "i").join(side("j", "y"), "j")
    return pair_score(both, n_items).where(F.col("score") >= threshold).select("i", "j", "score", "i_ts", "j_ts")


def near_dup_pairs(features: DataFrame, threshold: float, n_items: int) -> DataFrame:
    """All pairs ``(i, j, score)``, ``i > j``, of items that score at least ``threshold``."""
    blocks = written(packed(features, ROWS_PER_SALT, n_items), "blocks")
    return scores(blocks, blocks, threshold, n_items, once=True).select("i", "j", "score")


def _components(pairs: DataFrame) -> DataFrame:
    """``(pos, component)``: smallest position reachable over the pairs."""
    ends = written(
        pairs.select(F.inline(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")),
                                      F.struct(F.col("j").alias("a"), F.col("i").alias("b"))))),
        "ends",
    )
    labels = written(
        ends.groupBy(F.col("a").alias("pos")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels"
    )
    while True:
        named = labels.select(F.col("pos").alias("b"), F.col("component").alias("_c"))
        lowest = ends.join(named, "b").groupBy(F.col("a").alias("pos")).agg(F.min("_c").alias("_m"))
        met = labels.join(lowest, "pos").select(
            "pos", F.col("component").alias("_old"), F.least("component", "_m").alias("component")
        )
        ahead = labels.select(F.col("pos").alias("component"), F.col("component").alias("_c"))
        moved = written(
            met.join(ahead, "component").select(
                "pos", F.least("component", "_c").alias("component"), (F.least("component", "_c") != F.col("_old")).alias("_moved")
            ),
            "labels",
        )
        labels = moved.select("pos", "component")
        if not moved.where("_moved").limit(1).count():
            return labels


def _walker(first: int):
    """The reading of one component of a slice that begins at ``first``, as a closure, so that workers need not import this module."""

    def walk(pairs):
        """Choices in position order (pandas in and out)."""
        import numpy as np
        import pandas as pd

        ordered = pairs.sort_values(["i", "j"])
        at, to, score, founders, i_ts, j_ts = (ordered[c].to_numpy() for c in ("i", "j", "score", "founder", "i_ts", "j_ts"))
        ids = np.unique(np.concatenate([at, to]))
        own, other = np.searchsorted(ids, at), np.searchsorted(ids, to)
        group = np.full(len(ids), -1)  # of a representative: the founder of its group; -1: not a representative
        group[other] = np.where(to < first, founders, to)  # left by earlier slices, or the founder of a group of its own,
        group[own] = -1  # but what meets something before it is read in its turn
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rows = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
            offers = group[other[s:e]]
            open_to = np.flatnonzero(offers >= 0)
            if not len(open_to):
                group[own[s]] = at[s]
                continue
            reached = score[s:e][open_to]
            equal = open_to[reached == reached.max()]
            k = int(equal[np.argmin(offers[equal])])
            founder, takes_over = int(offers[k]), bool(i_ts[s + k] < j_ts[s + k])
            rows.append((int(at[s]), int(to[s + k]), founder, takes_over))
            if takes_over:
                group[other[s + k]] = -1
                group[own[s]] = founder
        return pd.DataFrame(rows, columns=["pos", "choice", "cluster", "takes_over"]).astype({"pos": "int64", "choice": "int64", "cluster": "int64", "takes_over": "bool"})

    return walk


def event_clusters(
    items: DataFrame,
    entities=(),
    threshold: float = V.CLUSTER_THRESHOLD,
    order: tuple[Column, ...] | None = None,
    actions=V.ACTION_RULES,
    strong: str = V.STRONG_OBJECTS,
    slice_rows: int | None = None,
    component_pairs: int = COMPONENT_PAIRS,
) -> Clustering:
    """Group ``items(title, desc, published_at, link, source_name, category, ...)``.

    ``order`` is the pool order; the default is newest first, then ``link``.
    """
    order = order or (F.col("published_at").desc(), F.col("link"))
    placed = written(with_positions(items, *order), "items")
    spark = placed.sparkSession
    n_items = placed.count()
    rows = slice_rows or SLICE_ROWS
    # slices are read one after the other: files in order, so that a slice's are few
    features = written(item_features(placed, entities, n_items, actions, strong).repartitionByRange(max(1, ceil(n_items / rows)), "pos"), "features")

    reps, held, chosen = None, None, []
    for first in range(0, n_items, rows):
        fresh = features.where(F.col("pos").between(first, first + rows - 1))
        new = written(packed(fresh, ROWS_PER_SALT, rows), "fresh")
        if reps is None:
            scored = written(scores(new, new, threshold, n_items, once=True), "scored")
        else:
            stored = written(packed(held, ROWS_PER_SALT, held.count()), "stored")
            scored = written(scores(new, stored.unionByName(new), threshold, n_items, once=False), "scored")
            discard(stored)
        if reps is None:
            told = scored.withColumn("founder", F.lit(None).cast("bigint"))
        else:
            told = scored.join(reps.select(F.col("pos").alias("j"), F.col("cluster").alias("founder")), "j", "left")
        told = told.withColumn("founder", F.coalesce("founder", "j"))
        if scored.count() > component_pairs:
            told = told.join(_components(scored).withColumnRenamed("pos", "i"), "i")
        else:
            told = told.withColumn("component", F.lit(0).cast("bigint"))
        walked = told.groupBy("component").applyInPandas(_walker(first), "pos bigint, choice bigint, cluster bigint, takes_over boolean")
        choice = written(walked, "chosen")
        chosen.append(choice)
        before, reps = reps, written(_representatives(spark, reps, choice, first, min(first + rows, n_items)), "representatives")
        past, held = held, written((fresh if held is None else held.unionByName(fresh)).join(reps.select("pos"), "pos", "left_semi"), "held")
        discard(new, scored, *([] if before is None else [before, past]))

    if not chosen:
        return Clustering(placed.withColumn("cluster", F.col("pos")), *_cluster_tables(placed.withColumn("cluster", F.col("pos")), placed.select("pos")), 0)
    choices = spark.read.schema(chosen[0].schema).parquet(*[c._written_to for c in chosen]).select("pos", "cluster")
    assigned = written(placed.join(choices, "pos", "left").withColumn("cluster", F.coalesce("cluster", "pos")), "assigned")
    discard(features, held, *chosen)
    return Clustering(assigned, *_cluster_tables(assigned, reps.select("pos")), len(chosen))


def _representatives(spark, before: DataFrame | None, choice: DataFrame, first: int, end: int) -> DataFrame:
    """``(pos, cluster)`` of the groups' representatives after a slice: the ones before, founders and takers-over, but those taken over."""
    told = spark.range(first, end).withColumnRenamed("id", "pos").join(choice, "pos", "left")
    new = told.where(F.col("choice").isNull() | F.col("takes_over")).select("pos", F.coalesce("cluster", "pos").alias("cluster"))
    taken = choice.where("takes_over").select(F.col("choice").alias("pos"))
    every = new if before is None else before.unionByName(new)
    return every.join(taken, "pos", "left_anti")


def _cluster_tables(assigned: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
    sources = cluster_sources(assigned)
    counts = sources.groupBy("cluster").agg(F.count("*").alias("source_count"))
    clusters = assigned.join(last, "pos", "left_semi").join(counts, "cluster")
    return clusters, sources


def cluster_sources(assigned: DataFrame) -> DataFrame:
    """One row per distinct link of a cluster, named as first seen."""
    return assigned.groupBy("cluster", "link").agg(
        F.min_by("source_name", "pos").alias("source_name"), F.min("pos").alias("first_pos")
    )
