"""The batch pipeline: raw items to scored, cluster-level signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions.text import add_once, stable_id
from signalloom.operators.classify import (
    apply_integrity_caps, categorize, classify_verification, wave_family,
)
from signalloom.operators.clusters import Clustering, event_clusters
from signalloom.operators.entities import match_entities
from signalloom.operators.history import staleness_filter
from signalloom.operators.scoring import significance


@dataclass
class Lexicon:
    """Everything word-like the pipeline needs; the defaults are the fixed values."""

    categories: dict = None
    actions: list = None
    strong_objects: str = None
    official: list = None

    def __post_init__(self):
        self.categories = self.categories or V.CATEGORY_RULES
        self.actions = self.actions or V.ACTION_RULES
        self.strong_objects = self.strong_objects or V.STRONG_OBJECTS
        self.official = self.official or V.OFFICIAL_SOURCES


def enrich(clustering: Clustering, entities, as_of, official=V.OFFICIAL_SOURCES) -> DataFrame:
    """Score, verify, cap and identify the clusters."""
    own = clustering.sources.groupBy("cluster").agg(
        F.bool_or(F.col("source_name").isin(list(official))).alias("_official")
    )
    linked = match_entities(clustering.clusters.join(own, "cluster"), entities)
    scored = add_once(
        linked,
        {
            "significance": significance(
                F.col("published_at"), F.col("source_count"), F.col("max_importance"), F.col("category"),
                F.col("cat_confidence"), as_of,
            ),
            "verification": classify_verification(
                F.col("title"), F.col("desc"), F.col("category"), F.col("source_count"), F.col("_official")
            ),
        },
    )
    return project_signal(apply_integrity_caps(scored))


def project_signal(clusters: DataFrame) -> DataFrame:
    return clusters.select(
        F.col("link").alias("id"), stable_id(F.col("link")).alias("cluster_id"), "cluster", "title", "desc", "link",
        "published_at", "category", "cat_confidence", wave_family(F.col("category")).alias("family"), "significance",
        "impact", "verification", "capped", "cap_reason", "source_count", "source_name", "entity_ids",
    )


def build_signals(
    items: DataFrame, entities, as_of, lexicon: Lexicon | None = None, threshold: float = V.PIPELINE_CLUSTER_THRESHOLD
) -> tuple[DataFrame, Clustering]:
    """Fresh items, newest first, categorised, grouped and scored."""
    lexicon = lexicon or Lexicon()
    pool = categorize(staleness_filter(items, as_of), lexicon.categories)
    groups = event_clusters(
        pool, entities, threshold, actions=lexicon.actions, strong=lexicon.strong_objects
    )
    return enrich(groups, entities, as_of, lexicon.official), groups
