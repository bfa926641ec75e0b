"""Routing stories to sections and cutting the published lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions.dates import HOUR, moment, seconds_between
from signalloom.functions.text import add_once, headline_text, truncate, with_headline
from signalloom.operators.classify import (
    detect_lab, detect_license, infer_field, is_product_release, wave_family, why_it_matters,
)
from signalloom.operators.ordering import grouped_rank
from signalloom.operators.rankings import top_k


def section_routing(
    stories: DataFrame, labs=V.LAB_RULES, release_labs=V.RELEASE_LABS, shipping: str = V.RELEASE_SHIPPING,
    question: str = V.QUESTION_HEADLINE,
) -> DataFrame:
    """Every story goes to one section: release, opensource, research or wire."""
    lab = detect_lab(F.col("_text"), labs, F.col("_lower"))
    release = F.col("lab").isin(release_labs) & is_product_release(F.col("title"), F.col("desc"), shipping, question)
    section = (
        F.when(F.coalesce(release, F.lit(False)), F.lit("release"))
        .when(F.col("category") == "opensource", F.lit("opensource"))
        .when(F.col("category") == "research", F.lit("research"))
        .otherwise(F.lit("wire"))
    )
    told = add_once(with_headline(stories), {"lab": lab}).drop("_text", "_lower")
    return add_once(told, {"section": section})


def releases_per_lab(routed: DataFrame, labs: DataFrame, k: int = 5, tie: str = "link") -> DataFrame:
    """Newest releases of each fixed lab; a lab without any keeps one empty row."""
    newest = top_k(routed.where("section = 'release'"), k, ["lab"], F.desc("published_at"), F.col(tie))
    return labs.select("lab").join(newest, "lab", "left").withColumn("headline", truncate(F.col("title"), 90))


def video_attachment(stories: DataFrame, sources: DataFrame, marker: str = r"\(YouTube\)") -> DataFrame:
    """Per cluster the first merged video link; ``is_video`` if it is the story's own."""
    videos = sources.where(F.col("source_name").rlike(marker)).groupBy("cluster").agg(
        F.min_by("link", "first_pos").alias("_video")
    )
    own = F.coalesce(F.col("_video") == F.col("link"), F.lit(False))
    return stories.join(videos, "cluster", "left").withColumns(
        {"is_video": own, "video_url": F.when(~own, F.col("_video"))}
    ).drop("_video")


def wire_top(routed: DataFrame, k: int = 8, order: str = "cluster") -> DataFrame:
    """Remaining stories in group order (newest group first)."""
    return routed.where("section = 'wire'").orderBy(order).limit(k).withColumns(
        {"headline": truncate(F.col("title"), 80), "body": _body(260)}
    )


def open_weight_feed(routed: DataFrame, k: int = 8, order: str = "cluster", licenses=V.LICENSE_RULES) -> DataFrame:
    text = headline_text(F.col("title"), F.col("desc"))
    return (
        routed.where("section = 'opensource'").orderBy(order).limit(k)
        .withColumn("_l", detect_license(text, licenses))
        .withColumns({"headline": truncate(F.col("title"), 60), "license": F.col("_l.lic"), "license_class": F.col("_l.lic_class")})
        .drop("_l")
    )


def research_top(routed: DataFrame, k: int = 6, tie: str = "link", fields=V.FIELD_RULES) -> DataFrame:
    text = headline_text(F.col("title"), F.col("desc"))
    return (
        routed.where("section = 'research'").orderBy(F.desc("published_at"), tie).limit(k)
        .withColumns({"field": infer_field(text, fields), "headline": truncate(F.col("title"), 80), "body": _body(260)})
    )


def _body(n: int) -> Column:
    short = truncate(F.col("desc"), n)
    return F.when(short == "", F.col("title")).otherwise(short)


def signals_by_significance(signals: DataFrame, k: int = 40, tie: str = "cluster") -> DataFrame:
    return signals.orderBy(F.desc("significance"), tie).limit(k)


def ticker_top(signals: DataFrame, k: int = 10, tie: str = "cluster") -> DataFrame:
    top = signals_by_significance(signals, k, tie)
    return top.withColumn("headline", F.upper(truncate(F.col("title"), 110)))


def leading_waves(signals: DataFrame, tie: str = "cluster") -> DataFrame:
    """Most significant development of each family, commentary left out."""
    eligible = signals.where(~F.col("category").isin(V.COMMENTARY_CATEGORIES)).withColumn(
        "family", wave_family(F.col("category"))
    )
    return top_k(eligible, 1, ["family"], F.desc("significance"), F.col(tie)).drop("rank")


def top_wave_per_family(signals: DataFrame, tie: str = "cluster", **wording) -> DataFrame:
    """The :func:`leading_waves` with the sentence why they matter."""
    return why_it_matters(leading_waves(signals, tie), **wording)


def family_groups(signals: DataFrame, as_of, hours: int = 24, when: str = "published_at", tie: str = "id") -> DataFrame:
    """Dated developments of the last ``hours`` by family, with their order in it.

    Undated and future rows fall out.  The order is a global sort key
    (family, significance), not a window over a whole family.
    """
    end = moment(as_of)
    recent = F.col(when).between(end - F.expr(f"INTERVAL {int(hours)} HOURS"), end)
    kept = signals.where(~F.col("category").isin(V.COMMENTARY_CATEGORIES) & recent)
    return kept.withColumn("family", wave_family(F.col("category"))).orderBy(
        "family", F.desc(F.coalesce("significance", F.lit(0))), tie
    )


def ranked_families(signals: DataFrame, as_of, hours: int = 24, when: str = "published_at", tie: str = "id") -> DataFrame:
    """:func:`family_groups` with ``rank``, the 1-based place inside the family.

    Families are few and may hold all rows, so places come from one sort across all tasks.
    """
    grouped = family_groups(signals, as_of, hours, when, tie)
    ranked = grouped_rank(grouped, ["family"], F.desc(F.coalesce("significance", F.lit(0))), F.col(tie))
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def latest_previews(signals: DataFrame, waves: DataFrame, ticker: int = 12, lead: int = 3, newest: int = 3, tie: str = "id") -> DataFrame:
    """What a front page previews: ``(panel, rank, id)`` of the most significant
    signals, the leading waves and the newest signals.  Three global limits."""
    def panel(df: DataFrame, name: str, k: int, *order) -> DataFrame:
        first = df.orderBy(*order).limit(k)  # k rows from here on
        place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order))
        return first.select(F.lit(name).alias("panel"), place.alias("rank"), F.col(tie).alias("id"))

    strong = [F.desc(F.coalesce("significance", F.lit(0))), F.col(tie)]
    return (
        panel(signals, "ticker", ticker, *strong)
        .unionByName(panel(waves, "waves", lead, *strong))
        .unionByName(panel(signals, "river", newest, F.col("published_at").desc_nulls_last(), F.col(tie)))
    )


def family_counts(grouped: DataFrame, families=V.FAMILIES) -> DataFrame:
    """All families, also the empty ones."""
    spark = grouped.sparkSession
    dimension = spark.createDataFrame([(f,) for f in families], "family string")
    counts = grouped.groupBy("family").agg(F.count("*").alias("n"))
    return dimension.join(counts, "family", "left").select("family", F.coalesce("n", F.lit(0)).alias("n"))


def resolve_sources(summaries: DataFrame, signals: DataFrame, ids: str = "source_ids", key: str = "id") -> DataFrame:
    """Listed source ids as live signals, in listed order; unknown ids drop out."""
    listed = summaries.select("family", F.posexplode(ids).alias("position", key))
    return listed.join(signals, key)


def summary_usable(summaries: DataFrame, as_of, families=V.FAMILIES, max_age_hours: int = 36, method: str = "ai-written") -> DataFrame:
    """One row per summary document: may it be shown?

    ``summaries(summary_id, method, generated_at, family, bullets)`` has one row per family.
    """
    filled = (F.size("bullets") > 0) & F.forall("bullets", lambda b: F.length(F.trim(F.coalesce(b, F.lit("")))) > 0)
    age = seconds_between(moment(as_of), F.col("generated_at")) / HOUR
    fresh = (F.col("method") == method) & (age <= max_age_hours)
    good = F.coalesce(filled & fresh & F.col("family").isin(families), F.lit(False))
    return summaries.groupBy("summary_id").agg(
        (F.count_distinct(F.when(good, F.col("family"))) == len(families)).alias("usable")
    )


def feed_health(feeds: DataFrame, models: DataFrame, nodes: DataFrame, depth_days: float) -> DataFrame:
    """One health row from ``feeds(name, ok)``, ``models(model, is_estimated)`` and ``nodes``."""
    f = feeds.agg(F.count_if("ok").alias("feeds_succeeded"), F.count("*").alias("feeds_configured"))
    m = models.agg(F.count("*").alias("models_available"), F.count_if("is_estimated").alias("estimated_datasets"))
    n = nodes.agg(F.count("*").alias("nodes_available"))
    one_row = f.join(F.broadcast(m)).join(F.broadcast(n))
    return one_row.withColumn("history_depth_days", F.lit(float(depth_days)))
