"""Recency, significance and small scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions.dates import HOUR, moment, seconds_between
from signalloom.functions.numbers import clamp, round_half_up
from signalloom.functions.text import SPACE, is_quote_only, trim_all, word_count
from signalloom.operators.classify import category_weight


def recency_score(published: Column, as_of, horizon_hours: float = 72) -> Column:
    """Linear decay from 1 to 0 over the horizon."""
    hours = seconds_between(moment(as_of), published) / HOUR
    return clamp(F.lit(1.0) - hours / F.lit(float(horizon_hours)), 0.0, 1.0)


def significance(
    published: Column, source_count: Column, max_importance: Column, category: Column,
    cat_confidence: Column, as_of,
) -> Column:
    """0-100 blend of recency, sources, entity importance and category."""
    sources = F.least(F.greatest(F.coalesce(source_count, F.lit(1)), F.lit(1)), F.lit(4)) / F.lit(4.0)
    blend = (
        F.lit(0.35) * recency_score(published, as_of)
        + F.lit(0.25) * sources
        + F.lit(0.25) * (max_importance / F.lit(100.0))
        + F.lit(0.15) * category_weight(category)
    )
    unsure = F.coalesce(cat_confidence, F.lit(1.0)) < V.LOW_CATEGORY_CONFIDENCE
    damped = blend * F.when(unsure, F.lit(0.8)).otherwise(F.lit(1.0))
    return round_half_up(clamp(damped, 0.0, 1.0) * 100).cast("int")


def comment_completeness(text: Column) -> Column:
    """Does a comment read as a finished thought?"""
    t = trim_all(F.coalesce(text, F.lit("")))
    ends = t.rlike(rf"""[.!?]["')\]]?{SPACE}*\z""") | t.rlike(rf"""[.!?]["')\]]?{SPACE}+[A-Z]""")

    def gain(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    total = (
        F.lit(0.5)
        + gain(word_count(t) >= 15, 0.2)
        + gain(word_count(t) >= 30, 0.1)
        + gain(ends, 0.15)
        + gain(is_quote_only(t), -0.4)
        + gain(F.length(t) < 40, -0.3)
    )
    return F.when(t == "", F.lit(0.0)).otherwise(clamp(total, 0.0, 1.0))


def community_recency(published: Column, as_of, window_days: int = V.COMMUNITY_WINDOW_DAYS) -> Column:
    return recency_score(published, as_of, window_days * 24)


def comment_relevance(confidence: Column, specificity: Column, completeness: Column, recency: Column) -> Column:
    return (
        F.lit(0.40) * confidence + F.lit(0.25) * specificity + F.lit(0.20) * completeness + F.lit(0.15) * recency
    )


def theme_specificity(theme_count: Column, total: Column) -> Column:
    """Rare themes say more: one minus the theme's share of validated rows."""
    share = F.try_divide(F.coalesce(theme_count, F.lit(0)), total)
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(clamp(F.lit(1.0) - share, 0.0, 1.0))


def direction(change_pct: Column, band: float = V.FLAT_BAND_PCT) -> Column:
    return (
        F.when(change_pct > band, F.lit("up")).when(change_pct < -band, F.lit("down")).otherwise(F.lit("flat"))
    )


def is_up(open_: Column, close: Column) -> Column:
    return close >= open_


def delta_if_complete(current: Column, previous: Column, complete: Column) -> Column:
    """Change against the prior window; null when that window is not covered."""
    return F.when(complete, current - previous)
