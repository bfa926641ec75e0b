"""Video filters and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions.text import add_once, let


def is_short(duration: Column, limit: int = V.MAX_SHORT_SECONDS) -> Column:
    return F.coalesce(duration <= limit, F.lit(False))


def _mentions(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def is_relevant(title: Column, description: Column, context=V.VIDEO_CONTEXT_WORDS, off_topic=V.ZODIAC_WORDS) -> Column:
    """Context words keep a video; off-topic words drop it only without context."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    return let(text, lambda t: _mentions(t, context) | ~_mentions(t, off_topic))


def is_likely_english(title: Column, scripts=V.NON_LATIN_SCRIPTS) -> Column:
    """False only when letters of the other scripts outnumber Latin ones."""
    letters = F.lit("[" + "".join(rf"\p{{Is{s}}}" for s in scripts) + "]")

    def judged(text: Column) -> Column:
        other = F.regexp_count(text, letters)
        return (other == 0) | (F.regexp_count(text, F.lit(r"\p{IsLatin}")) >= other)

    return let(F.coalesce(title, F.lit("")), judged)


def merge_details(videos: DataFrame, details: DataFrame) -> DataFrame:
    """Views and duration by video id; missing stays null."""
    known = details.select("video_id", "view_count", "duration_s").dropDuplicates(["video_id"])
    return videos.drop("view_count", "duration_s").join(known, "video_id", "left")


def top_videos(videos: DataFrame, details: DataFrame, k: int = 5, by: str = "model") -> DataFrame:
    """Relevant, English, long-form videos, the ``k`` most viewed per group."""
    fit = is_relevant(F.col("title"), F.col("description")) & is_likely_english(F.col("title"))
    kept = add_once(videos, {"_fit": fit}).where("_fit").drop("_fit")
    long_form = merge_details(kept, details).where(~is_short(F.col("duration_s")))
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last("view_count"), "video_id")
    return long_form.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stage_counts(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """Count rows passing a stage while the job runs, without another job."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def keep_previous(new: DataFrame, previous: DataFrame, key: str, failed: DataFrame) -> DataFrame:
    """New rows, and the previous rows of keys whose refresh failed or did not run."""
    refreshed = new.join(failed.select(key).distinct(), key, "left_anti")
    stale = previous.join(refreshed.select(key).distinct(), key, "left_anti")
    return refreshed.unionByName(stale, allowMissingColumns=True)
