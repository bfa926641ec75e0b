"""Video, price and marketplace responses landed as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.functions.dates import iso_duration_seconds

SEARCH_SCHEMA = (
    "items array<struct<id:struct<videoId:string>,snippet:struct<title:string,description:string,"
    "channelTitle:string,publishedAt:string,thumbnails:struct<medium:struct<url:string>,`default`:struct<url:string>>>>>"
)
DETAILS_SCHEMA = "items array<struct<id:string,statistics:struct<viewCount:string>,contentDetails:struct<duration:string>>>"
CHART_SCHEMA = (
    "chart struct<result:array<struct<timestamp:array<bigint>,meta:struct<regularMarketPrice:double,"
    "regularMarketVolume:bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,"
    "low:array<double>,close:array<double>,volume:array<bigint>>>>>>>"
)
BUNDLE_SCHEMA = "offers array<struct<gpu_name:string,num_gpus:int,dph_total:double>>"
LISTED_SCHEMA = "data struct<gpuTypes:array<struct<id:string,communityPrice:double,securePrice:double>>>"


def parse_video_search(responses: DataFrame, body: str = "body", by: str = "model") -> DataFrame:
    items = responses.select(by, F.inline(F.from_json(body, SEARCH_SCHEMA)["items"]))
    empty = F.lit("")
    return items.where("id.videoId <> '' AND snippet IS NOT NULL").select(
        by, F.col("id.videoId").alias("video_id"),
        F.coalesce("snippet.title", empty).alias("title"),
        F.coalesce("snippet.description", empty).alias("description"),
        F.coalesce("snippet.channelTitle", empty).alias("channel"),
        F.col("snippet.publishedAt").alias("published_at"),
        F.coalesce("snippet.thumbnails.medium.url", "snippet.thumbnails.default.url").alias("thumbnail"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), "id.videoId").alias("url"),
    )


def parse_video_details(responses: DataFrame, body: str = "body") -> DataFrame:
    """Views and duration; what does not parse stays null."""
    items = responses.select(F.inline(F.from_json(body, DETAILS_SCHEMA)["items"]))
    return items.where("id <> ''").select(
        F.col("id").alias("video_id"),
        F.col("statistics.viewCount").try_cast("double").cast("bigint").alias("view_count"),
        iso_duration_seconds(F.col("contentDetails.duration")).alias("duration_s"),
    )


def parse_price_bars(responses: DataFrame, body: str = "body", by: str = "ticker") -> DataFrame:
    """Parallel arrays as bars; bars without a close drop out, and a response without a result has none."""
    result = F.get(F.from_json(body, CHART_SCHEMA)["chart"]["result"], F.lit(0))
    shaped = responses.select(by, result.alias("r")).select(by, "r.timestamp", F.get("r.indicators.quote", F.lit(0)).alias("q"))
    # a missing series zips as nulls
    kinds = {"open": "double", "high": "double", "low": "double", "close": "double", "volume": "bigint"}
    series = [F.coalesce(F.col(f"q.{c}"), F.array().cast(f"array<{t}>")).alias(c) for c, t in kinds.items()]
    return shaped.select(by, F.col("timestamp").alias("ts"), *series).select(by, F.inline(F.arrays_zip("ts", *kinds))).where("close IS NOT NULL").select(
        by, F.to_date(F.timestamp_seconds("ts")).alias("date"), "open", "high", "low", "close", "volume"
    )


def parse_live_prices(responses: DataFrame, body: str = "body", by: str = "ticker") -> DataFrame:
    meta = F.get(F.from_json(body, CHART_SCHEMA)["chart"]["result"], F.lit(0))["meta"]
    return responses.select(by, meta["regularMarketPrice"].alias("live_price"), meta["regularMarketVolume"].alias("live_volume"))


def parse_bundle_offers(responses: DataFrame, body: str = "body") -> DataFrame:
    return responses.select(F.inline(F.from_json(body, BUNDLE_SCHEMA)["offers"]))


def parse_listed_offers(responses: DataFrame, body: str = "body") -> DataFrame:
    return responses.select(F.inline(F.from_json(body, LISTED_SCHEMA)["data"]["gpuTypes"]))
