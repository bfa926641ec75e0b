"""Forum and board responses landed as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions.dates import parse_instant
from signalloom.functions.numbers import num_or_zero

FORUM_SCHEMA = (
    "topics array<struct<id:bigint,title:string,slug:string,created_at:string,last_posted_at:string,"
    "reply_count:string,posts_count:string,views:string>>,"
    "posts array<struct<id:bigint,username:string,blurb:string,created_at:string,topic_id:bigint>>,"
    "grouped_search_result struct<more_full_page_results:boolean>"
)
BOARD_SCHEMA = (
    "data struct<repository:struct<discussions:struct<nodes:array<struct<id:string,title:string,url:string,"
    "createdAt:string,author:struct<login:string>,bodyText:string,category:struct<name:string>,"
    "comments:struct<totalCount:bigint>>>>>>, errors array<struct<message:string>>"
)


def _topic_url(base: Column, slug: Column, topic: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(base, "/+$", ""), F.lit("t"), F.nullif(slug, F.lit("")), topic.cast("string"))


def _since(df: DataFrame, since: Column | None) -> DataFrame:
    whole = df.where(F.col("created_at").isNotNull())
    return whole if since is None else whole.where(F.col("created_at") >= since)


def parse_forum(responses: DataFrame, since: Column | None = None, body: str = "body", carry: tuple[str, ...] = ("model", "base")):
    """``(topics, posts, more)`` of search responses; incomplete rows drop out."""
    parsed = responses.select(*carry, F.from_json(body, FORUM_SCHEMA).alias("j"))
    raw = parsed.select(*carry, F.inline("j.topics"))
    topics = _since(
        raw.where("id IS NOT NULL AND title <> ''").select(
            *carry, F.col("id").alias("topic_id"), "title", "slug",
            _topic_url(F.col("base"), F.col("slug"), F.col("id")).alias("url"),
            parse_instant(F.col("created_at")).alias("created_at"),
            parse_instant(F.coalesce("last_posted_at", "created_at")).alias("last_posted_at"),
            *[num_or_zero(F.col(c)).cast("bigint").alias(c) for c in ("reply_count", "posts_count", "views")],
        ),
        since,
    )
    # a post's topic stands in the same response: its slug is looked up in the row, the last one listed
    named = F.filter("j.topics", lambda t: t["slug"] != "")
    slug = F.try_element_at(F.filter("_named", lambda t: t["id"] == F.col("topic_id")), F.lit(-1))["slug"]
    posts = _since(
        parsed.select(*carry, named.alias("_named"), F.inline("j.posts")).where("id IS NOT NULL AND blurb <> ''")
        .withColumnRenamed("id", "post_id")
        .withColumn("slug", slug)
        .select(
            *carry, "post_id", F.coalesce(F.nullif("username", F.lit("")), F.lit("member")).alias("username"), "blurb",
            parse_instant(F.col("created_at")).alias("created_at"), "topic_id",
            _topic_url(F.col("base"), F.col("slug"), F.col("topic_id")).alias("url"),
        ),
        since,
    )
    more = parsed.select(*carry, F.coalesce("j.grouped_search_result.more_full_page_results", F.lit(False)).alias("more"))
    return topics, posts, more


def parse_board(responses: DataFrame, body: str = "body", carry: tuple[str, ...] = ("model", "repo")):
    """``(discussions, status)``: reported errors or no repository give ``ok = false``."""
    parsed = responses.select(*carry, F.from_json(body, BOARD_SCHEMA).alias("j"))
    nodes = F.col("j.data.repository.discussions.nodes")
    failed = F.coalesce(F.size("j.errors"), F.lit(0)) > 0
    status = parsed.select(
        *carry,
        (~failed & nodes.isNotNull()).alias("ok"),
        F.when(failed, F.array_join(F.transform("j.errors", lambda e: e["message"]), "; "))
        .when(nodes.isNull(), F.lit("no discussions data")).alias("error"),
    )
    rows = parsed.where(~failed).select(*carry, F.inline(nodes))
    discussions = rows.where("id <> '' AND title <> ''").select(
        *carry, "id", "title",
        F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://github.com/"), "repo", F.lit("/discussions"))).alias("url"),
        parse_instant(F.col("createdAt")).alias("created_at"),
        F.coalesce(F.nullif(F.col("author.login"), F.lit("")), F.lit("member")).alias("author"),
        F.coalesce("bodyText", F.lit("")).alias("body_text"),
        F.coalesce(F.col("category.name"), F.lit("")).alias("category"),
        F.coalesce(F.col("comments.totalCount"), F.lit(0)).alias("comment_count"),
    ).where("created_at IS NOT NULL")
    return discussions, status
