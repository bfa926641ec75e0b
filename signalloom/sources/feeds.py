"""News feeds landed as whole documents: one row per file or response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions.dates import moment, parse_instant
from signalloom.functions.text import SPACE, decode_entities, headline_text, let
from signalloom.operators.classify import detect_lab, is_product_release


def element_text(block: Column, name: str) -> Column:
    """Decoded content of the first element of that name, empty if none."""
    return decode_entities(F.regexp_extract(block, rf"(?i)<{name}[^>]*>([\s\S]*?)</{name}>", 1))


def _first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))


def parse_feed(
    documents: DataFrame, as_of, xml: str = "xml", desc_limit: int = 400,
    carry: tuple[str, ...] = ("source_name",),
) -> DataFrame:
    """Items of RSS or Atom documents.

    Adds ``title``, ``link``, ``desc``, ``published_at`` to the carried columns;
    items without title or link drop out and an unreadable date becomes ``as_of``.
    """
    body = F.col(xml)
    rss = F.regexp_extract_all(body, F.lit(r"(?i)<item[\s\S]*?</item>"), F.lit(0))
    atom = F.regexp_extract_all(body, F.lit(r"(?i)<entry[\s\S]*?</entry>"), F.lit(0))
    blocks = let(rss, lambda found: F.when(F.size(found) > 0, found).otherwise(atom))
    block = F.col("_block")
    href = F.regexp_extract(block, r"""(?i)<link[^>]*href=["']([^"']+)["']""", 1)
    date = _first_filled(*[element_text(block, n) for n in ("pubDate", "published", "updated", "dc:date")])
    desc = _first_filled(*[element_text(block, n) for n in ("description", "summary", "content", "media:description")])
    items = (
        documents.select(*carry, F.explode(blocks).alias("_block"))
        .withColumns({"title": element_text(block, "title"), "_link": element_text(block, "link"), "_href": href,
                      "_date": date, "desc": desc})
        .withColumn("link", F.trim(_first_filled(F.col("_link"), F.col("_href"))))
        .where("title <> '' AND link <> ''")
        .withColumns(
            {
                "desc": F.substring("desc", 1, desc_limit),
                "published_at": F.coalesce(parse_instant(F.col("_date")), moment(as_of)),
            }
        )
        .drop("_block", "_link", "_href", "_date")
    )
    return items


def split_publisher(items: DataFrame, aggregated: Column) -> DataFrame:
    """``Headline - Publisher`` of aggregator feeds: publisher becomes the source
    and the description, which only repeats the headline, is emptied."""
    shape = rf"^(.*){SPACE}+-{SPACE}+([^-]+)$"
    split = aggregated & F.col("title").rlike(shape)
    return items.withColumns(
        {
            "title": F.when(split, F.trim(F.regexp_extract("title", shape, 1))).otherwise(F.col("title")),
            "source_name": F.when(split, F.trim(F.regexp_extract("title", shape, 2))).otherwise(F.col("source_name")),
            "desc": F.when(aggregated, F.lit("")).otherwise(F.col("desc")),
        }
    )


def video_gate(items: DataFrame, is_video: Column, labs=V.LAB_RULES, shipping: str = V.RELEASE_SHIPPING) -> DataFrame:
    """From video feeds keep only releases that name a lab."""
    lab = detect_lab(headline_text(F.col("title"), F.col("desc")), labs)
    release = is_product_release(F.col("title"), F.col("desc"), shipping)
    return items.where(~is_video | (lab.isNotNull() & release))
