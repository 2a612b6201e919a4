"""From layout blocks to an archive of articles, as one plan per table: cleaning, grouping, boundaries and extraction, without K12's later steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import text as T
from broadsheet.operators import archive as A
from broadsheet.operators import assembly, grouping, layout
from broadsheet.sources.fixtures import PAGE_HEIGHT, PAGE_WIDTH
from broadsheet.storage import materialise


@dataclass
class Archive:
    """Tables of an archive."""

    blocks: DataFrame
    members: DataFrame
    boundaries: DataFrame
    articles: DataFrame


def extract(members: DataFrame) -> DataFrame:
    """page_id, article_id and all fields of an article that its text gives."""
    texts = grouping.assemble_texts(members)
    heads = assembly.headline(members.withColumn("block_class", F.col("cls")))
    a = texts.join(heads, ["page_id", "article_id"], "left")
    t = F.col("text")
    figures = members.groupBy("page_id", "article_id").agg(F.bool_or(F.col("cls") == "figure").alias("has_images"), F.count_if(F.col("cls") == "figure").cast("int").alias("image_count"))
    return a.join(figures, ["page_id", "article_id"]).select(
        "page_id", "article_id", "headline", "subheadline", T.author(t).alias("author"), T.dateline(t)["location"].alias("location"), t.alias("article_text"), T.entities(t).alias("entities"), T.sentiment(t).alias("sentiment"),
        T.content_type(t, T.caption_score(t), F.lit(True)).alias("content_type"), T.continuation(t).alias("continuation"), T.readability(F.col("confidence")).alias("text_readability"), (F.length(t) < 20).alias("missing_text"), "has_images", "image_count",
    )


def build(blocks: DataFrame, page_width: int = PAGE_WIDTH, page_height: int = PAGE_HEIGHT) -> Archive:
    """U07, U08 in part: clean, group, bound and extract all pages.

    K12 is not covered: no orphans are reassigned, no headlines moved, no articles split or recovered, no side boxes absorbed.
    """
    clean = layout.clean(blocks, page_width, page_height).filter(~F.col("is_global")).select(*blocks.columns)
    grouped = grouping.group_articles(clean)
    members = materialise(grouped.join(clean, ["page_id", "block_id"]), "members")
    return Archive(clean, members, layout.boundaries(members), extract(members))


class Api:
    """The archive's queries, each a DataFrame."""

    def __init__(self, spark: SparkSession, articles: DataFrame, segments: DataFrame | None = None):
        self.spark, self.articles, self.segments = spark, articles, segments

    def newspapers(self) -> DataFrame:
        return A.newspapers(self.articles).orderBy("newspaper_name")

    def dates(self, newspaper: str | None = None) -> DataFrame:
        return A.dates(self.articles, newspaper)

    def search(self, q: str = "", newspaper: str | None = None, publish_date: str | None = None, limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """Total (one row), and a page of results by rank, then title."""
        from broadsheet.operators import search

        base = A.matching(self.articles, newspaper, publish_date)
        found = search.search(base, {"title": "A", "article_text": "C"}, q) if q.strip() else base.withColumn("rank", F.lit(0.0))
        return found.agg(F.count(F.lit(1)).alias("total")), A.page_of(found, [F.desc("rank"), F.asc_nulls_last("title"), F.asc("article_id")], limit, offset)

    def article(self, article_id: int) -> DataFrame:
        """One article with its segments, if there are any."""
        one = self.articles.filter(F.col("article_id") == article_id).limit(1)
        return one if self.segments is None else one.join(A.nested(self.segments).withColumnRenamed("logical_id", "article_id"), "article_id", "left")
