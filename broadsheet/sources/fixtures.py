"""Tables in the archive's own shapes, derived from the general ones: blocks, article_blocks, articles, segments, links, job updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.storage import tables

PAGE_WIDTH, PAGE_HEIGHT = 2800, 4600


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, block_id, cls, x1, y1, x2, y2, confidence, ocr_confidence, text: layout blocks of pages."""
    lineitem, part = tables(spark, sf_dir, "lineitem", "part")
    page = F.floor(F.col("l_orderkey") / 4).cast("bigint")
    order = W.partitionBy("page_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    r = lineitem.withColumn("page_id", page).withColumn("block_id", F.row_number().over(order).cast("int"))
    key, x1, y1 = F.col("l_partkey"), 60 + 450 * (F.col("l_suppkey") % 6), 100 + (F.col("l_partkey") * 37) % 4000
    cls = F.when(key % 7 == 0, "title").when(key % 11 == 0, "figure").when(key % 13 == 0, "figure_caption").when(key % 17 == 0, "abandon").otherwise("plain text")
    b = r.select(
        "page_id", "block_id", cls.alias("cls"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), (x1 + F.when(key % 21 == 0, 870).otherwise(420)).cast("int").alias("x2"),
        (y1 + 60 + F.col("l_quantity") * 8).cast("int").alias("y2"), F.round(F.col("l_discount") * 10, 2).alias("confidence"), F.round(F.col("l_tax") * 12.5, 3).alias("ocr_confidence"), key.alias("p_partkey"),
    )
    return b.join(part.select("p_partkey", F.col("p_name").alias("text")), "p_partkey").drop("p_partkey")


def article_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, article_id, block_id: which articles claim which blocks; some are contested."""
    b = blocks(spark, sf_dir).select("page_id", "block_id")
    own = b.select("page_id", (F.col("block_id") % 4 + 1).alias("article_id"), "block_id")
    return own.unionByName(b.filter("block_id % 9 = 0").select("page_id", ((F.col("block_id") + 1) % 4 + 1).alias("article_id"), "block_id"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, newspaper_name, language, publish_date, title, article_text, n_chars."""
    (d,) = tables(spark, sf_dir, "documents")
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    return d.select(F.col("doc_id").alias("article_id"), F.col("source").alias("newspaper_name"), F.col("lang").alias("language"), date.alias("publish_date"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("article_text"), "n_chars")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """logical_id, segment_order, page_number, content_type, title, author, article_date, article_text."""
    (c,) = tables(spark, sf_dir, "conversations")
    n = (F.col("turn") + 1).cast("int")
    author = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("writer "), (F.col("conv_id") % 5).cast("string")))
    date = F.when(F.col("turn") % 2 == 0, F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("conv_id") + F.col("turn")) % 40).cast("int")))
    return c.select(F.col("conv_id").alias("logical_id"), n.alias("segment_order"), n.alias("page_number"), F.col("role").alias("content_type"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), author.alias("author"), date.alias("article_date"), F.col("text").alias("article_text"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, target_id, confidence: every story goes on among its five neighbours, some in the next five, some wrongly in itself."""
    (d,) = tables(spark, sf_dir, "documents")
    k = F.col("doc_id")
    target = F.when(k % 7 == 0, k).otherwise(k - k % 5 + (k % 5 * (k % 5) + 1) % 5 + F.when(k % 30 == 1, 5).otherwise(0))
    return d.select(k.alias("source_id"), target.alias("target_id"), F.round(0.70 + (k % 30) / 100.0, 2).alias("confidence"))


def job_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, job_id, ts, stage, progress."""
    (e,) = tables(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("stage"), F.round("value", 4).alias("progress"))


# The same tables as CTEs, for oracles.
BLOCKS_SQL = """blocks_r AS (
  SELECT *, cast(floor(l_orderkey / 4) AS bigint) AS page_id,
         row_number() OVER (PARTITION BY cast(floor(l_orderkey / 4) AS bigint) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem),
blocks_b AS (
  SELECT page_id, cast(rn AS int) AS block_id,
         CASE WHEN l_partkey % 7 = 0 THEN 'title' WHEN l_partkey % 11 = 0 THEN 'figure' WHEN l_partkey % 13 = 0 THEN 'figure_caption'
              WHEN l_partkey % 17 = 0 THEN 'abandon' ELSE 'plain text' END AS cls,
         cast(60 + 450 * (l_suppkey % 6) AS int) AS x1, cast(60 + 450 * (l_suppkey % 6) + CASE WHEN l_partkey % 21 = 0 THEN 870 ELSE 420 END AS int) AS x2,
         cast(100 + (l_partkey * 37) % 4000 AS int) AS y1, cast(floor(100 + (l_partkey * 37) % 4000 + 60 + l_quantity * 8) AS int) AS y2,
         round(l_discount * 10, 2) AS confidence, round(l_tax * 12.5, 3) AS ocr_confidence, l_partkey FROM blocks_r),
blocks AS (SELECT b.page_id, b.block_id, b.cls, b.x1, b.y1, b.x2, b.y2, b.confidence, b.ocr_confidence, p.p_name AS text FROM blocks_b b JOIN part p ON p.p_partkey = b.l_partkey)"""
ARTICLE_BLOCKS_SQL = """article_blocks AS (
  SELECT page_id, block_id % 4 + 1 AS article_id, block_id FROM blocks UNION ALL SELECT page_id, (block_id + 1) % 4 + 1, block_id FROM blocks WHERE block_id % 9 = 0)"""
ARTICLES_SQL = """articles AS (
  SELECT doc_id AS article_id, source AS newspaper_name, lang AS language, date '2024-01-01' + cast(doc_id % 30 AS int) AS publish_date,
         split_part(text, chr(10), 1) AS title, text AS article_text, n_chars FROM documents)"""
SEGMENTS_SQL = """segments AS (
  SELECT conv_id AS logical_id, cast(turn + 1 AS int) AS segment_order, cast(turn + 1 AS int) AS page_number, role AS content_type, split_part(text, chr(10), 1) AS title,
         CASE WHEN turn % 3 = 1 THEN concat('writer ', cast(conv_id % 5 AS varchar)) END AS author,
         CASE WHEN turn % 2 = 0 THEN date '2024-01-01' + cast((conv_id + turn) % 40 AS int) END AS article_date, text AS article_text FROM conversations)"""
LINKS_SQL = """links AS (
  SELECT doc_id AS source_id, CASE WHEN doc_id % 7 = 0 THEN doc_id ELSE doc_id - doc_id % 5 + (doc_id % 5 * (doc_id % 5) + 1) % 5 + CASE WHEN doc_id % 30 = 1 THEN 5 ELSE 0 END END AS target_id, cast(round(0.70 + (doc_id % 30) / 100.0, 2) AS double) AS confidence FROM documents)"""
JOBS_SQL = """job_updates AS (SELECT event_id, user_id AS job_id, ts, event_type AS stage, round(value, 4) AS progress FROM events)"""
