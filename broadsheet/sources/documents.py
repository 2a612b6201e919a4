"""JSON sources and sinks: pages with their blocks, document catalogues, logical articles, model answers; files and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.functions import text as T

BOX = "STRUCT<x1: INT, y1: INT, x2: INT, y2: INT>"
PAGE = f"page BIGINT, page_width INT, page_height INT, total_blocks INT, blocks ARRAY<STRUCT<id: INT, reading_order: INT, class: STRING, bbox: {BOX}, text: STRING, ocr_confidence: DOUBLE>>"
DOCUMENT = "document_id STRING, pdf_name STRING, status STRING, newspaper_name STRING, edition STRING, publish_date STRING, language STRING, page_count INT, article_count INT"
LOGICAL = "logical_articles ARRAY<STRUCT<logical_article_id: STRING, status: STRING, source_parts: ARRAY<STRUCT<page: INT, article_id: STRING>>>>"


def page_json(blocks: DataFrame, page_width: int, page_height: int) -> DataFrame:
    """One row per page with its blocks in reading order."""
    ordered = blocks.withColumn("reading_order", F.row_number().over(W.partitionBy("page_id").orderBy("y1", "x1", "block_id")) - 1)
    block = F.struct("reading_order", F.col("block_id").alias("id"), F.col("cls").alias("class"), F.struct("x1", "y1", "x2", "y2").alias("bbox"), "text", "ocr_confidence")
    g = ordered.groupBy("page_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return g.select(F.col("page_id").alias("page"), F.lit(page_width).alias("page_width"), F.lit(page_height).alias("page_height"), F.size("blocks").alias("total_blocks"), "blocks")


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of page files; what can't be parsed gives no blocks. Confidence of the detector is not stored and reads as 1."""
    raw = spark.read.schema(PAGE).option("mode", "PERMISSIVE").json(path)
    return raw.filter("page IS NOT NULL").select(F.col("page").alias("page_id"), F.inline("blocks")).select("page_id", F.col("id").alias("block_id"), "reading_order", F.col("class").alias("cls"), "bbox.*", F.lit(1.0).alias("confidence"), "ocr_confidence", "text")


def read_catalogue(spark: SparkSession, path: str, with_boundaries: DataFrame | None = None) -> DataFrame:
    """Documents by id, corrupt files left out; boundaries_ready: some crop of theirs exists."""
    docs = spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path).filter("document_id IS NOT NULL")
    if with_boundaries is None:
        return docs.withColumn("boundaries_ready", F.lit(False)).orderBy("document_id")
    ready = with_boundaries.select("document_id").distinct().withColumn("ready", F.lit(True))
    return docs.join(ready, "document_id", "left").withColumn("boundaries_ready", F.coalesce("ready", F.lit(False))).drop("ready").orderBy("document_id")


def read_logical(spark: SparkSession, path: str) -> DataFrame:
    """logical_article_id, status, page, article_id: one row for each part."""
    raw = spark.read.schema(LOGICAL).option("multiLine", "true").json(path)
    parts = raw.select(F.inline("logical_articles"))
    return parts.select("logical_article_id", "status", F.inline_outer("source_parts"))


def discover_crops(spark: SparkSession, root: str) -> DataFrame:
    """Page, article_id, path of crop images under page_N/article_id/: the expected name, else the first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root).select("path")
    parts = files.select("path", F.regexp_extract("path", r"/page_(\d+)/([^/]+)/([^/]+)\.png$", 1).try_cast("int").alias("page"), F.regexp_extract("path", r"/page_(\d+)/([^/]+)/", 2).alias("article_id"), F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("name"))
    return parts.filter("page IS NOT NULL").groupBy("page", "article_id").agg(F.min_by("path", F.struct(F.col("name") != F.col("article_id"), "name")).alias("path"))


def uploads(spark: SparkSession, root: str, most_mb: int = 200) -> DataFrame:
    """Name, length, accepted: files with their safe names, refused above the size limit."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"[^\w.\- ]", "_")
    return f.select(name.alias("name"), "length", (F.col("length") <= most_mb * 1024 * 1024).alias("accepted"))


def model_json(answer: Column, schema: str) -> Column:
    """the object in a model's answer, with or without a code fence; null if it is none."""
    bare = F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*|\s*```$", "")
    return F.from_json(F.when(bare.startswith("{"), bare), schema)


def as_list(value: Column) -> Column:
    """an array of strings from JSON, else from a comma list, else the text itself; null and blank: empty."""
    t = T.strip(value)
    parsed = F.from_json(F.when(t.startswith("["), t), "array<string>")
    split = F.filter(F.transform(F.split(t, ","), T.strip), lambda x: x != "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.when(F.size(split) > 1, split), F.array(t)))


#: Names of newspapers in file names.
NAMES = {"times of india": "The Times of India", "hindu": "The Hindu", "indian express": "The Indian Express", "hindustan times": "Hindustan Times"}


def filename_metadata(name: Column) -> Column:
    """struct of newspaper_name, edition and publish_date from NAME_EDITION_YYYYMMDD_removed.pdf."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), r"(?i)(_removed|-removed| removed)+$", ""), r"^.*[/\\]", "")
    date = F.try_to_date(F.nullif(F.regexp_extract(base, r"(20\d{6})", 1), F.lit("")), "yyyyMMdd")
    parts = F.filter(F.transform(F.split(F.regexp_replace(base, r"20\d{6}", ""), "_"), lambda x: F.trim(x)), lambda x: x != "")
    raw = F.try_element_at(parts, F.lit(1))
    known = F.coalesce(*(F.when(F.regexp_replace(F.lower(raw), "^the ", "") == k, v) for k, v in NAMES.items()), raw)
    return F.struct(known.alias("newspaper_name"), F.try_element_at(parts, F.lit(2)).alias("edition"), date.alias("publish_date"))


def raster_size(width: Column, height: Column, dpi: int = 300, least_edge: int = 4500, most_pixels: int = 36_000_000) -> Column:
    """Zoom at which a page of so many points is rendered: by dpi, the long edge at least 4500 pixels, at most 36 million pixels."""
    zoom = F.greatest(F.lit(dpi / 72.0), least_edge / F.greatest(width, height))
    return F.least(zoom, F.sqrt(most_pixels / (width * height)))


def thumbnail(width: Column, height: Column, to: int = 260) -> Column:
    """Struct of a thumbnail's size."""
    return F.struct(F.lit(to).alias("width"), F.greatest(F.bround(height * to / width), F.lit(1)).cast("int").alias("height"))
