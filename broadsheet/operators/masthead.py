"""Mastheads: which newspaper a first page is, by its lines and a registry of templates; and what else recorded readings are compared with."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import geometry as G
from broadsheet.functions import text as T
from broadsheet.operators.layout import A, B, pairs
from broadsheet.operators.linkage import ratio_udf

LEAST, MARGIN = 0.80, 0.05
CONFIRMATIONS = 3


def match_templates(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """document_id, template_id, score: the template whose variants (template_id, variant) are most like some line, if it is enough and clearly ahead of
    the next template. Templates are a registry of a few rows: the join follows its size."""
    ratio = ratio_udf()
    found = lines.select("document_id", T.match_text("text").alias("said")).filter("said <> ''").join(templates.select("template_id", T.match_text("variant").alias("name")), F.lit(True))
    scored = found.groupBy("document_id", "template_id", "said", "name").agg(F.count(F.lit(1))).withColumn("score", ratio("said", "name"))
    best = scored.groupBy("document_id", "template_id").agg(F.max("score").alias("score"))
    g = best.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "template_id"))).alias("r"))
    top, second = -F.get("r", F.lit(0))["s"], -F.coalesce(F.get("r", F.lit(1))["s"], F.lit(0.0))
    return g.filter((top >= LEAST) & (top - second >= MARGIN)).select("document_id", F.get("r", F.lit(0))["template_id"].alias("template_id"), F.round(top, 6).alias("score"))


def masthead_metadata(lines: DataFrame, templates: DataFrame, registry: DataFrame, today: datetime.date) -> DataFrame:
    """document_id, newspaper_name, edition, publish_date by verified templates only: lines sure enough on average (0.55), one date, not after tomorrow."""
    sure = lines.groupBy("document_id").agg(F.avg("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_list(F.struct("y1", "text")))["text"], "\n").alias("text")).filter("confidence >= 0.55")
    date = T.unique_date("text")
    named = match_templates(lines, templates).join(registry.filter("verified"), "template_id").join(sure, "document_id")
    edition = F.when(F.lower("text").contains(F.lower("edition")), F.col("edition"))
    return named.select("document_id", "newspaper_name", edition.alias("edition"), F.when(date <= F.lit(today + datetime.timedelta(days=1)), date).alias("publish_date"))


def learn(registry: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Registry (template_id, newspaper_name, edition, confirmation_count, verified) after agreeing answers: verified from the third on; new names come in unverified."""
    n = confirmations.groupBy("newspaper_name", "edition").agg(F.count(F.lit(1)).cast("int").alias("n"))
    joined = registry.join(n, ["newspaper_name", "edition"], "full")
    count = F.coalesce("confirmation_count", F.lit(0)) + F.coalesce("n", F.lit(0))
    key = F.coalesce("template_id", F.lower(F.concat_ws("_", F.regexp_replace("newspaper_name", r"\W+", "_"), F.regexp_replace("edition", r"\W+", "_"))))
    return joined.select(key.alias("template_id"), "newspaper_name", "edition", count.alias("confirmation_count"), (F.coalesce("verified", F.lit(False)) | (count >= CONFIRMATIONS)).alias("verified"))


def recovered(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Recovered blocks that no known block covers (IoU of 0.5) and that no surer recovered block of the page repeats (text ratio of 0.85)."""
    known = pairs(found, blocks, G.iou(A, B) >= 0.5).select("page_id", F.col("a.block_id").alias("block_id"))
    new = found.join(known, ["page_id", "block_id"], "left_anti")
    surer = (F.col("b.confidence") > F.col("a.confidence")) | ((F.col("b.confidence") == F.col("a.confidence")) & (F.col("b.block_id") < F.col("a.block_id")))
    twins = pairs(new, new, surer).withColumn("ratio", ratio_udf()(F.col("a.text"), F.col("b.text"))).filter("ratio >= 0.85")
    return new.join(twins.select("page_id", F.col("a.block_id").alias("block_id")), ["page_id", "block_id"], "left_anti")


def first_existing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Id, path: of each id's candidate paths (id, rank, path) the first that exists."""
    return wanted.join(files.select("path").distinct(), "path", "left_semi").groupBy("id").agg(F.min_by("path", "rank").alias("path"))


def repair_headings(crops: DataFrame, headings: DataFrame) -> DataFrame:
    """Crops (page_id, article_id, block_ids, box) widened by the heading blocks that were found for them, whose ids come in first."""
    h = headings.groupBy("page_id", "article_id").agg(F.array_sort(F.collect_set("block_id")).alias("more"), *(f(c).alias(f"h_{c}") for c, f in (("x1", F.min), ("y1", F.min), ("x2", F.max), ("y2", F.max))))
    j = crops.join(h, ["page_id", "article_id"], "left")
    ids = F.array_distinct(F.concat(F.coalesce("more", F.array().cast("array<int>")), "block_ids"))
    return j.select("page_id", "article_id", ids.alias("block_ids"), *(f(c, f"h_{c}").alias(c) for c, f in (("x1", F.least), ("y1", F.least), ("x2", F.greatest), ("y2", F.greatest))))
