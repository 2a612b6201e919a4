"""Archive operators: search, nested collections, ordered aggregates of segments, upserts and deletes, set reconciliation."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.functions import text as T
from broadsheet.storage import materialise


# Search


def matching(articles: DataFrame, newspaper: str | None = None, date: str | None = None, word: str | None = None) -> DataFrame:
    """Filters that are given; the others don't reach the plan."""
    out = articles
    if newspaper is not None:
        out = out.filter(F.col("newspaper_name") == newspaper)
    if date is not None:
        out = out.filter(F.col("publish_date") == F.lit(date).cast("date"))
    return out.filter(F.lower(T.text_of("article_text")).contains(word.lower())) if word else out


def page_of(results: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of results; limit from 1 to 100."""
    return results.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def newspapers(articles: DataFrame) -> DataFrame:
    """A02, P20."""
    return articles.filter(F.trim("newspaper_name") != "").select("newspaper_name").distinct()


def dates(articles: DataFrame, newspaper: str | None = None) -> DataFrame:
    """Distinct dates, the latest first."""
    return matching(articles, newspaper).filter("publish_date IS NOT NULL").select("publish_date").distinct().orderBy(F.desc("publish_date"))


# Segments of logical articles


def nested(segments: DataFrame) -> DataFrame:
    """logical_id, segments: an array in order."""
    return segments.groupBy("logical_id").agg(F.array_sort(F.collect_list(F.struct("segment_order", "page_number", "content_type", "title", "author", "article_date", "article_text"))).alias("segments"))


def _blank_free(c: str) -> Column:
    return F.when(T.strip(c) != "", F.col(c))


def merged(segments: DataFrame, publish_date: Column) -> DataFrame:
    """One row for each logical article.

    Texts joined by blank lines in order; first author; least date not after publish_date, else publish_date; what the last segment with a value shows.
    """
    author, title = _blank_free("author"), _blank_free("title")
    order = F.col("segment_order")
    g = segments.withColumn("publish_date", publish_date).groupBy("logical_id").agg(
        F.array_sort(F.collect_list(F.when(T.strip("article_text") != "", F.struct("segment_order", "article_text")))).alias("texts"),
        F.min_by("author", F.when(author.isNotNull(), order)).alias("author"), F.max_by("title", F.when(title.isNotNull(), order)).alias("display_title"), F.min_by("title", order).alias("title"),
        F.max_by("author", F.when(author.isNotNull(), order)).alias("display_author"), F.min(F.when(F.col("article_date") <= F.col("publish_date"), F.col("article_date"))).alias("least"),
        F.first("publish_date").alias("publish_date"), F.count(F.lit(1)).alias("n_segments"),
    )
    return g.select("logical_id", F.array_join(F.col("texts")["article_text"], "\n\n").alias("article_text"), "author", "title", "display_title", "display_author", F.coalesce("least", "publish_date").alias("article_date"), "n_segments")


def distinct_in_order(segments: DataFrame, values: Column) -> DataFrame:
    """logical_id, items: the arrays of all segments in order, each item where it came first."""
    lists = F.array_sort(F.collect_list(F.struct("segment_order", values.alias("items"))))
    return segments.groupBy("logical_id").agg(F.array_distinct(F.flatten(lists["items"])).alias("items"))


def numbered(rows: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """1, 2, ... within each group."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)))


# Dedupe and reconciliation


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key; rows with a null in the key drop out."""
    full = rows.filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key)))
    return full.withColumn("k_", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("k_ = 1").drop("k_")


def reconcile(expected: DataFrame, returned: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key that is missing, unexpected or duplicate, with its status."""
    n = returned.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    e = expected.select(*key).distinct().withColumn("expected", F.lit(True))
    both = e.join(n, key, "full")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return both.withColumn("status", status).filter("status IS NOT NULL").select(*key, "status")


def draft_diff(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Key, change: create, edit or delete."""
    a = old.select(*key, F.struct(*values).alias("old"))
    b = new.select(*key, F.struct(*values).alias("new"))
    change = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "edit")
    return a.join(b, key, "full").withColumn("change", change).filter("change IS NOT NULL").select(*key, "change")


# Mutations: tables are rewritten, since Parquet has no rows to update


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace rows of old with the same key; repeats in new: the caller dedupes."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def patch(old: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Columns of changes that are not null overwrite those of old."""
    values = [c for c in changes.columns if c not in key]
    renamed = changes.withColumnsRenamed({c: f"new_{c}" for c in values})
    joined = old.join(renamed, key, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in values else c for c in old.columns))


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that come anew go before the new ones come in."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def cascade(tables: dict[str, DataFrame], parents: dict[str, tuple[str, str, str]], root: str, doomed: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of each table once `doomed` keys of root are gone, and rows deleted by table.

    parents: table to (column, parent table, parent's column), children after their parents.
    """
    gone = {root: tables[root].join(doomed.select(key).distinct(), key, "left_semi")}
    left = {root: tables[root].join(doomed.select(key).distinct(), key, "left_anti")}
    for name, (column, parent, parent_key) in parents.items():
        dead = gone[parent].select(F.col(parent_key).alias(column)).distinct()
        gone[name] = tables[name].join(dead, column, "left_semi")
        left[name] = tables[name].join(dead, column, "left_anti")
    counts = reduce(DataFrame.unionByName, (g.agg(F.count(F.lit(1)).alias("n_deleted")).select(F.lit(n).alias("table_name"), "n_deleted") for n, g in gone.items()))
    return left, counts


def staged(df: DataFrame, name: str) -> DataFrame:
    """A rewritten table, complete in the shared folder before anything reads it."""
    return materialise(df, name)


def next_document_id(documents: DataFrame) -> DataFrame:
    """One row, document_id: one above the largest number in use, in six digits or as many as it has."""
    n = F.max(F.regexp_extract("document_id", r"^doc_(\d+)$", 1).try_cast("long"))
    return documents.agg(F.format_string("doc_%06d", F.coalesce(n, F.lit(0)) + 1).alias("document_id"))


# Centroids and votes


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Label, centroid: mean vector of length 1."""
    mean = vectors.select(label, F.posexplode(vector).alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("v"))
    g = mean.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x["v"] * x["v"]))
    return g.select(label, F.transform("c", lambda x: x["v"] / norm).alias("centroid"))


def classify(vectors: DataFrame, found: DataFrame, key: str, label: str, vector: str, least: float = 0.20) -> DataFrame:
    """key, category, score: the label of the most similar centroid; null category up to `least`. Labels are few: a broadcast within the size limit."""
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    all_ = found.agg(F.collect_list(F.struct(F.col(label).alias("label"), "centroid")).alias("all_"))
    scored = vectors.select(key, vector, norm.alias("norm")).crossJoin(all_).select(key, vector, "norm", F.explode("all_").alias("c")).select(key, F.col("c.label").alias("label"), F.round(F.aggregate(F.zip_with(F.col(vector), F.col("c.centroid"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / F.col("norm"), 6).alias("score"))
    best = scored.groupBy(key).agg(F.max(F.struct("score", (-F.col("label")).alias("label"))).alias("best"))
    return best.select(key, F.when(F.col("best.score") > least, -F.col("best.label")).alias("category"), F.col("best.score").alias("score"))


def dominant_offset(votes: DataFrame, key: list[str], offset: str, least_votes: int = 3, least_share: float = 0.7) -> DataFrame:
    """The offset that most votes name, if there are enough and they agree; ties go to the smaller offset. The share is compared as the decimal it is written as."""
    n = votes.groupBy(*key, offset).agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy(*key).agg(F.max(F.struct("n", (-F.col(offset)).alias("o"))).alias("best"), F.sum("n").alias("votes"))
    return g.filter((F.col("votes") >= least_votes) & (F.col("best.n") >= F.lit(Decimal(str(least_share))) * F.col("votes"))).select(*key, (-F.col("best.o")).alias(offset), F.col("best.n").alias("n"), "votes")


def page_map(folios: DataFrame) -> DataFrame:
    """document_id, folio, page: folios read on exactly one page, then pages without one by the dominant offset where that folio is free.

    folios: document_id, page, folio (null: none read)."""
    read = folios.filter("folio IS NOT NULL")
    sure = read.groupBy("document_id", "folio").agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    offsets = dominant_offset(read.withColumn("offset", F.col("page") - F.col("folio")), ["document_id"], "offset")
    blank = folios.join(sure.select("document_id", "page"), ["document_id", "page"], "left_anti")
    inferred = blank.join(offsets, "document_id").select("document_id", (F.col("page") - F.col("offset")).alias("folio"), "page").filter("folio > 0")
    return sure.unionByName(inferred.join(sure.select("document_id", "folio"), ["document_id", "folio"], "left_anti"))
