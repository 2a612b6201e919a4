"""Queries over record fields, mastheads and recovered blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import fields
from broadsheet.functions import geometry as G
from broadsheet.operators import masthead as M
from broadsheet.plans.layout_queries import WITH, xo, yo
from broadsheet.plans.registry import query
from broadsheet.sources.fixtures import ARTICLES_SQL, articles, blocks
from broadsheet.storage import tables


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Given' WHEN doc_id % 3 = 1 AND trim(split_part(coalesce(text, ''), chr(10), 1)) <> '' THEN trim(split_part(text, chr(10), 1)) ELSE 'Untitled Article' END AS title FROM documents")
def f01_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = tables(spark, sf_dir, "documents")
    k = F.col("doc_id") % 3
    return d.select("doc_id", fields.first_value(F.when(k == 0, " Given ").when(k == 2, "  "), F.when(k == 1, F.split_part("text", F.lit("\n"), F.lit(1))), default="Untitled Article").alias("title"))


@query(f"WITH {ARTICLES_SQL} SELECT article_id, CASE WHEN article_id % 5 < 4 THEN publish_date END AS date FROM articles")
def f04_article_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO, long, short with the paper's year, dateline, and none."""
    d, k = F.col("publish_date"), F.col("article_id") % 5
    stated = F.when(k == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T08:00"))).when(k == 1, F.concat(F.lit("Delhi, "), F.date_format(d, "MMMM d, yyyy"))).when(k == 2, F.date_format(d, "MMM d"))
    text = F.when(k == 3, F.concat(F.lit("PATNA, "), F.date_format(d, "MMM d"), F.lit(": text"))).otherwise("no date 12")
    return articles(spark, sf_dir).select("article_id", fields.article_date(stated, text, F.year(d)).alias("date"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS n, CASE WHEN p_partkey % 4 = 2 THEN 0.5::DOUBLE END AS confidence FROM part")
def f32_image_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = tables(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    json = F.when(k == 0, '[{"image_id": "a"}, {"image_id": "b", "confidence": "x"}]').when(k == 1, '{"items": [{"caption": "c"}]}').when(k == 2, '{"image_id": "a", "confidence": 0.5}').otherwise("null")
    return p.select("p_partkey", fields.image_items(json).alias("i")).select("p_partkey", F.size("i").alias("n"), F.get("i", F.lit(0))["confidence"].alias("confidence"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def f38_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "part")[0].select("p_partkey", fields.slug("p_name").alias("slug"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'The AI quota is used up. Try again in 3 s.' WHEN 1 THEN 'The AI key is invalid.' ELSE 'The AI request failed.' END AS message FROM supplier""")
def f40_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    return tables(spark, sf_dir, "supplier")[0].select("s_suppkey", fields.failure(F.when(k == 0, 429).when(k == 1, 401).otherwise(418), F.when(k == 0, 2.4)).alias("message"))


@query("""WITH p AS (SELECT s_suppkey, (s_suppkey % 10 + 1)::INT AS cur FROM supplier), s AS (SELECT s_suppkey, cur, q FROM p, range(1, 11) r(q) WHERE q = 1 OR q = 10 OR abs(q - cur) <= 1),
g AS (SELECT *, q - lag(q) OVER (PARTITION BY s_suppkey ORDER BY q) > 1 AS jump FROM s) SELECT s_suppkey, string_agg(CASE WHEN jump THEN '0,' || q ELSE q::VARCHAR END, ',' ORDER BY q) AS links FROM g GROUP BY s_suppkey""")
def w12_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = tables(spark, sf_dir, "supplier")
    cur = (F.col("s_suppkey") % 10 + 1).cast("int")
    return s.select("s_suppkey", F.array_join(fields.page_links(cur, F.lit(10)).cast("array<string>"), ",").alias("links"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '|k1|k2' ELSE 'k1|k2|k3' END AS tags FROM nation""")
def t08_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    (n,) = tables(spark, sf_dir, "nation")
    topics = F.array(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.lit(" "))
    return n.select("n_nationkey", F.array_join(fields.tags(topics, F.array(F.lit("k1"), F.lit("k2"), F.lit("k3"))), "|").alias("tags"))


@query(f"""{WITH}, c AS (SELECT page_id, block_id, [[x1, y2], [x2, y1], [x1 + 5, y1 + 5]] AS p FROM blocks) SELECT page_id, block_id, list_min([q[1] FOR q IN p])::DOUBLE AS x1, list_min([q[2] FOR q IN p])::DOUBLE AS y1, list_max([q[1] FOR q IN p])::DOUBLE AS x2, list_max([q[2] FOR q IN p])::DOUBLE AS y2 FROM c""")
def g07_box_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    points = F.array(F.array(d("x1"), d("y2")), F.array(d("x2"), d("y1")), F.array(d("x1") + 5, d("y1") + 5))
    return blocks(spark, sf_dir).select("page_id", "block_id", G.box_of_points(points).alias("b")).select("page_id", "block_id", "b.*")


@query(f"""{WITH}, h AS (SELECT page_id, block_id, x1, y1, x2, y2, x1 + 10 AS hx1, y1 AS hy1, x1 + 130 AS hx2, y1 + 25 AS hy2 FROM blocks)
SELECT page_id, block_id, hx2 AS band_top_x1, y1 AS rest_top_y1 FROM h WHERE ((hx1 - x1 <= 0.08 * (x2 - x1)) <> (x2 - hx2 <= 0.08 * (x2 - x1))) AND ((hy1 - y1 <= 0.08 * (y2 - y1)) <> (y2 - hy2 <= 0.08 * (y2 - y1)))""")
def g08_l_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that lose their upper left corner."""
    h = blocks(spark, sf_dir).withColumns({"hx1": F.col("x1") + 10, "hy1": F.col("y1"), "hx2": F.col("x1") + 130, "hy2": F.col("y1") + 25})
    r = h.select("page_id", "block_id", G.l_shape(G.box(), G.box("h")).alias("r")).filter("r IS NOT NULL")
    return r.select("page_id", "block_id", F.col("r")[1]["x1"].alias("band_top_x1"), F.col("r")[1]["y1"].alias("rest_top_y1"))


@query()
def j23_mastheads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a region's name, a letter too long, against a registry of those names."""
    c, n, r = tables(spark, sf_dir, "customer", "nation", "region")
    lines = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("c_custkey").alias("document_id"), F.concat(F.lower("r_name"), F.lit("x")).alias("text"))
    return M.match_templates(lines, r.select(F.col("r_regionkey").alias("template_id"), F.col("r_name").alias("variant")))


@query(f"""{WITH}, f AS (SELECT * FROM blocks WHERE block_id % 4 = 0), k AS (SELECT * FROM blocks WHERE block_id % 4 <> 0), n AS (SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.page_id = a.page_id
  AND {xo("a", "b")} * {yo("a", "b")} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {xo("a", "b")} * {yo("a", "b")})::DOUBLE >= 0.5))
SELECT page_id, block_id FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.page_id = a.page_id AND b.text = a.text AND (b.confidence > a.confidence OR (b.confidence = a.confidence AND b.block_id < a.block_id)))""")
def d05_recovered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts here are alike only when they are equal."""
    b = blocks(spark, sf_dir).withColumn("text", F.md5("text"))
    return M.recovered(b.filter("block_id % 4 = 0"), b.filter("block_id % 4 <> 0")).select("page_id", "block_id")


@query("""SELECT o_custkey AS id, arg_min(o_orderkey, o_orderkey) AS path FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1""")
def s13_first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = tables(spark, sf_dir, "orders")
    wanted = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("rank"), F.col("o_orderkey").alias("path"))
    return M.first_existing(wanted, o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("path")))


@query("""SELECT lower(n_name || '_' || r_name) AS template_id, n_name AS newspaper_name, r_name AS edition, count(*)::INT AS confirmation_count, count(*) >= 3 AS verified FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def m05_template_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = tables(spark, sf_dir, "supplier", "nation", "region")
    seen = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("newspaper_name"), F.col("r_name").alias("edition"))
    empty = spark.createDataFrame([], "template_id string, newspaper_name string, edition string, confirmation_count int, verified boolean")
    learnt = M.learn(empty, seen)
    return learnt.withColumn("template_id", F.lower(F.concat_ws("_", "newspaper_name", "edition")))


@query(f"""{WITH}, c AS (SELECT page_id, 1 AS article_id, list_sort(list(block_id)) AS ids, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM blocks WHERE cls <> 'title' GROUP BY page_id),
h AS (SELECT page_id, list_sort(list(block_id)) AS ids, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM blocks WHERE cls = 'title' GROUP BY page_id)
SELECT c.page_id, c.article_id, array_to_string(list_concat(coalesce(h.ids, []), c.ids), ',') AS block_ids, least(c.x1, coalesce(h.x1, c.x1)) AS x1, least(c.y1, coalesce(h.y1, c.y1)) AS y1, greatest(c.x2, coalesce(h.x2, c.x2)) AS x2, greatest(c.y2, coalesce(h.y2, c.y2)) AS y2 FROM c LEFT JOIN h USING (page_id)""")
def m06_heading_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    crops = b.filter("cls <> 'title'").groupBy("page_id").agg(F.array_sort(F.collect_list("block_id")).alias("block_ids"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).withColumn("article_id", F.lit(1))
    out = M.repair_headings(crops, b.filter("cls = 'title'").withColumn("article_id", F.lit(1)))
    return out.withColumn("block_ids", F.array_join(F.col("block_ids").cast("array<string>"), ","))
