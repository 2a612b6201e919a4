"""Queries over the archive: search, segments, links, mutations, votes, categories, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import text as T
from broadsheet.operators import archive as A
from broadsheet.operators import linkage as K
from broadsheet.operators import search as S
from broadsheet.plans.registry import query
from broadsheet.sources import adapters, documents, fixtures
from broadsheet.sources.fixtures import ARTICLES_SQL, BLOCKS_SQL, JOBS_SQL, LINKS_SQL, SEGMENTS_SQL
from broadsheet.storage import materialise, tables
from broadsheet.streaming import jobs

ART, SEG = f"WITH {ARTICLES_SQL}", f"WITH {SEGMENTS_SQL}"


@query(f"{ART} SELECT newspaper_name, language, count(*) AS n_articles, sum(n_chars)::BIGINT AS n_chars, min(publish_date) AS first_date, max(publish_date) AS last_date FROM articles GROUP BY ALL")
def a01_articles_per_newspaper(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixtures.articles(spark, sf_dir)
    return a.groupBy("newspaper_name", "language").agg(F.count(F.lit(1)).alias("n_articles"), F.sum("n_chars").alias("n_chars"), F.min("publish_date").alias("first_date"), F.max("publish_date").alias("last_date"))


@query(f"{ART} SELECT count(*) AS total FROM articles WHERE newspaper_name = 'src1' AND contains(lower(article_text), 'the')")
def a01_search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.matching(fixtures.articles(spark, sf_dir), newspaper="src1", word="the").agg(F.count(F.lit(1)).alias("total"))


@query(f"{ART} SELECT DISTINCT newspaper_name FROM articles WHERE trim(newspaper_name) <> ''")
def a02_newspapers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.newspapers(fixtures.articles(spark, sf_dir))


@query(f"{ART} SELECT DISTINCT publish_date FROM articles WHERE newspaper_name = 'src2'")
def t07_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dates(fixtures.articles(spark, sf_dir), "src2")


@query(f"{ART} SELECT article_id, newspaper_name, publish_date, title FROM articles WHERE newspaper_name = 'src3' AND contains(lower(article_text), 'the') ORDER BY n_chars DESC, title ASC NULLS LAST, article_id LIMIT 20 OFFSET 5")
def t01_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.matching(fixtures.articles(spark, sf_dir), newspaper="src3", word="the")
    return A.page_of(found, [F.desc("n_chars"), F.asc_nulls_last("title"), F.asc("article_id")], 20, 5).select("article_id", "newspaper_name", "publish_date", "title")


@query(f"{ART} SELECT article_id, title, n_chars FROM articles WHERE article_id = 7 LIMIT 1")
def t02_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.articles(spark, sf_dir).filter("article_id = 7").limit(1).select("article_id", "title", "n_chars")


@query("""SELECT n_name, r_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def j01_equi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact to dimensions, the join of articles and their documents; Catalyst broadcasts by size."""
    c, n, r = tables(spark, sf_dir, "customer", "nation", "region")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"{SEG} SELECT logical_id, count(*)::INT AS n_segments, string_agg(segment_order || ':' || content_type || ':' || title, '|' ORDER BY segment_order) AS segments FROM segments GROUP BY logical_id")
def j02_nested_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.nested(fixtures.segments(spark, sf_dir))
    return n.select("logical_id", F.size("segments").alias("n_segments"), F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["segment_order"].cast("string"), s["content_type"], s["title"])), "|").alias("segments"))


@query(f"""{SEG}, s AS (SELECT *, date '2024-01-20' AS publish_date FROM segments)
SELECT logical_id, coalesce(string_agg(article_text, chr(10) || chr(10) ORDER BY segment_order) FILTER (trim(article_text) <> ''), '') AS article_text, arg_min(author, segment_order) FILTER (author IS NOT NULL) AS author,
  arg_min(title, segment_order) AS title, arg_max(title, segment_order) FILTER (trim(title) <> '') AS display_title, arg_max(author, segment_order) FILTER (author IS NOT NULL) AS display_author,
  coalesce(min(article_date) FILTER (article_date <= publish_date), date '2024-01-20') AS article_date, count(*) AS n_segments FROM s GROUP BY logical_id""")
def a07_a11_merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.merged(fixtures.segments(spark, sf_dir), F.lit("2024-01-20").cast("date"))


@query(f"""{SEG}, w AS (SELECT logical_id, segment_order, i, w FROM (SELECT *, string_split(title, ' ') AS ws FROM segments) s, unnest(ws) WITH ORDINALITY AS u (w, i)),
f AS (SELECT logical_id, w, min(segment_order * 100000 + i) AS pos FROM w GROUP BY ALL) SELECT logical_id, string_agg(w, ' ' ORDER BY pos) AS items FROM f GROUP BY logical_id""")
def a08_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = A.distinct_in_order(fixtures.segments(spark, sf_dir), F.split("title", " "))
    return items.select("logical_id", F.array_join("items", " ").alias("items"))


@query(f"{SEG} SELECT logical_id, page_number, row_number() OVER (PARTITION BY logical_id ORDER BY page_number DESC)::INT AS n FROM segments")
def w03_segment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.numbered(fixtures.segments(spark, sf_dir).select("logical_id", "page_number"), ["logical_id"], [F.desc("page_number")], "n")


@query(f"""{SEG}, g AS (SELECT logical_id, count(*) AS n, count(*) FILTER (content_type = 'assistant') AS n_assistant, count(DISTINCT content_type) AS n_kinds, sum(length(article_text))::BIGINT AS n_chars FROM segments GROUP BY logical_id) SELECT * FROM g""")
def a19_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.segments(spark, sf_dir)
    return s.groupBy("logical_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("content_type") == "assistant").alias("n_assistant"), F.count_distinct("content_type").alias("n_kinds"), F.sum(F.length("article_text")).alias("n_chars"))


LINK = f"WITH {ARTICLES_SQL}, {LINKS_SQL}"


@query(f"""{LINK}, ok AS (SELECT * FROM links WHERE source_id <> target_id AND confidence >= 0.75 AND target_id IN (SELECT article_id FROM articles)),
s AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, source_id, target_id) = 1)
SELECT source_id, target_id, confidence FROM s QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY confidence DESC, source_id, target_id) = 1""")
def k16_clean_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.clean_links(fixtures.links(spark, sf_dir), fixtures.articles(spark, sf_dir))


@query(f"""WITH RECURSIVE {ARTICLES_SQL}, {LINKS_SQL}, e AS (SELECT source_id AS a, target_id AS b FROM links WHERE source_id <> target_id UNION ALL SELECT target_id, source_id FROM links WHERE source_id <> target_id),
reach AS (SELECT article_id AS a, article_id AS b FROM articles UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT a AS article_id, min(b) AS logical_id, CASE WHEN a IN (SELECT a FROM e) THEN 'merged' ELSE 'standalone' END AS status FROM reach GROUP BY a""")
def k01_logical_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.logical_articles(fixtures.articles(spark, sf_dir), fixtures.links(spark, sf_dir).filter("source_id <> target_id"))


@query(f"{LINK} SELECT target_id % 50 AS page, source_id, confidence FROM links QUALIFY row_number() OVER (PARTITION BY target_id % 50 ORDER BY source_id) = 1")
def d01_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = fixtures.links(spark, sf_dir).select((F.col("target_id") % 50).alias("page"), "source_id", "confidence")
    return A.first_wins(pending, ["page"], ["source_id"])


@query("""SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def d04_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = tables(spark, sf_dir, "orders", "customer")
    return o.select(F.col("o_custkey").alias("k")).union(c.filter("c_acctbal < 0").select("c_custkey")).distinct()


@query("""WITH n AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey + 1000000, c_nationkey, 0.0 FROM customer WHERE c_custkey % 50 = 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'create' WHEN n.c_custkey IS NULL THEN 'delete' ELSE 'edit' END AS change FROM customer o FULL JOIN n ON o.c_custkey = n.c_custkey
WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_acctbal <> n.c_acctbal""")
def d06_draft_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    (old,) = (t.select("c_custkey", "c_nationkey", "c_acctbal") for t in tables(spark, sf_dir, "customer"))
    return A.draft_diff(old, _revised(old), ["c_custkey"], ["c_nationkey", "c_acctbal"])


def _revised(old: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    changed = old.filter(k % 5 != 0).withColumn("c_acctbal", F.when(k % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return changed.unionByName(old.filter(k % 50 == 0).withColumns({"c_custkey": k + 1_000_000, "c_acctbal": F.lit(0.0)}))


@query("""WITH n AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey + 1000000, c_nationkey, 0.0 FROM customer WHERE c_custkey % 50 = 0)
SELECT c_custkey, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n)""")
def m01_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = tables(spark, sf_dir, "customer")[0].select("c_custkey", "c_nationkey", "c_acctbal")
    return A.staged(A.upsert(old, _revised(old), ["c_custkey"]), "customer").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'customer' AS table_name, count(*) AS n_deleted FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def m02_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = tables(spark, sf_dir, "customer", "orders", "lineitem")
    parents = {"orders": ("o_custkey", "customer", "c_custkey"), "lineitem": ("l_orderkey", "orders", "o_orderkey")}
    return A.cascade({"customer": c, "orders": o, "lineitem": li}, parents, "customer", c.filter("c_nationkey = 3"), "c_custkey")[1]


@query("""SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20))""")
def m02_cascade_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = tables(spark, sf_dir, "customer", "orders", "lineitem")
    parents = {"orders": ("o_custkey", "customer", "c_custkey"), "lineitem": ("l_orderkey", "orders", "o_orderkey")}
    return A.cascade({"customer": c, "orders": o, "lineitem": li}, parents, "customer", c.filter("c_nationkey < 20"), "c_custkey")[0]["lineitem"].select("l_orderkey", "l_quantity")


@query("""WITH e AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 0), r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_linenumber <= 2 GROUP BY 1)
SELECT coalesce(e.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE 'duplicate' END AS status FROM e FULL JOIN r ON e.k = r.k WHERE r.k IS NULL OR e.k IS NULL OR r.n > 1""")
def j24_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = tables(spark, sf_dir, "orders", "lineitem")
    expected = o.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"))
    returned = li.filter("l_orderkey % 7 <> 0 AND l_linenumber <= 2").select(F.col("l_orderkey").alias("k"))
    return A.reconcile(expected, returned, ["k"])


@query("""WITH v AS (SELECT l_suppkey, CASE WHEN l_linenumber <= 4 THEN 1 ELSE l_linenumber END AS o FROM lineitem), n AS (SELECT l_suppkey, o, count(*) AS n FROM v GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey)::BIGINT AS votes FROM n QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, o) = 1) SELECT l_suppkey, o AS "offset", n, votes FROM b WHERE votes >= 3 AND n >= 0.55 * votes""")
def a15_dominant_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = tables(spark, sf_dir, "lineitem")
    votes = li.select("l_suppkey", F.when(F.col("l_linenumber") <= 4, 1).otherwise(F.col("l_linenumber")).alias("offset"))
    return A.dominant_offset(votes, ["l_suppkey"], "offset", 3, 0.55)


FOLIOS = "folios AS (SELECT conv_id AS document_id, turn + 3 AS page, CASE WHEN turn % 4 <> 2 THEN turn + 1 END AS folio FROM conversations)"


@query(f"""WITH {FOLIOS}, r AS (SELECT * FROM folios WHERE folio IS NOT NULL), s AS (SELECT document_id, folio, min(page) AS page FROM r GROUP BY ALL HAVING count(*) = 1),
o AS (SELECT document_id, page - folio AS o, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT document_id, arg_max(o, n) AS o FROM o GROUP BY 1 HAVING sum(n) >= 3 AND max(n) >= 0.7 * sum(n)),
i AS (SELECT f.document_id, f.page - b.o AS folio, f.page FROM folios f JOIN b USING (document_id) WHERE (f.document_id, f.page) NOT IN (SELECT (document_id, page) FROM s))
SELECT * FROM s UNION ALL SELECT * FROM i WHERE folio > 0 AND (document_id, folio) NOT IN (SELECT (document_id, folio) FROM s)""")
def k17_page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = tables(spark, sf_dir, "conversations")
    t = F.col("turn")
    return A.page_map(c.select(F.col("conv_id").alias("document_id"), (t + 3).alias("page"), F.when(t % 4 != 2, t + 1).alias("folio")))


CENTRE = """v AS (SELECT vec_id, label, i, x::DOUBLE AS x FROM embeddings, unnest(embedding) WITH ORDINALITY AS u (x, i)), m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label),
c AS (SELECT m.label, i, x / norm AS x FROM m JOIN n USING (label)), w AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY vec_id)"""


@query(f"WITH {CENTRE} SELECT label, (i - 1)::INT AS i, round(x, 6) AS x FROM c")
def a14_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.centroids(tables(spark, sf_dir, "embeddings")[0], "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {CENTRE}, s AS (SELECT v.vec_id, c.label, round(sum(v.x * c.x) / any_value(w.norm), 6) AS score FROM v JOIN c USING (i) JOIN w USING (vec_id) GROUP BY ALL)
SELECT vec_id, CASE WHEN score > 0.20 THEN label END AS category, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1""")
def f29_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = tables(spark, sf_dir, "embeddings")
    return A.classify(e, A.centroids(e, "label", "embedding"), "vec_id", "label", "embedding")


@query(f"WITH {JOBS_SQL} SELECT job_id, arg_max(stage, struct_pack(ts := ts, e := event_id)) AS stage, arg_max(progress, struct_pack(ts := ts, e := event_id)) AS progress, max(ts) AS ts, count(*) AS n_updates FROM job_updates GROUP BY job_id")
def r01_latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(fixtures.job_updates(spark, sf_dir))


@query(f"WITH {JOBS_SQL} SELECT job_id, stage, max(progress) AS progress, count(*) AS n_events FROM job_updates GROUP BY ALL")
def r03_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.progress(fixtures.job_updates(spark, sf_dir))


@query("""SELECT conv_id AS document_id, turn AS source_id, turn * 2 AS target_page, CASE WHEN EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn + 1 = c.turn * 2) THEN 'RESOLVED' ELSE 'PENDING_EXTERNAL' END AS status FROM conversations c WHERE turn % 2 = 0""")
def r02_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = tables(spark, sf_dir, "conversations")
    t = F.col("turn")
    return jobs.carried(c.select(F.col("conv_id").alias("document_id"), (t + 1).alias("page"), F.when(t % 2 == 0, t).alias("source_id"), F.when(t % 2 == 0, t * 2).alias("target_page")))


@query(f"WITH {BLOCKS_SQL} SELECT page_id, count(*)::INT AS total_blocks, string_agg(block_id::VARCHAR, ',' ORDER BY y1, x1, block_id) AS ids FROM blocks GROUP BY page_id")
def s04_page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = documents.page_json(fixtures.blocks(spark, sf_dir), fixtures.PAGE_WIDTH, fixtures.PAGE_HEIGHT)
    return p.select(F.col("page").alias("page_id"), "total_blocks", F.array_join(F.col("blocks")["id"].cast("array<string>"), ",").alias("ids"))


@query("""SELECT s_suppkey, 'Times of India_' || s_name || '_20240' || (1 + s_suppkey % 9) || '15_removed.pdf' AS file, 'The Times of India' AS newspaper_name, s_name AS edition, make_date(2024, (1 + s_suppkey % 9)::INT, 15) AS publish_date FROM supplier""")
def f06_filename_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = tables(spark, sf_dir, "supplier")
    name = F.concat(F.lit("Times of India_"), "s_name", F.lit("_20240"), (1 + F.col("s_suppkey") % 9).cast("string"), F.lit("15_removed.pdf"))
    return s.select("s_suppkey", name.alias("file"), documents.filename_metadata(name).alias("m")).select("s_suppkey", "file", "m.*")


@query("""SELECT r_regionkey, CASE r_regionkey % 4 WHEN 0 THEN r_name || '|x' WHEN 1 THEN r_name || '|y z' WHEN 2 THEN r_name ELSE '' END AS items FROM region""")
def f02_as_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    (r,) = tables(spark, sf_dir, "region")
    k, n = F.col("r_regionkey") % 4, F.col("r_name")
    raw = F.when(k == 0, F.concat(F.lit('["'), n, F.lit('", "x"]'))).when(k == 1, F.concat(n, F.lit(", y z,"))).when(k == 2, n).otherwise("  ")
    return r.select("r_regionkey", F.array_join(documents.as_list(raw), "|").alias("items"))


@query("""SELECT r_regionkey, CASE WHEN r_regionkey % 3 < 2 THEN r_name END AS headline FROM region""")
def f33_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    (r,) = tables(spark, sf_dir, "region")
    k, o = F.col("r_regionkey") % 3, F.to_json(F.struct(F.col("r_name").alias("headline")))
    raw = F.when(k == 0, o).when(k == 1, F.concat(F.lit("```json\n"), o, F.lit("\n```"))).otherwise("[1]")
    return r.select("r_regionkey", documents.model_json(raw, "headline string")["headline"].alias("headline"))


@query("""SELECT p_partkey, round(least(greatest(300 / 72.0, 4500 / greatest(p_size * 40, 600.0)), sqrt(36000000 / (p_size * 40 * 600.0)))::DOUBLE, 6) AS zoom FROM part""")
def s01_raster_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = tables(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(documents.raster_size(F.col("p_size") * 40.0, F.lit(600.0)), 6).alias("zoom"))


@query("""SELECT vec_id, sha2 AS cache_key FROM (SELECT vec_id, sha256(label::VARCHAR) AS sha2 FROM embeddings)""")
def f28_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "embeddings")[0].select("vec_id", adapters.cache_key(F.col("label").cast("string")).alias("cache_key"))


@query(f"""{ART} SELECT article_id FROM articles WHERE list_contains(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(article_text, '')), '[^\\p{{L}}\\p{{N}}'']+'), 'und') AND NOT list_contains(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(article_text, '')), '[^\\p{{L}}\\p{{N}}'']+'), 'zu')""")
def f42_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which articles match; ranks are tested against hand-made cases."""
    return S.search(fixtures.articles(spark, sf_dir), {"title": "A", "article_text": "C"}, "und -zu").select("article_id")


@query()
def f30_overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.merged_texts(fixtures.segments(spark, sf_dir))


def _broken_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as two articles, its first and its last two thirds: the first on nine pages of a document of 25 stories, sending to the second on twelve others.

    Every fourth first part is a photo caption, and every third marker names the words that the second part's headline begins with."""
    (d,) = tables(spark, sf_dir, "documents")
    k, t = F.col("doc_id"), T.text_of("text")
    most, to = F.ceil(F.length(t) * 2 / 3).cast("int"), (k % 12 + 10).cast("string")
    opening = lambda c, n: F.array_join(T.first_words(c, n), " ")
    split = d.select(k, F.left(t, most).alias("first"), F.right(t, most).alias("last"), to.alias("to"))
    slug = F.when(k % 3 == 0, T.jump_slug(F.concat(F.lit("► "), opening("last", 3), F.lit(", Page "), F.col("to"))))
    first = split.select((2 * k).alias("article_id"), F.floor(k / 25).alias("document_id"), (k % 9 + 1).cast("int").alias("page"), F.concat("first", F.lit("\nContinued on Page "), "to").alias("text"), F.when(k % 4 == 3, "photo_caption").otherwise("article").alias("content_type"), slug.alias("jump_slug"))
    last = split.select((2 * k + 1).alias("article_id"), F.floor(k / 25).alias("document_id"), (k % 12 + 10).cast("int").alias("page"), F.col("last").alias("text"), F.lit("article").alias("content_type"), F.lit(None).cast("string").alias("jump_slug"))
    a = first.unionByName(last)
    e = T.entities("text")
    about = T.match_tokens(F.concat_ws(" ", e["people"], e["organizations"], e["dates"], K.keywords_udf()("text")))
    return a.select(*a.columns, opening("text", 8).alias("headline"), F.array_distinct(about).alias("about"), T.jump_page(F.col("text")).alias("next_page"))


@query()
def k15_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by page within a document, scored, matched one to one."""
    kind, text = F.col("content_type"), F.col("text")
    source = T.source_eligible(kind, text, F.col("next_page")) & F.col("next_page").isNotNull()
    told = _broken_stories(spark, sf_dir).withColumns({"is_source": source, "is_target": T.target_eligible(kind, text, F.col("headline"))})
    # Scores read a source's end and a target's beginning: only these go on, and every story is worked out once for both sides.
    near = {"ending": F.when(F.col("is_source"), F.right(T.text_of("text"), F.lit(T.NEAR_BREAK))), "opening": F.when(F.col("is_target"), F.left(T.text_of("text"), F.lit(T.NEAR_BREAK)))}
    a = materialise(told.withColumns(near).drop("text"), "stories")
    sources = a.filter("is_source").withColumnRenamed("ending", "text").drop("opening", "is_source", "is_target")
    targets = a.filter("is_target").withColumnRenamed("opening", "text").drop("ending", "is_source", "is_target")
    return K.accepted(K.score(K.candidates(sources, targets)))


@query()
def w07_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of each newspaper in batches of at most 8 and 20,000 characters."""
    a = fixtures.articles(spark, sf_dir).withColumn("paper", F.regexp_extract("newspaper_name", r"(\d+)", 1).cast("long"))
    return K.batches(a, "paper", "article_id", F.col("n_chars"), 8, 20_000)
