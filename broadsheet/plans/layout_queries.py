"""Queries over layout blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import geometry as G
from broadsheet.functions import lexicons as X
from broadsheet.operators import grouping
from broadsheet.operators import layout as L
from broadsheet.plans.registry import has, query, rlike, strings
from broadsheet.sources.fixtures import ARTICLE_BLOCKS_SQL, BLOCKS_SQL, PAGE_HEIGHT, PAGE_WIDTH, article_blocks, blocks

WITH = f"WITH {BLOCKS_SQL}"
MEMBERS = f"""{WITH}, {ARTICLE_BLOCKS_SQL},
members AS (SELECT b.*, c.article_id FROM (SELECT page_id, block_id, min(article_id) AS article_id FROM article_blocks GROUP BY ALL) c JOIN blocks b USING (page_id, block_id))"""


def xo(a: str, b: str) -> str:
    return f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0)"


def yo(a: str, b: str) -> str:
    return f"greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"


def iou(a: str, b: str) -> str:
    return f"({xo(a, b)} / greatest({a}.x2 - {a}.x1 + {b}.x2 - {b}.x1 - {xo(a, b)}, 1)::DOUBLE)"


def mv(a: str, b: str) -> str:
    return f"({xo(a, b)} / greatest(least({a}.x2 - {a}.x1, {b}.x2 - {b}.x1), 1)::DOUBLE)"


def ct(a: str, b: str) -> str:
    return f"({xo(a, b)} / greatest({a}.x2 - {a}.x1, 1)::DOUBLE)"


def inside(a: str, b: str) -> str:
    return f"({xo(a, b)} * {yo(a, b)} / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))::DOUBLE)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.members(article_blocks(spark, sf_dir), blocks(spark, sf_dir))


@query(f"""{WITH} SELECT page_id, block_id FROM blocks WHERE NOT (cls = 'abandon' OR (length(trim(text)) <= 2 AND cls NOT IN ('object', 'image', 'photo', 'figure', 'title') AND confidence < 0.5)
  OR trim(text) IN {strings(X.PRINTERS_MARKS)} OR (cls IN ('plain text', 'title', 'figure_caption') AND y2 - y1 > 0.6 * {PAGE_HEIGHT}) OR (cls IN ('plain text', 'figure_caption') AND x2 - x1 > 0.55 * {PAGE_WIDTH} AND (x2 - x1) / greatest(y2 - y1, 1)::DOUBLE < 8))""")
def p01_p02_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return b.filter(~L.noise(b) & ~L.oversize(PAGE_WIDTH, PAGE_HEIGHT)).select("page_id", "block_id")


@query(f"""{WITH} SELECT page_id, block_id, least(floor((x1 + x2) / 2.0 / ({PAGE_WIDTH} / 6.0)), 5)::INT AS lane, 5 - least(floor((x1 + x2) / 2.0 / ({PAGE_WIDTH} / 6.0)), 5)::INT AS lane_rtl FROM blocks""")
def p04_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("page_id", "block_id", L.lane(PAGE_WIDTH).alias("lane"), L.lane(PAGE_WIDTH, True).alias("lane_rtl"))


HEADED = """headed AS (SELECT page_id, block_id, cls, x1, y1, x2, y2, CASE block_id % 7 WHEN 0 THEN 'The Hindu ' || text WHEN 1 THEN 'VOL. 12 MONDAY' WHEN 2 THEN 'Monday 4, 2024' WHEN 3 THEN 'Sports 4' WHEN 4 THEN 'Photo: PTI' ELSE text END AS text FROM blocks)"""


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with some texts of page furniture."""
    k = F.col("block_id") % 7
    t = F.when(k == 0, F.concat(F.lit("The Hindu "), "text")).when(k == 1, "VOL. 12 MONDAY").when(k == 2, "Monday 4, 2024").when(k == 3, "Sports 4").when(k == 4, "Photo: PTI").otherwise(F.col("text"))
    return blocks(spark, sf_dir).withColumn("text", t)


@query(f"""{WITH}, {HEADED}, w AS (SELECT *, greatest(max(x2) OVER (PARTITION BY page_id), 1) AS pw, upper(text) AS up FROM headed)
SELECT page_id, block_id,
  (y2 <= 0.12 * {PAGE_HEIGHT} AND ({has("up", X.MASTHEADS)} OR {has("text", X.MASTHEADS_OTHER)})) OR (y1 < 0.15 * {PAGE_HEIGHT} AND x2 - x1 >= 0.75 * {PAGE_WIDTH}) AS masthead,
  (y1 < 0.16 * {PAGE_HEIGHT} AND x2 - x1 >= 0.5 * pw AND y2 - y1 <= 0.05 * {PAGE_HEIGHT}) OR (text <> '' AND y2 <= 0.15 * {PAGE_HEIGHT} AND y2 - y1 <= 0.05 * {PAGE_HEIGHT} AND (x2 - x1) / pw::DOUBLE <= 0.75 AND length(text) <= 100
    AND NOT {has("up", X.ARTICLE_SIGNS)} AND ({has("up", X.HEADER_WORDS)}) AND ({rlike("up", X.HEADER_PATTERNS)} OR regexp_matches(up, '{X.HEADER_DAY}'))) AS page_header,
  regexp_matches(up, '{X.SECTION_HEADER[0]}') AS section_header, {rlike("up", X.CAPTION_LINES)} AS caption FROM w""")
def p05_p08_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headed(spark, sf_dir).select(
        "page_id", "block_id", L.masthead(PAGE_WIDTH, PAGE_HEIGHT).alias("masthead"), L.page_header(PAGE_HEIGHT, True).alias("page_header"), L.section_header().alias("section_header"), L.caption_line().alias("caption")
    )


@query(f"""{WITH}, roles AS (SELECT page_id, block_id, CASE WHEN cls = 'abandon' THEN 'decoration' WHEN cls = 'figure' THEN 'article_image' WHEN cls = 'figure_caption' THEN 'caption' WHEN cls = 'title' THEN 'article_title' WHEN cls = 'plain text' THEN 'article_text' ELSE 'unknown' END AS role FROM blocks)
SELECT page_id, role, count(*) AS n FROM roles GROUP BY ALL""")
def p10_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).withColumn("role", L.role()).groupBy("page_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{MEMBERS}, r AS (SELECT *, CASE WHEN block_id % 10 = 0 THEN 'weather' WHEN cls = 'abandon' THEN 'decoration' WHEN cls = 'title' THEN 'article_title' WHEN cls = 'plain text' THEN 'article_text' ELSE 'caption' END AS role FROM members),
s AS (SELECT *, bool_or(role = 'article_title') OVER w AND bool_or(role = 'article_text') OVER w AS whole FROM r WINDOW w AS (PARTITION BY page_id, article_id))
SELECT page_id, article_id, block_id, role FROM s WHERE role NOT IN {strings(L.IGNORED_ROLES)} OR (role = 'weather' AND whole)""")
def p12_ignored_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cls")
    role = F.when(F.col("block_id") % 10 == 0, "weather").when(c == "abandon", "decoration").when(c == "title", "article_title").when(c == "plain text", "article_text").otherwise("caption")
    return L.drop_ignored(members(spark, sf_dir).withColumn("role", role)).select("page_id", "article_id", "block_id", "role")


@query(f"""{WITH}, lines AS (SELECT page_id, block_id, x1 + 10 AS x1, y1 + 5 AS y1, x2 - 10 AS x2, y1 + 35 AS y2 FROM blocks),
p AS (SELECT a.page_id, a.block_id AS line_id, b.block_id, {inside("a", "b")} AS share, (a.x1 + a.x2) / 2.0 BETWEEN b.x1 AND b.x2 AND (a.y1 + a.y2) / 2.0 BETWEEN b.y1 AND b.y2 AS centred FROM lines a JOIN blocks b USING (page_id)),
s AS (SELECT *, CASE WHEN centred THEN 1 + share ELSE share END AS score FROM p WHERE centred OR share >= 0.2)
SELECT page_id, line_id, block_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY page_id, line_id ORDER BY score DESC, block_id) = 1""")
def j04_lines_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    lines = b.select("page_id", "block_id", (F.col("x1") + 10).alias("x1"), (F.col("y1") + 5).alias("y1"), (F.col("x2") - 10).alias("x2"), (F.col("y1") + 35).alias("y2"))
    return L.lines_to_blocks(lines, b).withColumn("score", F.round("score", 6))


GAPS = f"""gaps AS (SELECT a.page_id, a.block_id, a.y1 - b.y2 AS gap, b.block_id AS above_id FROM blocks a JOIN blocks b ON a.page_id = b.page_id AND a.block_id <> b.block_id AND b.y2 <= a.y1 AND {iou("a", "b")} >= 0.35
  QUALIFY row_number() OVER (PARTITION BY a.page_id, a.block_id ORDER BY a.y1 - b.y2, b.block_id) = 1)"""
MEDIAN = "medians AS (SELECT page_id, median(gap)::DOUBLE AS median_gap, greatest(25.0, 2 * median(gap))::DOUBLE AS threshold FROM gaps WHERE gap > 0 GROUP BY page_id)"


@query(f"{WITH}, {GAPS} SELECT page_id, block_id, gap, above_id FROM gaps")
def j05_nearest_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.gaps_above(blocks(spark, sf_dir))


@query(f"{WITH}, {GAPS}, {MEDIAN} SELECT * FROM medians")
def a05_median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.median_gaps(blocks(spark, sf_dir))


@query(f"""{WITH}, t AS (SELECT * FROM blocks WHERE cls = 'title'), x AS (SELECT * FROM blocks WHERE cls <> 'title')
SELECT a.page_id, a.block_id, b.block_id AS root_id FROM x a JOIN t b ON a.page_id = b.page_id AND b.y1 <= a.y1 AND {ct("a", "b")} >= 0.35 QUALIFY row_number() OVER (PARTITION BY a.page_id, a.block_id ORDER BY b.y1 DESC, b.block_id) = 1""")
def j07_owning_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return L.owning_root(b.filter("cls <> 'title'"), b.filter("cls = 'title'"))


@query(f"""{WITH}, t AS (SELECT * FROM blocks WHERE cls = 'title'), x AS (SELECT * FROM blocks WHERE cls <> 'title')
SELECT a.page_id, a.block_id, b.block_id AS root_id FROM x a JOIN t b ON a.page_id = b.page_id AND b.y1 > a.y1 AND {iou("a", "b")} >= 0.35 QUALIFY row_number() OVER (PARTITION BY a.page_id, a.block_id ORDER BY b.y1, b.block_id) = 1""")
def j07_next_root_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return L.next_root_below(b.filter("cls <> 'title'"), b.filter("cls = 'title'"))


BODIED = f"""bodied AS (SELECT DISTINCT a.page_id, a.block_id FROM blocks a JOIN blocks b ON a.page_id = b.page_id AND a.cls = 'title' AND b.cls = 'plain text' AND b.y1 >= a.y2 + 2 AND {ct("b", "a")} >= 0.35)"""


@query(f"{WITH}, {BODIED} SELECT * FROM bodied")
def j08_body_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return L.with_body_below(b.filter("cls = 'title'"), b.filter("cls = 'plain text'")).select("page_id", "block_id")


@query(f"""{WITH}, p AS (SELECT a.page_id, a.block_id AS a_id, b.block_id AS b_id, a.x1 AS ax1, a.x2 AS ax2, a.y1 AS ay1, a.y2 AS ay2, b.x1 AS bx1, b.x2 AS bx2, b.y1 AS by1, b.y2 AS by2 FROM blocks a JOIN blocks b ON a.page_id = b.page_id AND a.cls = 'title' AND b.cls = 'plain text' AND b.y1 >= a.y2 AND {mv("a", "b")} >= 0.35)
SELECT page_id, a_id, b_id FROM p WHERE NOT EXISTS (SELECT 1 FROM blocks c WHERE c.page_id = p.page_id AND c.cls = 'title' AND c.block_id <> a_id AND c.block_id <> b_id AND (c.y1 + c.y2) / 2.0 BETWEEN least(ay2, by2) AND greatest(ay1, by1) AND c.x1 < least(ax2, bx2) AND c.x2 > greatest(ax1, bx1))""")
def j09_no_title_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    t = b.filter("cls = 'title'")
    found = L.pairs(t, b.filter("cls = 'plain text'"), (L.B.y1 >= L.A.y2) & (G.col_overlap(L.A, L.B) >= 0.35))
    return L.no_title_between(found, t).select("page_id", F.col("a.block_id").alias("a_id"), F.col("b.block_id").alias("b_id"))


@query(f"{MEMBERS} SELECT page_id, block_id, article_id FROM members")
def j03_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).select("page_id", "block_id", "article_id")


@query(f"""{WITH}, {ARTICLE_BLOCKS_SQL}, c AS (SELECT page_id, block_id, count(*) AS claims, min(article_id) AS first_id FROM article_blocks GROUP BY ALL),
x AS (SELECT ab.article_id, c.claims, c.first_id, b.* FROM article_blocks ab JOIN c USING (page_id, block_id) JOIN blocks b USING (page_id, block_id)),
d AS (SELECT a.page_id, a.block_id, a.article_id, a.first_id, min(greatest(b.y1 - a.y2, a.y1 - b.y2, 0) + (1 - {iou("a", "b")}) * 100000) AS d FROM x a JOIN x b ON a.page_id = b.page_id AND a.article_id = b.article_id AND a.claims > 1 AND b.claims = 1 GROUP BY ALL),
m AS (SELECT page_id, block_id, first_id, min(d) AS best, min(CASE WHEN article_id = first_id THEN d END) AS own, arg_min(article_id, struct_pack(d := d, a := article_id)) AS best_id FROM d GROUP BY ALL)
SELECT page_id, block_id, CASE WHEN own <= best + 50 THEN first_id ELSE best_id END AS article_id FROM m""")
def a06_contested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.contested(article_blocks(spark, sf_dir), blocks(spark, sf_dir))


@query(f"""{MEMBERS} SELECT page_id, article_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_blocks, min(confidence) AS confidence, max(x2) - min(x1) AS width, max(y2) - min(y1) AS height, (max(x2) - min(x1))::BIGINT * (max(y2) - min(y1)) AS area FROM members GROUP BY ALL""")
def a03_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.boundaries(members(spark, sf_dir))


@query(f"""{MEMBERS}, r AS (SELECT page_id, article_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM members GROUP BY ALL),
h AS (SELECT a.page_id, b.article_id, a.block_id AS foreign_id, a.article_id AS owner_id, a.x1, a.y1, a.x2, a.y2 FROM members a JOIN r b ON a.page_id = b.page_id AND a.article_id <> b.article_id AND a.cls IN ('plain text', 'title', 'figure_caption', 'figure') AND {inside("a", "b")} >= 0.75)
SELECT h.page_id, h.article_id, foreign_id, owner_id, round(max({inside("h", "m")}), 6) AS own_share FROM h JOIN members m ON m.page_id = h.page_id AND m.article_id = h.article_id GROUP BY ALL HAVING max({inside("h", "m")}) <= 0.30""")
def j17_foreign_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.foreign_overlap(members(spark, sf_dir)).withColumn("own_share", F.round("own_share", 6))


@query(f"""{WITH} SELECT a.page_id, a.block_id, count(*) AS n_near FROM blocks a JOIN blocks b ON a.page_id = b.page_id AND a.block_id <> b.block_id AND {mv("a", "b")} >= 0.35 AND b.y2 >= a.y1 - 900 AND b.y1 <= a.y2 + 900 GROUP BY ALL""")
def a21_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.density(blocks(spark, sf_dir))


def _components(nodes: str, edges: str) -> str:
    """SQL for components of pairs (page_id, a, b) among nodes (page_id, block_id)."""
    return f"""nodes AS ({nodes}), edges AS ({edges}), both_ways AS (SELECT page_id, a, b FROM edges UNION ALL SELECT page_id, b, a FROM edges),
reach AS (SELECT page_id, block_id AS a, block_id AS b FROM nodes UNION SELECT r.page_id, r.a, e.b FROM reach r JOIN both_ways e ON e.page_id = r.page_id AND e.a = r.b),
grouped AS (SELECT page_id, a AS block_id, min(b) AS group_id FROM reach GROUP BY ALL)"""


LOW = "greatest(least(a.y2 - a.y1, b.y2 - b.y1), 1)"
BANNER = f"""a.block_id < b.block_id AND {LOW} / greatest(a.y2 - a.y1, b.y2 - b.y1, 1)::DOUBLE >= 0.75 AND abs(a.y1 - b.y1) <= 0.35 * {LOW} AND abs(a.y2 - b.y2) <= 0.35 * {LOW}
  AND greatest(a.x1, b.x1) - least(a.x2, b.x2) <= 0.75 * {LOW} AND least(a.x2, b.x2) - greatest(a.x1, b.x1) <= 0.5 * greatest(least(a.x2 - a.x1, b.x2 - b.x1), 1)"""


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, {_components("SELECT page_id, block_id FROM blocks WHERE cls = 'title'", f"SELECT a.page_id, a.block_id AS a, b.block_id AS b FROM blocks a JOIN blocks b ON a.page_id = b.page_id AND a.cls = 'title' AND b.cls = 'title' AND {BANNER}")} SELECT * FROM grouped""")
def k02_banner_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.banner_groups(blocks(spark, sf_dir))


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, {_components("SELECT page_id, block_id FROM blocks", f"SELECT a.page_id, a.block_id AS a, b.block_id AS b FROM blocks a JOIN blocks b ON a.page_id = b.page_id AND a.block_id < b.block_id AND abs(a.y1 - b.y1) <= 20 AND abs(a.y2 - b.y2) <= 20 AND {mv('a', 'b')} <= 0.2")}
SELECT * FROM grouped QUALIFY count(*) OVER (PARTITION BY page_id, group_id) >= 2""")
def k03_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.row_groups(blocks(spark, sf_dir))


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, {_components("SELECT page_id, block_id FROM blocks", "SELECT a.page_id, a.block_id AS a, b.block_id AS b FROM blocks a JOIN blocks b ON a.page_id = b.page_id AND a.block_id < b.block_id AND sqrt(greatest(b.x1 - a.x2, a.x1 - b.x2, 0) ** 2 + greatest(b.y1 - a.y2, a.y1 - b.y2, 0) ** 2) <= 70")} SELECT * FROM grouped""")
def j18_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clusters(blocks(spark, sf_dir), PAGE_WIDTH)


@query(f"{WITH} SELECT page_id, block_id, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, block_id)::INT - 1 AS reading_order FROM blocks")
def w01_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reading_order(blocks(spark, sf_dir)).select("page_id", "block_id", "reading_order")


@query(f"{MEMBERS} SELECT page_id, article_id, round(sum((x2 - x1)::BIGINT * (y2 - y1)) / greatest((max(x2) - min(x1))::BIGINT * (max(y2) - min(y1)), 1)::DOUBLE, 6) AS fill FROM members GROUP BY ALL")
def a16_fill_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fill_ratio(members(spark, sf_dir)).withColumn("fill", F.round("fill", 6))


STORY = f"""{MEMBERS}, g AS (SELECT page_id, article_id, count(*) FILTER (cls = 'title') AS n_titles, count(*) FILTER (cls = 'plain text') AS n_paragraphs, coalesce(sum(length(text)) FILTER (cls = 'plain text'), 0)::BIGINT AS n_chars, count(*) AS n_blocks, bool_or(cls = 'figure') AS has_image,
  (max(x2) - min(x1))::BIGINT * (max(y2) - min(y1)) AS area FROM members GROUP BY ALL)"""


@query(f"{STORY} SELECT *, n_titles <= 4 AND n_paragraphs >= 3 AND n_chars >= 60 AND n_chars >= 15 * n_paragraphs AND n_blocks <= 24 AND 100 * area >= {PAGE_WIDTH * PAGE_HEIGHT} AS is_story FROM g")
def a17_story_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts here are a tenth as long as a newspaper's, and so are the limits on them."""
    return L.story_shape(members(spark, sf_dir), PAGE_WIDTH * PAGE_HEIGHT, least_chars=60, least_mean=15)


@query(f"""{MEMBERS} SELECT page_id, article_id, coalesce(array_to_string(list_sort(list(block_id) FILTER (cls = 'title')), ','), '') AS headline_ids, coalesce(array_to_string(list_sort(list(block_id) FILTER (cls = 'plain text')), ','), '') AS body_ids,
  coalesce(array_to_string(list_sort(list(block_id) FILTER (cls = 'figure')), ','), '') AS image_ids FROM members GROUP BY ALL""")
def a18_role_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.role_breakdown(members(spark, sf_dir))
    return r.select("page_id", "article_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("headline_ids", "body_ids", "image_ids")))


@query(f"{MEMBERS} SELECT page_id, block_id, y2 - y1 AS line_height, y2 - y1 >= 0.65 * max(y2 - y1) OVER (PARTITION BY page_id, article_id) AS dominant FROM members WHERE cls = 'title'")
def w09_tall_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tall_titles(members(spark, sf_dir)).select("page_id", "block_id", "line_height", "dominant")


TOPS = """r AS (SELECT *, row_number() OVER (PARTITION BY page_id, article_id ORDER BY y1, x1, block_id) AS k, count(*) OVER (PARTITION BY page_id, article_id) AS n FROM members),
rest AS (SELECT page_id, article_id, max(x2 - x1) AS widest, (max(x2) - min(x1))::BIGINT * (max(y2) - min(y1)) AS box, sum((x2 - x1)::BIGINT * (y2 - y1)) AS area FROM r WHERE k > 1 GROUP BY ALL)"""


@query(f"{MEMBERS}, {TOPS} SELECT r.page_id, r.block_id FROM r JOIN rest USING (page_id, article_id) WHERE k = 1 AND n > 1 AND x2 - x1 > 0.30 * {PAGE_WIDTH} AND (widest < 0.1615384615 * {PAGE_WIDTH} OR area / greatest(box, 1)::DOUBLE < 0.30)")
def k10_wide_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks here are at most 870 wide, so the page is taken as 6 / 13 of its width: the ratios are the rule's own."""
    return L.wide_tops(members(spark, sf_dir), PAGE_WIDTH * 6 / 13).filter("detach").select("page_id", "block_id")


@query(f"""{MEMBERS} SELECT a.page_id, a.block_id, b.block_id AS title_id, greatest(a.y1 - b.y2, 0) AS gap FROM members a JOIN members b ON a.page_id = b.page_id AND a.article_id = b.article_id AND b.cls = 'title' AND a.block_id <> b.block_id AND b.y1 <= a.y1 AND {mv("a", "b")} >= 0.35
QUALIFY row_number() OVER (PARTITION BY a.page_id, a.block_id ORDER BY greatest(a.y1 - b.y2, 0), b.block_id) = 1""")
def w08_governing_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.governing_title(members(spark, sf_dir))


@query(f"""{MEMBERS}, g AS (SELECT *, CASE WHEN y1 - lag(y2) OVER w > 300 THEN 1 ELSE 0 END AS broken FROM members WINDOW w AS (PARTITION BY page_id, article_id ORDER BY y1, x1, block_id))
SELECT page_id, block_id, max(broken) OVER (PARTITION BY page_id, article_id ORDER BY y1, x1, block_id ROWS UNBOUNDED PRECEDING) = 1 AND cls <> 'title' AS orphan FROM g""")
def w06_distant_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.distant_orphans(members(spark, sf_dir)).select("page_id", "block_id", "orphan")


@query(f"{WITH} SELECT page_id, max(x2) AS page_width, max(y2) AS page_height FROM blocks GROUP BY ALL")
def w13_page_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_extent(blocks(spark, sf_dir))


@query(f"""{WITH}, {GAPS}, {MEDIAN}, {BODIED} SELECT b.page_id, b.block_id, d.block_id IS NOT NULL OR g.gap IS NULL OR g.gap >= coalesce(m.threshold, 25.0) AS is_root
FROM blocks b LEFT JOIN bodied d USING (page_id, block_id) LEFT JOIN gaps g USING (page_id, block_id) LEFT JOIN medians m USING (page_id) WHERE b.cls = 'title'""")
def k07_root_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.root_titles(blocks(spark, sf_dir))


GEO = f"""{WITH}, n AS (SELECT a, lead(a) OVER (PARTITION BY page_id ORDER BY block_id) AS b FROM blocks a), p AS (SELECT a.page_id, a.block_id AS a_id, b.block_id AS b_id, {iou("a", "b")} AS col_iou, {mv("a", "b")} AS col_overlap, {ct("a", "b")} AS containment,
  {yo("a", "b")} / least(a.y2 - a.y1, b.y2 - b.y1)::DOUBLE AS row_overlap, {xo("a", "b")} * {yo("a", "b")} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {xo("a", "b")} * {yo("a", "b")})::DOUBLE AS iou,
  greatest(b.y1 - a.y2, a.y1 - b.y2, 0) + (1 - {iou("a", "b")}) * 100000 AS distance FROM n WHERE b.block_id = a.block_id + 1)"""


@query(f"{GEO} SELECT page_id, a_id, b_id, {', '.join(f'round({c}, 6) AS {c}' for c in ('col_iou', 'col_overlap', 'containment', 'row_overlap', 'iou', 'distance'))} FROM p")
def g01_g06_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    p = L.pairs(b, b, F.col("b.block_id") == F.col("a.block_id") + 1)
    measures = {"col_iou": G.col_iou, "col_overlap": G.col_overlap, "containment": G.containment, "row_overlap": G.row_overlap, "iou": G.iou, "distance": G.layout_distance}
    return p.select("page_id", F.col("a.block_id").alias("a_id"), F.col("b.block_id").alias("b_id"), *(F.round(f(L.A, L.B), 6).alias(c) for c, f in measures.items()))


@query(f"{WITH} SELECT page_id, block_id, x2 - x1 AS width, y2 - y1 AS height, (x1 + x2) / 2.0::DOUBLE AS center_x, (y1 + y2) / 2.0::DOUBLE AS center_y FROM blocks")
def f43_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.box()
    return blocks(spark, sf_dir).select("page_id", "block_id", b.width.alias("width"), b.height.alias("height"), b.center_x.alias("center_x"), b.center_y.alias("center_y"))


@query()
def k07_local_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages into articles: the stateful scan, per page."""
    return grouping.group_articles(blocks(spark, sf_dir))


@query()
def k05_orphan_reassignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.reassign_orphans(members(spark, sf_dir))


@query()
def d02_coverage_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.coverage_dedupe(members(spark, sf_dir))


@query()
def j06_duplicate_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.merge_duplicates(blocks(spark, sf_dir))


@query()
def j10_figures_and_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.figures_and_captions(blocks(spark, sf_dir))


@query()
def t04_column_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.assemble_texts(members(spark, sf_dir))


@query()
def p03_enclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.enclosures(blocks(spark, sf_dir))


@query()
def k04_sidebox_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.absorb_sideboxes(L.boundaries(members(spark, sf_dir)))
