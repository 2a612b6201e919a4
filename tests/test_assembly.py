from pyspark.sql import functions as F

from broadsheet.operators import assembly as S
from broadsheet.operators import layout as L
from broadsheet.plans import archive
from tests.test_layout import BLOCK


def blocks(spark, *rows):
    """(block_id, article_id, cls, x1, y1, x2, y2, text) on one page."""
    made = [(1, k, a, c, x1, y1, x2, y2, 0.9, 0.9, t) for k, a, c, x1, y1, x2, y2, t in rows]
    return spark.createDataFrame(made, BLOCK.replace("block_id int,", "block_id int, article_id int,"))


def test_late_attachments(spark):
    b = blocks(
        spark,
        (1, 1, "title", 0, 0, 200, 40, "t"), (2, 1, "figure", 0, 50, 200, 150, ""), (3, 2, "plain text", 500, 0, 700, 300, "x"),
        (4, None, "figure_caption", 0, 160, 200, 180, "caption"), (5, None, "plain text", 500, 310, 700, 400, "more"), (6, None, "plain text", 3000, 3000, 3100, 3100, "far"), (7, None, "plain text", 210, 20, 240, 60, "beside"),
    )
    assert {(r.block_id, r.article_id, r.how) for r in S.attach(b).collect()} == {(4, 1, "caption"), (5, 2, "column"), (7, 1, "footprint")}


def test_headless_articles_take_a_heading(spark):
    b = blocks(spark, (1, 1, "title", 0, 0, 200, 40, "own"), (2, 1, "title", 300, 0, 500, 40, "lent"), (3, 2, "plain text", 300, 60, 500, 300, "headless"), (4, 3, "plain text", 900, 60, 990, 300, "none near"))
    assert [(r.block_id, r.article_id) for r in S.relink_headlines(b).collect()] == [(2, 2)]


def test_tight_pairs(spark):
    b = blocks(spark, (1, None, "title", 0, 0, 200, 40, "h"), (2, None, "plain text", 0, 50, 200, 300, "x" * 200), (3, None, "title", 0, 10, 200, 45, "second"), (4, None, "plain text", 300, 50, 500, 300, "x" * 200))
    assert [(r.heading_id, r.text_id) for r in S.tight_pairs(b).collect()] == [(1, 2)]


def test_split_keeps_every_block(spark):
    b = blocks(
        spark,
        (1, 1, "title", 0, 0, 200, 40, "a"), (2, 1, "plain text", 0, 50, 200, 300, "x"), (3, 1, "title", 600, 900, 800, 940, "b"), (4, 1, "plain text", 600, 950, 800, 1200, "y"),
        (5, 2, "title", 0, 2000, 200, 2040, "one"), (6, 2, "plain text", 0, 2050, 200, 2300, "z"),
    )
    rows = S.split_oversized(b).collect()
    assert sorted(r.block_id for r in rows) == [1, 2, 3, 4, 5, 6]
    parts = {}
    for r in rows:
        parts.setdefault((r.article_id, r.part), set()).add(r.block_id)
    assert sorted(map(sorted, parts.values())) == [[1, 2], [3, 4], [5, 6]]


def test_dropped_stories_come_back(spark):
    text = "x" * 250
    free = blocks(spark, (1, None, "title", 0, 0, 400, 40, "t"), *((k, None, "plain text", 0, 60 * (k - 1), 400, 60 * (k - 1) + 50, text) for k in (2, 3, 4)), (9, None, "plain text", 2000, 2000, 2100, 2100, text))
    owned = blocks(spark, (20, 1, "plain text", 1000, 0, 1400, 300, "own"))
    found = S.recover_dropped(free, owned, L.clusters(free, 2800), 1_000_000)
    assert sorted(r.block_id for r in found.collect()) == [1, 2, 3, 4]
    inside = blocks(spark, (20, 1, "plain text", 10, 10, 100, 100, "own"))
    assert S.recover_dropped(free, inside, L.clusters(free, 2800), 1_000_000).count() == 0
    assert S.recover_dropped(free, owned, L.clusters(free, 2800), 300_000).count() == 0  # over a quarter of the page


def test_regions_attach_and_cluster(spark):
    b = blocks(spark, (1, 4, "plain text", 0, 0, 100, 100, ""), (2, None, "plain text", 0, 110, 100, 200, ""), (3, None, "plain text", 0, 230, 100, 300, ""), (4, None, "plain text", 500, 0, 600, 100, ""), (5, None, "plain text", 500, 120, 600, 200, ""), (6, None, "plain text", 900, 900, 990, 990, ""))
    assert {r.block_id: r.article_id for r in S.cluster_regions(b).collect()} == {2: 4, 3: 4, 4: 5, 5: 5}


def test_headline_of_lines(spark):
    b = blocks(spark, (1, 1, "title", 0, 0, 100, 50, "Big"), (2, 1, "title", 0, 60, 100, 105, "Words"), (3, 1, "title", 0, 110, 100, 130, "kicker"), (4, 2, "plain text", 0, 0, 9, 9, "a long line, with commas, and more, that ends in a stop."), (5, 2, "plain text", 0, 20, 9, 29, "Short Title Line"))
    got = {r.article_id: (r.headline, r.subheadline) for r in S.headline(b.withColumn("block_class", F.col("cls"))).collect()}
    assert got == {1: ("Big Words", "kicker"), 2: ("Short Title Line", None)}


def test_sections_and_headings(spark):
    a = spark.createDataFrame([(1, 10, 3, "budget speech minister parliament"), (1, 11, 4, "cricket match final"), (1, 12, 9, "budget speech minister parliament")], "document_id long, article_id long, page long, text string")
    s = spark.createDataFrame([(1, 1, 4, "minister budget parliament debate"), (1, 2, 4, "nothing shared")], "document_id long, section_id long, page long, text string")
    assert [(r.section_id, r.article_id) for r in S.sections_to_articles(s, a).collect()] == [(1, 10)]
    b = blocks(spark, (1, 1, "title", 0, 0, 9, 9, "India wins the series decider"), (2, 1, "title", 0, 0, 9, 9, "India wins"), (3, 1, "plain text", 0, 0, 9, 9, "India wins series"))
    h = spark.createDataFrame([(1, 7, "INDIA WINS!"), (1, 8, "other words"), (1, 9, " ")], "page_id long, heading_id int, heading string")
    assert [(r.heading_id, r.block_id) for r in S.headings_to_blocks(h, b).collect()] == [(7, 2)]


def test_chrome_leaves_an_article(spark):
    b = blocks(spark, (1, 1, "abandon", 0, 0, 900, 10, ""), (2, 1, "plain text", 100, 50, 300, 200, "x"), (3, 2, "abandon", 0, 0, 900, 10, ""))
    assert sorted(r.block_id for r in S.without_chrome(b).collect()) == [2, 3]


def test_archive_from_blocks(spark):
    from broadsheet.sources.fixtures import articles, segments
    from broadsheet.sources.fixtures import blocks as fixture_blocks
    from tests.conftest import SF

    built = archive.build(fixture_blocks(spark, SF))
    n = built.boundaries.count()
    assert n == built.articles.count() > 0
    outside = built.members.join(built.boundaries.select("page_id", "article_id", *(F.col(c).alias(f"r{c}") for c in ("x1", "y1", "x2", "y2"))), ["page_id", "article_id"]).filter("x1 < rx1 OR y1 < ry1 OR x2 > rx2 OR y2 > ry2")
    assert outside.count() == 0
    api = archive.Api(spark, articles(spark, SF), segments(spark, SF))
    total, page = api.search("the -zu", limit=500, offset=-3)
    assert page.count() == min(100, total.first()[0]) and api.search()[0].first()[0] == 200
    assert api.newspapers().count() > 1 and api.article(5).first().segments is not None and api.dates("src1").count() > 0
