import json
import random

from pyspark.sql import functions as F

from broadsheet.functions import geometry as G
from broadsheet.operators import archive, graph, grouping, layout, linkage
from broadsheet.sources import documents
from tests.llm_free import union_find

BLOCK = "page_id long, block_id int, cls string, x1 int, y1 int, x2 int, y2 int, confidence double, ocr_confidence double, text string"


def page(spark, *rows):
    return spark.createDataFrame([(1, k, c, x1, y1, x2, y2, 0.9, s, t) for k, (c, x1, y1, x2, y2, s, t) in enumerate(rows, 1)], BLOCK)


def test_overlaps(spark):
    r = spark.sql("SELECT 0 AS ax1, 0 AS ay1, 100 AS ax2, 10 AS ay2, 50 AS bx1, 5 AS by1, 250 AS bx2, 15 AS by2")
    v = r.select(G.col_iou(G.box("a"), G.box("b")), G.col_overlap(G.box("a"), G.box("b")), G.containment(G.box("a"), G.box("b")), G.row_overlap(G.box("a"), G.box("b")), G.inside(G.box("a"), G.box("b"))).first()
    assert tuple(v) == (50 / 250, 0.5, 0.5, 0.5, 0.25)


def test_l_shape(spark):
    r = spark.sql("SELECT 0 AS ax1, 0 AS ay1, 100 AS ax2, 100 AS ay2, 60 AS bx1, 0 AS by1, 100 AS bx2, 40 AS by2")
    band, rest = r.select(G.l_shape(G.box("a"), G.box("b"))).first()[0]
    assert tuple(band) == (0, 40, 100, 100) and tuple(rest) == (0, 0, 60, 40)
    assert r.selectExpr("ax1", "ay1", "ax2", "ay2", "30 AS bx1", "30 AS by1", "60 AS bx2", "60 AS by2").select(G.l_shape(G.box("a"), G.box("b"))).first()[0] is None


def test_lanes(spark):
    r = spark.sql("SELECT 5 AS x1, 0 AS y1, 15 AS x2, 9 AS y2").select(layout.lane(600), layout.lane(600, True)).first()
    assert tuple(r) == (0, 5)


def test_components_against_union_find(spark):
    rng = random.Random(1)
    for n, m in ((30, 10), (60, 60), (200, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1060)]
        want = union_find({x for e in edges for x in e}, edges)
        df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
        assert {r.node: r.component for r in graph.connected_components(df).collect()} == want
    assert graph.connected_components(df.limit(0)).count() == 0


def test_grouping_of_a_page(spark):
    b = page(
        spark,
        ("title", 0, 0, 400, 50, 0.9, "One"), ("plain text", 0, 60, 190, 300, 0.9, "a"), ("plain text", 0, 310, 190, 500, 0.9, "b"),
        ("title", 500, 0, 900, 50, 0.9, "Two"), ("plain text", 500, 60, 900, 300, 0.9, "c"), ("plain text", 0, 2000, 190, 2100, 0.9, "far"), ("title", 1500, 0, 1600, 40, 0.9, "lone"),
    )
    got = {}
    for r in grouping.group_articles(b).collect():
        got.setdefault(r.article_id, []).append(r.block_id)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3], [4, 5], [6]]


def test_every_block_stays_in_one_article(spark):
    from broadsheet.sources.fixtures import blocks
    from tests.conftest import SF

    b = blocks(spark, SF)
    g = grouping.group_articles(b)
    assert g.groupBy("page_id", "block_id").count().filter("count > 1").count() == 0
    assert g.join(b, ["page_id", "block_id"], "left_anti").count() == 0
    shuffled = grouping.group_articles(b.orderBy(F.rand(3)))
    assert sorted(map(tuple, g.collect())) == sorted(map(tuple, shuffled.collect()))


def test_orphans_move_to_the_nearest(spark):
    b = page(spark, ("title", 0, 0, 100, 50, 1.0, "t"), ("plain text", 0, 60, 100, 200, 1.0, "x"), ("title", 500, 0, 600, 50, 1.0, "u"), ("plain text", 500, 60, 600, 200, 1.0, "y"), ("plain text", 500, 210, 600, 300, 1.0, "z"))
    m = b.withColumn("article_id", F.when(F.col("block_id").isin(1, 2, 5), 1).otherwise(2))
    assert {r.block_id: r.article_id for r in grouping.reassign_orphans(m).collect()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2}


def test_text_of_an_article():
    B = grouping.Block
    mk = lambda i, c, x1, y1, x2, y2, t, s=0.8: B(block_id=i, cls=c, x1=x1, y1=y1, x2=x2, y2=y2, text=t, ocr_confidence=s)
    text, sure = grouping.article_text([mk(1, "plain text", 200, 100, 300, 200, "right"), mk(2, "plain text", 0, 200, 100, 300, "left two"), mk(3, "plain text", 0, 100, 100, 190, "left one", 0.6), mk(4, "title", 0, 0, 300, 50, "Head"), mk(5, "plain text", 0, 100, 100, 300, "covered"), mk(6, "figure", 0, 0, 9, 9, "no")])
    assert text == "Head\nleft one\nleft two\nright" and round(sure, 4) == 0.75
    assert grouping.article_text([]) == ("", 0.0)


def test_figures_take_one_caption_each(spark):
    b = page(spark, ("figure", 0, 0, 100, 100, 1.0, ""), ("figure", 200, 0, 300, 100, 1.0, ""), ("figure_caption", 0, 110, 300, 130, 1.0, "c"), ("figure_caption", 0, 140, 100, 150, 1.0, "d"))
    assert {(r.figure_id, r.caption_id) for r in grouping.figures_and_captions(b).collect()} == {(1, 3)}


def test_duplicates_and_enclosures(spark):
    b = page(spark, ("plain text", 0, 0, 100, 100, 0.9, "same text"), ("plain text", 0, 0, 100, 99, 0.5, "same text"), ("plain text", 200, 0, 400, 400, 0.9, "big"), ("plain text", 210, 50, 390, 150, 0.9, "p"), ("plain text", 210, 200, 390, 300, 0.9, "q"))
    assert [(r.block_id, r.kept_id) for r in grouping.merge_duplicates(b).collect()] == [(2, 1)]
    assert [(r.block_id, r.n_enclosed, r.title_y2) for r in grouping.enclosures(b).filter("block_id = 3").collect()] == [(3, 2, 50)]


def test_sideboxes(spark):
    rects = spark.createDataFrame([(1, 1, 0, 0, 600, 400), (1, 2, 610, 0, 800, 190), (1, 3, 2000, 0, 2100, 100)], "page_id long, article_id int, x1 int, y1 int, x2 int, y2 int")
    assert grouping.absorb_sideboxes(rects).count() == 0  # a single box needs a parent that has grown
    rows = spark.createDataFrame([(1, 1, 0, 0, 900, 450), (1, 2, 910, 0, 1000, 400), (1, 3, 1010, 0, 1100, 400)], "page_id long, article_id int, x1 int, y1 int, x2 int, y2 int")
    assert {(r.article_id, r.parent_id) for r in grouping.absorb_sideboxes(rows).collect()} == {(2, 1), (3, 1)}


def test_batches(spark):
    rows = spark.createDataFrame([(1, k, s) for k, s in enumerate([5, 5, 5, 30, 1, 1, 1, 1])], "p long, k long, size long")
    assert [r.batch for r in linkage.batches(rows, "p", "k", F.col("size"), 3, 12).orderBy("k").collect()] == [0, 0, 1, 2, 3, 3, 3, 4]


def test_matching_is_one_to_one(spark):
    scored = spark.createDataFrame([(1, 10, 0.5, 0.5, 5, False), (1, 11, 0.3, 0.5, 5, False), (2, 10, 0.6, 0.5, 5, False), (3, 12, 0.5, 0.5, 5, False), (3, 13, 0.48, 0.5, 5, False), (4, 14, 0.5, 0.5, 2, False)], "source_id long, target_id long, score double, text_score double, shared int, titleless boolean")
    assert {(r.source_id, r.target_id) for r in linkage.accepted(scored).collect()} == {(1, 10)}


def test_sources_and_sinks(spark, tmp_path):
    b = page(spark, ("title", 0, 10, 400, 50, 0.9, "One"), ("plain text", 0, 0, 190, 9, 0.8, "a"))
    documents.write_pages(documents.page_json(b, 2800, 4600), str(tmp_path / "pages"))
    (tmp_path / "pages" / "bad.json").write_text("{broken")
    back = documents.read_pages(spark, str(tmp_path / "pages")).orderBy("block_id").collect()
    assert [(r.block_id, r.reading_order, r.cls, r.x2, r.text, r.confidence) for r in back] == [(1, 1, "title", 400, "One", 1.0), (2, 0, "plain text", 190, "a", 1.0)]
    (tmp_path / "docs").mkdir()
    for k in (2, 1):
        (tmp_path / "docs" / f"{k}.json").write_text(json.dumps({"document_id": f"doc_{k:06d}", "status": "done"}))
    (tmp_path / "docs" / "x.json").write_text("{")
    cat = documents.read_catalogue(spark, str(tmp_path / "docs"), spark.createDataFrame([("doc_000001",)], "document_id string"))
    assert [(r.document_id, r.boundaries_ready) for r in cat.collect()] == [("doc_000001", True), ("doc_000002", False)]
    assert archive.next_document_id(cat).first()[0] == "doc_000003" and archive.next_document_id(cat.limit(0)).first()[0] == "doc_000001"
    (tmp_path / "logical.json").write_text(json.dumps({"logical_articles": [{"logical_article_id": "l1", "status": "merged", "source_parts": [{"page": 1, "article_id": "a"}, {"page": 2, "article_id": "b"}]}, {"logical_article_id": "l2"}]}))
    assert documents.read_logical(spark, str(tmp_path / "logical.json")).count() == 3
    for p in ("page_1/article_001/article_001.png", "page_1/article_001/a.png", "page_2/article_002/z.png", "page_x/article_003/q.png"):
        (tmp_path / "crops" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "crops" / p).write_bytes(b"png")
    crops = {(r.page, r.article_id): r.path.rsplit("/", 1)[-1] for r in documents.discover_crops(spark, str(tmp_path / "crops")).collect()}
    assert crops == {(1, "article_001"): "article_001.png", (2, "article_002"): "z.png"}
    assert documents.uploads(spark, str(tmp_path / "crops"), 0).filter("accepted").count() == 0


def test_patch_and_children(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    got = archive.patch(old, spark.createDataFrame([(1, None, 9), (3, "c", 1)], "id int, name string, n int"), ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "a", 9), (2, "b", 6)]
    kids = archive.replace_children(old, spark.createDataFrame([(2, "x", 1), (2, "y", 2)], "id int, name string, n int"), "id")
    assert sorted(map(tuple, kids.collect())) == [(1, "a", 5), (2, "x", 1), (2, "y", 2)]
