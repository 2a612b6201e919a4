"""Layout operators on blocks (page_id, block_id, cls, x1, y1, x2, y2, confidence, ocr_confidence, text): filters, roles, spatial joins, boundaries.

Every join has the page as an equality key, so that pages spread over the cluster and no operator compares blocks of different pages.
Ties always go to the smaller block_id. Blocks with null coordinates overlap nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.functions import geometry as G
from broadsheet.functions import lexicons as X
from broadsheet.functions import text as T
from broadsheet.operators.graph import connected_components

IMAGES, TEXTUAL = X.IMAGES, X.TEXTUAL


# Filters and predicates


def noise(b: DataFrame) -> Column:
    """Abandoned blocks, doubtful scraps and printers' marks."""
    t = T.strip(b["text"])
    scrap = (F.length(t) <= 2) & ~b["cls"].isin("object", "image", "photo", "figure", "title") & (b["confidence"] < 0.5)
    return (b["cls"] == "abandon") | scrap | t.isin(X.PRINTERS_MARKS)


def oversize(page_width: int, page_height: int) -> Column:
    """Text blocks too tall, or too wide for their height, to be a text."""
    b = G.box()
    tall = F.col("cls").isin(TEXTUAL) & (b.height > 0.6 * page_height)
    wide = F.col("cls").isin("plain text", "figure_caption") & (b.width > 0.55 * page_width) & (b.width / G.at_least_one(b.height) < 8)
    return tall | wide


def lane(page_width: int, right_to_left: bool = False) -> Column:
    """Which of six columns the centre lies in."""
    n = F.least(F.floor(G.box().center_x / (page_width / 6)), F.lit(5)).cast("int")
    return 5 - n if right_to_left else n


def masthead(page_width: int, page_height: int) -> Column:
    """A newspaper's name at the top, or a band across most of it."""
    b, t = G.box(), T.strip("text")
    named = (b.y2 <= 0.12 * page_height) & (T.contains_any(F.upper(t), X.MASTHEADS) | T.contains_any(t, X.MASTHEADS_OTHER))
    return named | ((b.y1 < 0.15 * page_height) & (b.width >= 0.75 * page_width))


def page_header(page_height: int, first_page: bool, page_width: Column | None = None) -> Column:
    """A strip across the first page's top, or a line of dates, prices and volumes."""
    b, t = G.box(), T.strip("text")
    width = G.at_least_one(page_width if page_width is not None else F.max("x2").over(W.partitionBy("page_id")))
    low = G.at_least_one(b.height) <= 0.05 * page_height
    strip = F.lit(first_page) & (b.y1 < 0.16 * page_height) & (G.at_least_one(b.width) >= 0.5 * width) & low
    up = F.upper(t)
    key = T.contains_any(up, X.HEADER_WORDS) | T.contains_any(t, X.HEADER_WORDS_OTHER)
    form = T.matches_any(up, X.HEADER_PATTERNS + [X.HEADER_DAY]) | T.matches_any(t, X.HEADER_PATTERNS_OTHER + [X.HEADER_DAY_OTHER])
    line = (t != "") & (b.y2 <= 0.15 * page_height) & low & (G.at_least_one(b.width) / width <= 0.75) & (F.length(t) <= 100) & ~T.contains_any(up, X.ARTICLE_SIGNS) & key & form
    return strip | line


def section_header() -> Column:
    """P07."""
    t = T.strip("text")
    return F.upper(t).rlike(X.SECTION_HEADER[0]) | t.rlike(X.SECTION_HEADER[1])


def caption_line() -> Column:
    """P08."""
    t = T.strip("text")
    return T.matches_any(F.upper(t), X.CAPTION_LINES) | T.matches_any(t, X.CAPTION_LINES_DEVANAGARI)


def clean(b: DataFrame, page_width: int, page_height: int, first_page: bool = True, right_to_left: bool = False) -> DataFrame:
    """Noise and oversize go; then type, is_global and column_no: masthead, header, section, caption, in this order."""
    kept = b.filter(~noise(b) & ~oversize(page_width, page_height))
    head = masthead(page_width, page_height) & F.lit(first_page)
    typed = kept.withColumn("type", F.when(head, "masthead").when(page_header(page_height, first_page), "page_header"))
    glob = F.col("type").isNotNull()
    local = F.when(caption_line(), "caption").when(section_header(), "section_header")
    out = typed.withColumn("is_global", glob).withColumn("column_no", F.when(glob, -1).otherwise(lane(page_width, right_to_left)))
    return out.withColumn("type", F.coalesce("type", local))


def role() -> Column:
    """P10: what a block is to an article."""
    c = F.col("cls")
    return (
        F.when(c == "abandon", "decoration").when(c.isin(IMAGES), "article_image").when(c == "figure_caption", "caption").when(c == "title", "article_title").when(c == "plain text", "article_text").otherwise("unknown")
    )


#: P12, roles that leave an article.
IGNORED_ROLES = ["masthead", "page_header", "page_number", "section_header", "advertisement", "decoration", "weather", "index", "footer", "separator", "ignore"]


def drop_ignored(members: DataFrame) -> DataFrame:
    """Members (page_id, article_id, role) without ignored roles; weather stays where the article has a title and a text."""
    w = W.partitionBy("page_id", "article_id")
    whole = F.max((F.col("role") == "article_title").cast("int")).over(w) + F.max((F.col("role") == "article_text").cast("int")).over(w) == 2
    keep = F.col("role").isNull() | ~F.col("role").isin(IGNORED_ROLES) | ((F.col("role") == "weather") & whole)
    return members.withColumn("keep", keep).filter("keep").drop("keep")


# Joins within a page


def pairs(left: DataFrame, right: DataFrame, on: Column | None = None) -> DataFrame:
    """All pairs of blocks of a page, as structs a and b."""
    a = left.select("page_id", F.struct(*left.columns).alias("a"))
    b = right.select(F.col("page_id").alias("b_page"), F.struct(*right.columns).alias("b"))
    test = F.col("page_id") == F.col("b_page")
    return a.join(b, test if on is None else test & on).drop("b_page")


A, B = G.box("a."), G.box("b.")


def nearest(found: DataFrame, score: Column, *more: Column) -> DataFrame:
    """For each a the b of least score, then least block_id."""
    best = found.groupBy("page_id", F.col("a.block_id").alias("block_id")).agg(F.min(F.struct(score.alias("score"), F.col("b.block_id").alias("other_id"), *more)).alias("best"))
    return best.select("page_id", "block_id", "best.*")


def gaps_above(b: DataFrame) -> DataFrame:
    """Gap to the nearest block above in the same column (width IoU of 0.35 or more)."""
    above = pairs(b.select("page_id", "block_id", "x1", "y1", "x2", "y2"), b.select("page_id", "block_id", "x1", "y1", "x2", "y2"), (F.col("a.block_id") != F.col("b.block_id")) & (B.y2 <= A.y1) & (G.col_iou(A, B) >= 0.35))
    return nearest(above, A.y1 - B.y2).withColumnsRenamed({"score": "gap", "other_id": "above_id"})


def median_gaps(b: DataFrame) -> DataFrame:
    """Median of the positive gaps of each page, and the threshold of a new root."""
    m = gaps_above(b).filter("gap > 0").groupBy("page_id").agg(F.median("gap").alias("median_gap"))
    return m.withColumn("threshold", F.greatest(F.lit(25.0), 2 * F.col("median_gap")))


def lines_to_blocks(lines: DataFrame, b: DataFrame) -> DataFrame:
    """Each line's best block: centre inside counts 1 and the share of the line inside; else a share of 0.2 or more."""
    share = G.inside(A, B)
    centred = A.center_x.between(B.x1, B.x2) & A.center_y.between(B.y1, B.y2)
    found = pairs(lines, b, centred | (share >= 0.2))
    return nearest(found, -(F.when(centred, 1 + share).otherwise(share))).select("page_id", F.col("block_id").alias("line_id"), F.col("other_id").alias("block_id"), (-F.col("score")).alias("score"))


def owning_root(b: DataFrame, roots: DataFrame) -> DataFrame:
    """The latest root at or above a block that contains 0.35 of its width."""
    found = pairs(b, roots, (B.y1 <= A.y1) & (G.containment(A, B) >= 0.35) & (F.col("a.block_id") != F.col("b.block_id")))
    return nearest(found, -B.y1).select("page_id", "block_id", F.col("other_id").alias("root_id"))


def next_root_below(b: DataFrame, roots: DataFrame) -> DataFrame:
    """The nearest root below in the same column."""
    found = pairs(b, roots, (B.y1 > A.y1) & (G.col_iou(A, B) >= 0.35))
    return nearest(found, B.y1 - A.y1).select("page_id", "block_id", F.col("other_id").alias("root_id"))


def with_body_below(titles: DataFrame, texts: DataFrame) -> DataFrame:
    """Titles that some text begins below, with 0.35 of its width under them."""
    found = pairs(titles, texts, (B.y1 >= A.y2 + 2) & (G.containment(B, A) >= 0.35))
    return titles.join(found.select("page_id", F.col("a.block_id").alias("block_id")), ["page_id", "block_id"], "left_semi")


def no_title_between(found: DataFrame, titles: DataFrame) -> DataFrame:
    """Pairs (page_id, a, b) without a third title whose middle lies between them in the width they share."""
    c = titles.select(F.col("page_id").alias("c_page"), F.struct(*titles.columns).alias("c"))
    C = G.box("c.")
    top, bottom = F.least(A.y2, B.y2), F.greatest(A.y1, B.y1)
    left, right = F.greatest(A.x1, B.x1), F.least(A.x2, B.x2)
    between = C.center_y.between(top, bottom) & (C.x1 < right) & (C.x2 > left) & ~F.col("c.block_id").isin(F.col("a.block_id"), F.col("b.block_id"))
    return found.join(c, (F.col("page_id") == F.col("c_page")) & between, "left_anti")


def members(article_blocks: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks of articles, each block to the first article that claims it; unknown blocks drop out."""
    first = article_blocks.groupBy("page_id", "block_id").agg(F.min("article_id").alias("article_id"))
    return first.join(b, ["page_id", "block_id"])


def contested(article_blocks: DataFrame, b: DataFrame) -> DataFrame:
    """Each contested block's article: the nearest uncontested mate's; the first claimant keeps it within 50."""
    claims = article_blocks.groupBy("page_id", "block_id").agg(F.count(F.lit(1)).alias("claims"), F.min("article_id").alias("first_id"))
    boxed = article_blocks.join(claims, ["page_id", "block_id"]).join(b.select("page_id", "block_id", "x1", "y1", "x2", "y2"), ["page_id", "block_id"])
    open_, sure = boxed.filter("claims > 1"), boxed.filter("claims = 1")
    found = pairs(open_, sure, F.col("a.article_id") == F.col("b.article_id"))
    by_article = found.groupBy("page_id", F.col("a.block_id").alias("block_id"), F.col("a.article_id").alias("article_id"), F.col("a.first_id").alias("first_id")).agg(F.min(G.layout_distance(A, B)).alias("d"))
    best = by_article.groupBy("page_id", "block_id", "first_id").agg(F.min(F.struct("d", "article_id")).alias("best"), F.min(F.when(F.col("article_id") == F.col("first_id"), F.col("d"))).alias("own"))
    stays = F.col("own") <= F.col("best.d") + 50
    return best.select("page_id", "block_id", F.when(stays, F.col("first_id")).otherwise(F.col("best.article_id")).alias("article_id"))


def boundaries(m: DataFrame) -> DataFrame:
    """Box, size and blocks of every article."""
    out = m.groupBy("page_id", "article_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n_blocks"), F.min("confidence").alias("confidence"))
    return out.withColumn("width", F.col("x2") - F.col("x1")).withColumn("height", F.col("y2") - F.col("y1")).withColumn("area", F.col("width").cast("long") * F.col("height"))


def foreign_overlap(m: DataFrame, least: float = 0.75, own: float = 0.30) -> DataFrame:
    """Blocks of other articles that lie inside an article's box and hardly overlap its own blocks."""
    rect = boundaries(m).select("page_id", "article_id", "x1", "y1", "x2", "y2")
    content = m.filter(F.col("cls").isin(*TEXTUAL, *IMAGES))
    hit = pairs(content, rect, (F.col("a.article_id") != F.col("b.article_id")) & (G.inside(A, B) >= least))
    named = hit.select("page_id", F.col("b.article_id").alias("article_id"), F.col("a.block_id").alias("foreign_id"), F.col("a.article_id").alias("owner_id"), *(F.col(f"a.{c}") for c in ("x1", "y1", "x2", "y2")))
    mates = m.select(F.col("page_id").alias("m_page"), F.col("article_id").alias("m_article"), F.struct("x1", "y1", "x2", "y2").alias("m"))
    covered = named.join(mates, (F.col("page_id") == F.col("m_page")) & (F.col("article_id") == F.col("m_article")))
    most = covered.groupBy("page_id", "article_id", "foreign_id", "owner_id").agg(F.max(G.inside(G.box(), G.box("m."))).alias("own_share"))
    return most.filter(F.col("own_share") <= own)


def density(b: DataFrame, reach: int = 900) -> DataFrame:
    """Blocks of the same column within reach above and below."""
    near = (F.col("a.block_id") != F.col("b.block_id")) & (G.col_overlap(A, B) >= 0.35) & (B.y2 >= A.y1 - reach) & (B.y1 <= A.y2 + reach)
    return pairs(b, b, near).groupBy("page_id", F.col("a.block_id").alias("block_id")).agg(F.count(F.lit(1)).alias("n_near"))


def clusters(b: DataFrame, page_width: int) -> DataFrame:
    """Single-link clusters of blocks whose edges are near."""
    limit = max(60, 0.025 * page_width)
    return groups(b, pairs(b, b, (F.col("a.block_id") < F.col("b.block_id")) & (G.edge_distance(A, B) <= limit)))


def groups(b: DataFrame, found: DataFrame) -> DataFrame:
    """Components of pairs: page_id, block_id, group_id (least block_id of the component); blocks without a pair are groups of their own."""
    key = lambda page, block: page.cast("long") * 1_000_000 + block
    edges = found.select(key(F.col("page_id"), F.col("a.block_id")).alias("a"), key(F.col("page_id"), F.col("b.block_id")).alias("b"))
    comp = connected_components(edges)
    return b.withColumn("node", key(F.col("page_id"), F.col("block_id"))).join(comp, "node", "left").select("page_id", "block_id", F.coalesce(F.pmod("component", F.lit(1_000_000)).cast("int"), F.col("block_id")).alias("group_id"))


def banner_groups(b: DataFrame) -> DataFrame:
    """Titles that are fragments of one banner line."""
    t = b.filter("cls = 'title'")
    return groups(t, pairs(t, t, (F.col("a.block_id") < F.col("b.block_id")) & G.single_line_pair(A, B)))


def row_groups(rects: DataFrame) -> DataFrame:
    """Boxes side by side: tops and bottoms within 20, hardly any shared width."""
    side = (F.abs(A.y1 - B.y1) <= 20) & (F.abs(A.y2 - B.y2) <= 20) & (G.col_overlap(A, B) <= 0.2) & (F.col("a.block_id") < F.col("b.block_id"))
    g = groups(rects, pairs(rects, rects, side))
    return g.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("page_id", "group_id"))).filter("n >= 2").drop("n")


# Aggregates and windows


def reading_order(b: DataFrame, right_to_left: bool = False) -> DataFrame:
    """0, 1, ... down the page."""
    x = F.desc("x1") if right_to_left else F.asc("x1")
    return b.withColumn("reading_order", F.row_number().over(W.partitionBy("page_id").orderBy("y1", x, "block_id")) - 1)


def fill_ratio(m: DataFrame) -> DataFrame:
    """How much of an article's box its blocks fill."""
    area = F.sum(G.box().area.cast("long"))
    box = (F.max("x2") - F.min("x1")).cast("long") * (F.max("y2") - F.min("y1"))
    return m.groupBy("page_id", "article_id").agg((area / G.at_least_one(box)).alias("fill"))


def story_shape(m: DataFrame, page_area: int, group: str = "article_id", least_chars: int = 600, least_mean: int = 150) -> DataFrame:
    """What makes a group of blocks look like a story: few headlines, three paragraphs of some length, not too many blocks, a hundredth of the page."""
    n = F.length(T.text_of("text"))
    body = F.col("cls") == "plain text"
    area = (F.max("x2") - F.min("x1")).cast("long") * (F.max("y2") - F.min("y1"))
    g = m.groupBy("page_id", group).agg(
        F.count_if(F.col("cls") == "title").alias("n_titles"), F.count_if(body).alias("n_paragraphs"), F.sum(F.when(body, n).otherwise(0)).alias("n_chars"), F.count(F.lit(1)).alias("n_blocks"),
        F.bool_or(F.col("cls").isin(IMAGES)).alias("has_image"), area.alias("area"),
    )
    long = (F.col("n_chars") >= least_chars) & (F.col("n_chars") >= least_mean * F.col("n_paragraphs"))
    return g.withColumn("is_story", (F.col("n_titles") <= 4) & (F.col("n_paragraphs") >= 3) & long & (F.col("n_blocks") <= 24) & (100 * F.col("area") >= page_area))


def role_breakdown(m: DataFrame) -> DataFrame:
    """Ids of headlines, body and images, in order."""
    ids = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("block_id"))))
    c = F.col("cls")
    return m.groupBy("page_id", "article_id").agg(ids(c == "title").alias("headline_ids"), ids(c == "plain text").alias("body_ids"), ids(c.isin(IMAGES)).alias("image_ids"))


def tall_titles(m: DataFrame, share: float = 0.65) -> DataFrame:
    """Titles at least that share of their article's tallest."""
    t = m.filter("cls = 'title'").withColumn("line_height", F.col("y2") - F.col("y1"))
    most = F.max("line_height").over(W.partitionBy("page_id", "article_id"))
    return t.withColumn("dominant", F.col("line_height") >= share * most)


def wide_tops(m: DataFrame, page_width: int) -> DataFrame:
    """The top block of an article that is a banner of its own: very wide over narrow blocks, or over a box hardly filled."""
    w = W.partitionBy("page_id", "article_id")
    ranked = m.withColumn("k", F.row_number().over(w.orderBy("y1", "x1", "block_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    rest = F.col("k") > 1
    part = lambda f, c: f(F.when(rest, c)).over(w)
    widest = part(F.max, F.col("x2") - F.col("x1"))
    box = (part(F.max, F.col("x2")) - part(F.min, F.col("x1"))).cast("long") * (part(F.max, F.col("y2")) - part(F.min, F.col("y1")))
    fill = part(F.sum, G.box().area.cast("long")) / G.at_least_one(box)
    top = (F.col("k") == 1) & (F.col("n") > 1) & (F.col("x2") - F.col("x1") > 0.65 * page_width)
    return ranked.withColumn("detach", top & ((widest < 0.35 * page_width) | (fill < 0.30))).drop("k", "n")


def governing_title(m: DataFrame) -> DataFrame:
    """Each block's nearest title above in its article (min-width overlap of 0.35)."""
    t = m.filter("cls = 'title'")
    found = pairs(m, t, (F.col("a.article_id") == F.col("b.article_id")) & (F.col("a.block_id") != F.col("b.block_id")) & (B.y1 <= A.y1) & (G.col_overlap(A, B) >= 0.35))
    return nearest(found, F.greatest(A.y1 - B.y2, F.lit(0))).select("page_id", "block_id", F.col("other_id").alias("title_id"), F.col("score").alias("gap"))


def distant_orphans(m: DataFrame, most: int = 300) -> DataFrame:
    """Going down an article, the first gap beyond `most` cuts off what follows, titles excepted."""
    w = W.partitionBy("page_id", "article_id").orderBy("y1", "x1", "block_id")
    broken = (F.col("y1") - F.lag("y2").over(w) > most).cast("int")
    return m.withColumn("orphan", (F.coalesce(F.max(broken).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) == 1) & (F.col("cls") != "title"))


def page_extent(b: DataFrame) -> DataFrame:
    """A page's width and height as far as its blocks show."""
    return b.groupBy("page_id").agg(F.max("x2").alias("page_width"), F.max("y2").alias("page_height"))


def root_titles(b: DataFrame) -> DataFrame:
    """K07, its first rule: titles with a body below, or with no block above, or far below the last one."""
    titles = b.filter("cls = 'title'")
    bodied = with_body_below(titles, b.filter("cls = 'plain text'")).select("page_id", "block_id", F.lit(True).alias("has_body"))
    out = titles.join(bodied, ["page_id", "block_id"], "left").join(gaps_above(b).select("page_id", "block_id", "gap"), ["page_id", "block_id"], "left").join(median_gaps(b).select("page_id", "threshold"), "page_id", "left")
    rule = F.coalesce("has_body", F.lit(False)) | F.col("gap").isNull() | (F.col("gap") >= F.coalesce("threshold", F.lit(25.0)))
    return out.select("page_id", "block_id", rule.alias("is_root"))
