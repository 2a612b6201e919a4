"""Assembly operators: what happens to articles after the first grouping, and to their boundaries, images and headings.

Joins have the page as a key; greedy one-to-one passes go through ``grouping.per_page``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.functions import geometry as G
from broadsheet.functions import lexicons as X
from broadsheet.functions import text as T
from broadsheet.operators import grouping as P
from broadsheet.operators.layout import A, B, boundaries, nearest, pairs, story_shape

# Predicates


def uncertain_title() -> Column:
    """P13."""
    return (F.col("cls") == "title") & (F.col("role") == "unknown")


def read_by_ocr() -> Column:
    """P14."""
    return F.col("cls").isin(X.TEXTUAL)


def assign_roles(b: DataFrame, answers: DataFrame) -> DataFrame:
    """Roles from a model's answer (page_id, block_id, role, pos), the last one of a block; unknown blocks are ignored, others stay unknown."""
    last = answers.groupBy("page_id", "block_id").agg(F.max_by("role", "pos").alias("role"))
    return b.join(last, ["page_id", "block_id"], "left").withColumn("role", F.coalesce("role", F.lit("unknown")))


def garbage_ratio(c: Column | str) -> Column:
    """The share of characters that are neither Latin, Devanagari, digits nor plain punctuation."""
    t = T.strip(c)
    bad = F.length(F.regexp_replace(t, r"[A-Za-z0-9\x{0900}-\x{097F} .,'\"\-]", ""))
    return F.when(F.length(t) > 0, bad / F.length(t)).otherwise(F.lit(1.0))


def read_again(text: Column | str, confidence: Column, is_title: Column, devanagari: Column) -> Column:
    """A reading that the Devanagari reader should try again."""
    doubt = (T.strip(text) == "") | (garbage_ratio(text) >= 0.30) | (confidence < F.when(is_title, 0.90).otherwise(0.75))
    return devanagari & doubt


def reading_score(text: Column | str, confidence: Column) -> Column:
    """the better of two readings has the higher score."""
    t = T.strip(text)
    score = confidence + F.when(t.rlike(T.DEVANAGARI), 0.5).otherwise(0.0) - garbage_ratio(text) - F.when(F.length(t) <= 2, 0.3).otherwise(0.0)
    return F.when(t == "", F.lit(-1.0)).otherwise(score)


def confidence_floor(absolute: Column, page_median: Column) -> Column:
    """F36."""
    return F.greatest(F.lit(0.25), F.least(absolute, 0.70 * page_median))


def recovered_class(line_height: Column, title_height: Column, body_height: Column) -> Column:
    """title from the middle between the page's line heights on; without both heights, plain text."""
    return F.when(line_height >= (title_height + body_height) / 2, "title").otherwise("plain text")


# Boundaries


def nested_boundaries(rects: DataFrame) -> DataFrame:
    """is_nested: some other boundary of the page holds this one strictly."""
    held = pairs(rects, rects, (F.col("a.article_id") != F.col("b.article_id")) & (B.x1 < A.x1) & (B.y1 < A.y1) & (B.x2 > A.x2) & (B.y2 > A.y2))
    inner = held.select("page_id", F.col("a.article_id").alias("article_id")).distinct().withColumn("is_nested", F.lit(True))
    return rects.select("page_id", "article_id").join(inner, ["page_id", "article_id"], "left").withColumn("is_nested", F.coalesce("is_nested", F.lit(False)))


def without_chrome(m: DataFrame) -> DataFrame:
    """Members without headers, and without blank blocks above the content that stick out by a quarter of its width; an article keeps one at least."""
    w = W.partitionBy("page_id", "article_id")
    content = F.col("cls").isin(*X.TEXTUAL, *X.IMAGES)
    left, right, top = (f(F.when(content, F.col(c))).over(w) for f, c in ((F.min, "x1"), (F.max, "x2"), (F.min, "y1")))
    over = F.greatest(left - F.col("x1"), F.lit(0)) + F.greatest(F.col("x2") - right, F.lit(0))
    chrome = ~content & (T.strip("text") == "") & (F.col("y2") <= top) & (over > 0.25 * (right - left))
    marked = m.withColumn("chrome", F.coalesce(chrome, F.lit(False)))
    return marked.withColumn("n_left", F.count_if(~F.col("chrome")).over(w)).filter("NOT chrome OR n_left = 0").drop("chrome", "n_left")


def merge_repeated_ids(articles: DataFrame) -> DataFrame:
    """(page_id, article_id, block_id, confidence, pos): one boundary per id: all its blocks, least confidence; a block goes to its first owner."""
    owner = articles.groupBy("page_id", "block_id").agg(F.min_by("article_id", F.struct("pos", "article_id")).alias("article_id"))
    least = articles.groupBy("page_id", "article_id").agg(F.min("confidence").alias("confidence"))
    return owner.join(least, ["page_id", "article_id"])


def mask_rects(m: DataFrame) -> DataFrame:
    """For each article the parts of its crop that other articles' blocks cover, in the crop's own coordinates."""
    rect = boundaries(m).select("page_id", "article_id", "x1", "y1", "x2", "y2")
    hit = pairs(m, rect, (F.col("a.article_id") != F.col("b.article_id")) & (G.inside(A, B) >= 0.75))
    return hit.select(
        "page_id", F.col("b.article_id").alias("article_id"), F.col("a.block_id").alias("block_id"), (F.greatest(A.x1, B.x1) - B.x1).alias("x1"), (F.greatest(A.y1, B.y1) - B.y1).alias("y1"),
        (F.least(A.x2, B.x2) - B.x1).alias("x2"), (F.least(A.y2, B.y2) - B.y1).alias("y2"),
    )


def overlap_flags(m: DataFrame) -> DataFrame:
    """n_foreign: how many foreign blocks lie in each article's box; nothing moves."""
    n = mask_rects(m).groupBy("page_id", "article_id").agg(F.count(F.lit(1)).alias("n_foreign"))
    return m.select("page_id", "article_id").distinct().join(n, ["page_id", "article_id"], "left").withColumn("n_foreign", F.coalesce("n_foreign", F.lit(0)))


def encroaching(groups: DataFrame, owned: DataFrame, least: float = 0.30) -> DataFrame:
    """Groups (page_id, group_id and box) that cover more than `least` of some owned block."""
    hit = pairs(groups, owned, G.inside(B, A) > least)
    return hit.select("page_id", F.col("a.group_id").alias("group_id")).distinct()


def recover_dropped(free: DataFrame, owned: DataFrame, grouped: DataFrame, page_area: int, **limits: int) -> DataFrame:
    """Clusters of blocks that no article has (page_id, block_id, group_id) which look like a story and encroach on nothing: page_id, group_id, block_id.
    A page on which they would cover more than a quarter recovers none."""
    m = free.join(grouped, ["page_id", "block_id"])
    rects = m.groupBy("page_id", "group_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    stories = story_shape(m, page_area, "group_id", **limits).filter("is_story").select("page_id", "group_id", "area")
    clear = stories.join(encroaching(rects.join(stories, ["page_id", "group_id"], "left_semi"), owned), ["page_id", "group_id"], "left_anti")
    modest = clear.withColumn("covered", F.sum("area").over(W.partitionBy("page_id"))).filter(4 * F.col("covered") <= page_area)
    return m.join(modest.select("page_id", "group_id"), ["page_id", "group_id"]).select("page_id", "group_id", "block_id")


def title_roots_to_headlines(m: DataFrame) -> DataFrame:
    """Articles of one short title go to the next headline below in their column: page_id, article_id, target_id."""
    w = W.partitionBy("page_id", "article_id")
    sized = m.withColumn("n", F.count(F.lit(1)).over(w))
    lone = sized.filter((F.col("n") == 1) & (F.col("cls") == "title") & (F.length(T.text_of("text")) <= 90))
    heads = sized.filter("cls = 'title' AND n > 1")
    found = pairs(lone, heads, (B.y1 > A.y1) & (G.col_overlap(A, B) >= 0.35))
    best = nearest(found, B.y1 - A.y1, F.col("b.article_id").alias("target_id"), F.col("a.article_id").alias("article_id"))
    return best.select("page_id", "article_id", "target_id")


# One-to-one attachments


def attach_page(page: list[P.Block], reach: int = 250, least: float = 0.35) -> Iterator[tuple[int, int, str]]:
    """Blocks without an article, in order: captions to the nearest image's article, others to the nearest article in their column, else to the
    only article whose box, widened by 50, holds them. Articles grow as blocks attach."""
    articles: dict[int, list[P.Block]] = {}
    for b in page:
        if b.article_id is not None:
            articles.setdefault(b.article_id, []).append(b)
    for b in (b for b in page if b.article_id is None):
        near = [(P.gap(b, o), i) for i, blocks in articles.items() for o in blocks if P.col_overlap(b, o) >= least and P.gap(b, o) <= reach and (b.cls != "figure_caption" or o.cls in X.IMAGES)]
        how = "caption" if b.cls == "figure_caption" else "column"
        if not near:
            wide = [i for i, blocks in articles.items() for u in [P.union(blocks)] if u.x1 - 50 <= b.x1 and u.x2 + 50 >= b.x2 and u.y1 - 50 <= b.y1 and u.y2 + 50 >= b.y2]
            near, how = ([(0, wide[0])], "footprint") if len(wide) == 1 else ([], "")
        if near:
            _, i = min(near)
            articles[i].append(b)
            yield b.block_id, i, how


def attach(blocks: DataFrame) -> DataFrame:
    """page_id, block_id, article_id, how, of blocks whose article_id is null."""
    return P.per_page(blocks, lambda page: sorted(attach_page(page)), "block_id int, article_id int, how string")


def relink_page(page: list[P.Block], reach: int = 40) -> Iterator[tuple[int, int]]:
    """Articles without a title, down the page, take the nearest heading right above their top block from an article that keeps another."""
    articles: dict[int, list[P.Block]] = {}
    for b in page:
        articles.setdefault(b.article_id, []).append(b)
    for i in sorted(articles, key=lambda i: (articles[i][0].y1, i)):
        if any(b.cls == "title" for b in articles[i]):
            continue
        top = articles[i][0]
        fits = [(top.y1 - t.y2, t.block_id, j) for j, blocks in articles.items() if j != i and sum(b.cls == "title" for b in blocks) > 1 for t in blocks if t.cls == "title" and 0 <= top.y1 - t.y2 <= reach and P.col_overlap(t, top) >= 0.5]
        if fits:
            _, block, donor = min(fits)
            moved = next(b for b in articles[donor] if b.block_id == block)
            articles[donor].remove(moved)
            articles[i].insert(0, moved)
            yield block, i


def relink_headlines(members: DataFrame) -> DataFrame:
    """page_id, block_id, article_id of headings that move."""
    return P.per_page(members, relink_page, "block_id int, article_id int")


def tight_pairs(free: DataFrame, reach: int = 40, least_chars: int = 200) -> DataFrame:
    """page_id, heading_id, text_id: headings and the long text right below, one to one, down the page."""

    def run(page: list[P.Block]) -> Iterator[tuple[int, int]]:
        used: set[int] = set()
        for h in (b for b in page if b.cls in ("title", *X.IMAGES)):
            fits = [(t.y1 - h.y2, t.block_id) for t in page if t.cls == "plain text" and t.block_id not in used and len(t.text or "") >= least_chars and 0 <= t.y1 - h.y2 <= reach and P.col_overlap(h, t) >= 0.5]
            if fits:
                used.add(min(fits)[1])
                yield h.block_id, min(fits)[1]

    return P.per_page(free, run, "heading_id int, text_id int")


def split_page(page: list[P.Block]) -> Iterator[tuple[int, int, int]]:
    """Articles with more than one dominant title are grouped anew; the split holds only if it keeps every block and gives two parts or more."""
    articles: dict[int, list[P.Block]] = {}
    for b in page:
        articles.setdefault(b.article_id, []).append(b)
    for i in sorted(articles):
        blocks = articles[i]
        titles = [b for b in blocks if b.cls == "title"]
        tallest = max((t.y2 - t.y1 for t in titles), default=0)
        parts = [blocks]
        if sum(t.y2 - t.y1 >= 0.65 * tallest for t in titles) > 1 and len(P.components(titles, P.one_line)) > 1:
            groups = P.group_page(sorted(blocks, key=lambda b: (b.y1, b.x1, b.block_id)))
            held = {b.block_id for g in groups for b in g}
            for b in (b for b in blocks if b.block_id not in held):
                if groups:
                    min(groups, key=lambda g: min(P.distance(b, o) for o in g)).append(b)
            for g in [g for g in groups if not any(b.cls == "title" for b in g)]:
                others = [h for h in groups if h is not g]
                if others:
                    min(others, key=lambda h: min(P.distance(a, b) for a in g for b in h)).extend(g)
                    groups.remove(g)
            if len(groups) > 1 and {b.block_id for g in groups for b in g} == {b.block_id for b in blocks}:
                parts = groups
        for k, g in enumerate(parts):
            yield from ((i, k, b.block_id) for b in sorted(g, key=lambda b: b.block_id))


def split_oversized(members: DataFrame) -> DataFrame:
    """page_id, article_id, part, block_id."""
    return P.per_page(members, split_page, "article_id int, part int, block_id int")


def cluster_regions(regions: DataFrame) -> DataFrame:
    """page_id, block_id, article_id: regions without an article attach under article columns (overlap above 0.45, gap -20 to 40), again and
    again; leftovers cluster (0.35, -25 to 60), and clusters of two and more become articles numbered on."""

    def run(page: list[P.Block]) -> Iterator[tuple[int, int]]:
        articles: dict[int, list[P.Block]] = {}
        for b in page:
            if b.article_id is not None:
                articles.setdefault(b.article_id, []).append(b)
        free = [b for b in page if b.article_id is None]
        moved = True
        while moved:
            moved = False
            for b in list(free):
                fits = [i for i, blocks in sorted(articles.items()) if any(P.col_overlap(b, o) > 0.45 and -20 <= b.y1 - o.y2 <= 40 for o in blocks)]
                if fits:
                    articles[fits[0]].append(b)
                    free.remove(b)
                    yield b.block_id, fits[0]
                    moved = True
        number = max(articles, default=0)
        for g in P.components(free, lambda a, b: P.col_overlap(a, b) > 0.35 and (-25 <= b.y1 - a.y2 <= 60 or -25 <= a.y1 - b.y2 <= 60)):
            if len(g) >= 2:
                number += 1
                yield from ((b.block_id, number) for b in g)

    return P.per_page(regions, lambda page: sorted(run(page)), "block_id int, article_id int")


# Images and headings


def image_records(figures: DataFrame, crops: DataFrame) -> DataFrame:
    """page_id, article_id, image_id, box on a 0..1000 scale of the crop, caption or a default, confidence 0.6."""
    j = figures.join(crops.select("page_id", "article_id", *(F.col(c).alias(f"c{c}") for c in ("x1", "y1", "x2", "y2"))), ["page_id", "article_id"])
    on = lambda v, a, z: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1000.0), (F.col(v) - F.col(a)) * 1000.0 / G.at_least_one(F.col(z) - F.col(a)))), 2)
    n = F.row_number().over(W.partitionBy("page_id", "article_id").orderBy("y1", "block_id"))
    return j.select("page_id", "article_id", F.format_string("image_%03d", n).alias("image_id"), on("x1", "cx1", "cx2").alias("x1"), on("y1", "cy1", "cy2").alias("y1"), on("x2", "cx1", "cx2").alias("x2"), on("y2", "cy1", "cy2").alias("y2"), F.coalesce(F.nullif(T.strip("caption"), F.lit("")), F.lit("Image")).alias("description"), F.lit(0.6).alias("confidence"))


def images_to_segments(images: DataFrame, segments: DataFrame) -> DataFrame:
    """image_id, segment_id: the segment of the image's own article, else the last one of its page."""
    own = segments.groupBy("source_article_id").agg(F.min("segment_id").alias("own_id"))
    page = segments.groupBy("page_number").agg(F.max("segment_id").alias("page_segment"))
    return images.join(own, "source_article_id", "left").join(page, "page_number", "left").select("image_id", F.coalesce("own_id", "page_segment").alias("segment_id"))


def logical_of_part(parts: DataFrame, page: int, article_id: str) -> DataFrame:
    """The logical article that holds a part, and whether it has others."""
    hit = parts.filter((F.col("page") == page) & (F.col("article_id") == article_id)).select("logical_article_id").distinct()
    return parts.join(hit, "logical_article_id", "left_semi").groupBy("logical_article_id").agg((F.count(F.lit(1)) > 1).alias("multi_page"))


def sections_to_articles(sections: DataFrame, articles: DataFrame, least: float = 0.20) -> DataFrame:
    """document_id, section_id, article_id: the article within a page whose words a section shares most of (over the smaller set)."""
    s = sections.select("document_id", "section_id", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page"), F.array_distinct(T.match_tokens("text")).alias("s_words"))
    a = articles.select("document_id", "article_id", "page", F.array_distinct(T.match_tokens("text")).alias("a_words"))
    found = s.join(a, ["document_id", "page"]).select("document_id", "section_id", "article_id", T.min_share(F.col("s_words"), F.col("a_words")).alias("score"))
    best = found.filter(F.col("score") >= least).groupBy("document_id", "section_id").agg(F.max_by("article_id", F.struct("score", -F.col("article_id"))).alias("article_id"), F.max("score").alias("score"))
    return best


def headings_to_blocks(headings: DataFrame, b: DataFrame) -> DataFrame:
    """page_id, heading_id, block_id: the title block that says a heading (either way round, or half its words), nearest in length."""
    t = b.filter("cls = 'title'").select("page_id", "block_id", T.match_text("text").alias("said"))
    h = headings.select("page_id", "heading_id", T.match_text("heading").alias("head")).filter("head <> ''")
    words = lambda c: F.array_distinct(F.split(c, " "))
    match = (F.col("said") != "") & (F.col("said").contains(F.col("head")) | F.col("head").contains(F.col("said")) | (T.min_share(words("said"), words("head")) >= 0.5))
    found = h.join(t, "page_id").filter(match)
    return found.groupBy("page_id", "heading_id").agg(F.min_by("block_id", F.struct(F.abs(F.length("said") - F.length("head")), "block_id")).alias("block_id"))


def headline(lines: DataFrame) -> DataFrame:
    """page_id, article_id, headline, subheadline from lines (y1, y2, block_class, text): title lines of 0.8 of the tallest make the headline, the
    others the subheadline; without title lines, the line of best heading score among the first six."""
    w = W.partitionBy("page_id", "article_id")
    h = F.greatest(F.col("y2") - F.col("y1"), F.lit(0))
    n = lines.withColumn("h", h).withColumn("title", F.col("block_class") == "title").withColumn("k", F.row_number().over(w.orderBy("y1", "block_id"))).withColumn("tallest", F.max(F.when(F.col("block_class") == "title", h)).over(w))
    n = n.withColumn("score", F.when(F.col("k") <= 6, T.heading_score("text")))
    main = F.col("title") & (F.col("h") >= 0.8 * F.col("tallest"))
    said = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("y1", "block_id", T.strip("text").alias("t"))))), lambda x: x["t"]), " ")
    g = n.groupBy("page_id", "article_id").agg(said(main).alias("main"), said(F.col("title") & ~main).alias("rest"), F.max(F.struct("score", (-F.col("k")).alias("k"), T.strip("text").alias("t"))).alias("best"), F.min_by("text", "k").alias("first"))
    return g.select("page_id", "article_id", F.when(F.col("main") != "", F.col("main")).when(F.col("best.score") >= 0.3, F.col("best.t")).otherwise(F.left(T.strip("first"), F.lit(120))).alias("headline"), F.nullif("rest", F.lit("")).alias("subheadline"))


def edit_boundaries(rects: DataFrame, edits: DataFrame) -> DataFrame:
    """Boundaries after edits (page_id, article_id, op, box): save replaces or adds, delete removes; the last edit (pos) of an id stands."""
    last = edits.groupBy("page_id", "article_id").agg(F.max_by(F.struct("op", "x1", "y1", "x2", "y2"), "pos").alias("e"))
    kept = rects.select("page_id", "article_id", "x1", "y1", "x2", "y2").join(last.select("page_id", "article_id"), ["page_id", "article_id"], "left_anti")
    return kept.unionByName(last.filter("e.op = 'save'").select("page_id", "article_id", "e.x1", "e.y1", "e.x2", "e.y2"))


def merge_boundaries(rects: DataFrame, merges: DataFrame) -> DataFrame:
    """Articles of one merge (page_id, article_id, into_id) become one box under into_id."""
    named = rects.join(merges, ["page_id", "article_id"], "left").withColumn("article_id", F.coalesce("into_id", "article_id"))
    return named.groupBy("page_id", "article_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
