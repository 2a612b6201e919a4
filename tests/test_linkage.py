"""Continuation scores and matching against plain Python."""

import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from broadsheet.functions import lexicons as X
from broadsheet.operators import linkage
from broadsheet.plans import catalogue
from tests.conftest import SF

PLAIN = "council approves the new harbour bridge budget after long debate while engineers warned about rising steel prices and traffic delays near docks"
REST = "engineers warned about rising steel prices and traffic delays near docks before mayor promised fresh hearings with residents next month"
OTHER = "cricket captain praised bowlers whose spell turned evening match around under floodlights at packed stadium"
FIELDS = "document_id long, article_id long, page int, next_page int, text string, headline string, content_type string, jump_slug string, about array<string>"
ROWS = [
    (1, 1, 1, 9, PLAIN, "Bridge budget approved", "article", None, ["harbour", "bridge"]),
    (1, 2, 1, 9, OTHER, "Captain happy", "photo_caption", None, ["cricket"]),
    (1, 3, 2, 9, PLAIN[:80], "Bridge", "article", "Steel price warning", None),
    (1, 4, 2, 9, "", None, "article", "", []),
    (1, 5, 3, 9, None, "Nothing said", "reference", None, ["bridge"]),
    (1, 11, 9, None, REST, "Steel price warning for city", "article", None, ["bridge", "mayor"]),
    (1, 12, 9, None, OTHER + " " + REST[:60], "", "article", None, ["cricket", "stadium"]),
    (1, 13, 9, None, "", "Blank", "article", None, []),
    (2, 14, 9, None, REST, "Another paper", "article", None, ["bridge"]),
]


def norm(t):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", (t or "").lower())).strip()


def tokens(t):
    return [w for w in norm(t).split() if len(w) >= 3 and w not in X.STOP_WORDS]


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def expected(s, t):
    """Scores of a pair, by the definition."""
    tail, start = (s.text or "")[-1800:], (t.text or "")[:1800]
    a, b = tokens(tail), tokens(start)
    x, y, text = set(a), set(b), 0.0
    if x and y:
        g, h = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (a, b))
        grams = len(g & h) / min(len(g), len(h)) if g and h else 0.0
        text = 0.38 * len(x & y) / len(x | y) + 0.27 * grams + 0.20 * ratio(norm(tail)[-900:], norm(start)[:900]) + 0.15 * len(x & y) / min(len(x), len(y))
    m, n = set(s.about or []), set(t.about or [])
    meta = len(m & n) / len(m | n) if m and n else 0.0
    mine, theirs = norm(s.headline), norm(t.headline)
    heads = ratio(mine, theirs) if s.content_type == "article" and mine and theirs else 0.0
    whole = 0.68 * text + 0.32 * meta if s.content_type != "article" else 0.72 * text + 0.28 * meta if not theirs else 0.58 * text + 0.22 * meta + 0.20 * heads
    slug = tokens(s.jump_slug)
    strong = len(slug) >= 2 and set(slug) <= set(tokens(t.headline))
    if strong:
        whole = max(whole, 0.80 * ratio(norm(s.jump_slug), theirs) + 0.20 * text)
    return whole, text, meta, len(x & y), strong


def parts(spark):
    a = spark.createDataFrame(ROWS, FIELDS)
    return a.filter("next_page is not null"), a.filter("next_page is null")


def test_scores_equal_the_definition(spark):
    sources, targets = parts(spark)
    rows = {r.article_id: r for r in sources.collect() + targets.collect()}
    got = linkage.score(linkage.candidates(sources, targets), every=True).collect()
    assert {(r.source_id, r.target_id) for r in got} == {(s, t) for s in range(1, 6) for t in (11, 12, 13)}
    for r in got:
        whole, text, meta, shared, strong = expected(rows[r.source_id], rows[r.target_id])
        assert abs(r.score - whole) < 6e-5 and abs(r.text_score - text) < 6e-5 and abs(r.meta_score - meta) < 6e-5, r
        assert (r.shared, r.strong_slug) == (shared, strong), r


def test_leaving_out_hopeless_sources_changes_no_link(spark):
    found = linkage.candidates(*parts(spark))
    links = lambda every: {(r.document, r.source_id, r.target_id, r.score) for r in linkage.accepted(linkage.score(found, every)).collect()}
    assert links(False) == links(True)
    assert {x[1:3] for x in links(False)} == {(1, 11), (2, 12)}


def test_special_sources_and_slugs_have_limits_of_their_own(spark):
    fields = "document_id long, source_id long, target_id long, score double, text_score double, meta_score double, shared int, titleless boolean, special boolean, strong_slug boolean, source_page long"
    rows = [
        (1, 1, 10, 0.23, 0.13, 0.08, 2, False, True, False, 1),  # a caption: lower limits
        (1, 2, 11, 0.23, 0.13, 0.07, 2, False, True, False, 1),  # too little metadata
        (1, 3, 12, 0.30, 0.42, 0.0, 2, False, True, False, 1),  # but the text is certain
        (1, 4, 13, 0.10, 0.05, 0.0, 3, False, False, True, 1),  # a slug
        (1, 5, 14, 0.10, 0.05, 0.0, 2, False, False, True, 1),  # a slug alone
        (1, 6, 15, 0.24, 0.30, 0.0, 3, False, False, False, 1),
        (1, 7, 16, 0.24, 0.30, 0.0, 3, True, False, False, 1),  # a target without a title
        (1, 8, 17, 0.50, 0.50, 0.0, 5, False, False, False, 3),
        (1, 9, 17, 0.40, 0.50, 0.0, 5, False, False, False, 2),  # the earlier page takes the target
        (2, 8, 17, 0.50, 0.50, 0.0, 5, False, False, False, 3),
    ]
    got = linkage.accepted(spark.createDataFrame(rows, fields)).collect()
    assert {(r.document, r.source_id, r.target_id) for r in got} == {(1, 1, 10), (1, 3, 12), (1, 4, 13), (1, 7, 16), (1, 9, 17), (2, 8, 17)}


def test_pages_go_by_the_documents_own_map(spark):
    sources, targets = parts(spark)
    pages = spark.createDataFrame([(1, 4, 9), (2, 9, 4)], "document_id long, folio int, page int")
    moved = sources.withColumn("next_page", F.lit(4))
    assert linkage.candidates(moved, targets, pages).count() == 15 and linkage.candidates(moved, targets).count() == 0
    assert linkage.candidates(sources.limit(0), targets).count() == 0


def test_broken_stories_are_found_again(spark):
    got = catalogue.QUERIES["k15_continuations"](spark, SF).collect()
    assert len(got) > 20 and sum(r.target_id == r.source_id + 1 for r in got) >= 0.9 * len(got)
