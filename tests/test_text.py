import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import text as T
from broadsheet.operators import search as S
from broadsheet.operators.linkage import merge_texts, ratio_udf
from broadsheet.sources import adapters, documents


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(make(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.heading_score, "India wins series decider", 0.65),
        (T.heading_score, "", 0.0),
        (T.heading_score, "   ", 0.0),
        (T.heading_score, None, 0.0),
        (T.heading_score, "Big City News Today", 1.0),
        (T.caption_score, "Photo: PTI", 0.80),
        (T.caption_score, "word " * 26, 0.0),
        (T.jump_score, "Continued on page 6", 1.0),
        (T.jump_score, "पृष्ठ 4 पर जारी", 1.0),
        (T.jump_score, None, 0.0),
    ],
)
def test_scores(spark, f, text, want):
    assert abs(one(spark, f, text) - want) < 1e-9


@pytest.mark.parametrize(("text", "want"), [("नई Delhi", "en"), ("नई दिल्ली", "hi"), ("123", "unknown"), (None, "unknown")])
def test_language(spark, text, want):
    assert one(spark, T.language, text) == want


@pytest.mark.parametrize(("text", "want"), [("abc अ", "latin"), ("अआ ab", "devanagari"), ("ஆஇ", "tamil"), ("12", None), (None, None)])
def test_script(spark, text, want):
    assert one(spark, T.dominant_script, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("4 August 2026 and 5 August 2026", None),
        ("August 4, 2026", datetime.date(2026, 8, 4)),
        ("4 Aug 2026 4/8/2026", datetime.date(2026, 8, 4)),
        ("31/2/2026", None),
        (None, None),
    ],
)
def test_unique_date(spark, text, want):
    assert one(spark, T.unique_date, text) == want


def test_uuid5_is_pythons(spark):
    for v in ("doc_000001", "", "é", "x" * 200):
        assert one(spark, lambda c: T.uuid5("document", c), v) == str(uuid.uuid5(uuid.NAMESPACE_URL, f"newspaper-archive:document:{v}"))
    assert one(spark, lambda c: T.uuid5("document", c), "doc_000001") == "416d24a9-2e6b-5c74-a670-0afadbd156d5"


def test_small_rules(spark):
    assert one(spark, T.image_url, "C:\\x\\output\\a.png") == "/output/a.png"
    assert one(spark, T.image_url, "output/a.png") == "/output/a.png" and one(spark, T.image_url, "/tmp/a.png") is None
    assert one(spark, T.match_text, "कि") == "क"
    assert one(spark, T.match_tokens, "The Cat, the CAT and a dog-house") == ["cat", "cat", "dog", "house"]
    assert one(spark, T.jump_slug, "►3 excise officials, P 14") == "3 excise officials" and one(spark, T.jump_slug, "page 3") is None
    assert [one(spark, T.safe_int, v) for v in (" 7 ", "3.0", "-2", "x", None)] == [7, None, -2, None, None]
    assert one(spark, T.author, "Head\nBy Asha Rao\nbody text") == "Asha Rao" and one(spark, T.author, "x\n(PTI)") == "PTI" and one(spark, T.author, None) is None
    d = one(spark, T.dateline, "Head line\nNEW DELHI, Aug 12: Text")
    assert (d.location, d.date) == ("NEW DELHI", "Aug 12")
    e = one(spark, T.entities, "Ravi Kumar met Asha at State Bank on 4 August 2026. May Day")
    assert e.people == ["Ravi Kumar", "State Bank"] and e.dates == ["4 August 2026", "August", "May Day"] and "State Bank" in e.organizations[0] and e.places == []
    assert one(spark, T.sentiment, "win victory fire") == "positive" and one(spark, T.sentiment, None) == "neutral"
    s = one(spark, T.sentence_features, "One two. Three four!")
    assert (s.first_sentence, s.last_sentence, s.first_word, s.last_word, s.ends_with_punctuation) == ("One two.", "Three four!", "One", "four", True)
    c = one(spark, T.continuation, "Story text\nContinued on Page 6")
    assert (c.is_continued, c.next_page) == (True, 6)


def test_similarity(spark):
    assert one(spark, lambda a, b: ratio_udf()(a, b), "abcd", "bcde") == 0.75
    assert one(spark, lambda a, b: ratio_udf()(a, b), None, "x") == 0.0


def test_overlap_merge():
    assert merge_texts(["a b c d e f", "b c d e f g"]) == "a b c d e f g"
    assert merge_texts(["a b c d", "b c d e"]) == "a b c d\n\nb c d e"
    assert merge_texts([None, "", "x", "x", "x y"]) == "x y" and merge_texts([]) == ""


def test_search(spark):
    docs = spark.createDataFrame([(1, "Budget talks", "The minister presents budgets today"), (2, None, "No budget here, but cricket"), (3, "Cricket", None)], "id int, title string, body string")
    fields = {"title": "A", "body": "C"}
    ids = lambda q: [r.id for r in S.search(docs, fields, q).orderBy(F.desc("rank")).collect()]
    assert ids("budget") == [1, 2] and ids("budget -cricket") == [1] and ids("cricket minister") == []
    assert sorted(ids("minister OR cricket")) == [1, 2, 3] and ids('"minister presents"') == [1] and ids('"presents minister"') == [] and ids("") == []
    index = S.index(docs, "id", fields).filter("token = 'budget'").orderBy("id", "weight").collect()
    assert [(r.id, r.weight, r.positions) for r in index] == [(1, "A", [0]), (1, "C", [2]), (2, "C", [0])]


def test_documents(spark):
    m = one(spark, documents.filename_metadata, "Times of India_Chandigarh_20260804_removed.pdf")
    assert (m.newspaper_name, m.edition, m.publish_date) == ("The Times of India", "Chandigarh", datetime.date(2026, 8, 4))
    assert one(spark, documents.as_list, '["a", "b"]') == ["a", "b"] and one(spark, documents.as_list, "a, b") == ["a", "b"] and one(spark, documents.as_list, None) == [] and one(spark, documents.as_list, "[bad") == ["[bad"]
    assert one(spark, lambda c: documents.model_json(c, "a int"), '```json\n{"a": 1}\n```').a == 1


def test_adapters(spark):
    profile = spark.sql("SELECT array(0.0, 0.5, 0.5, 0.0, 0.0, 0.4, 0.0, 0.0, 0.0, 0.0, 0.0, 0.9) AS p, array(1, 1, 0, 1, 2, 2, 0) AS i, array(100, 200) AS w, array(50, 100) AS h")
    r = profile.select(adapters.ink_bands(F.col("p")).alias("b"), adapters.ctc_decode(F.col("i")).alias("c"), adapters.strip_size(F.col("w"), F.col("h")).alias("s")).first()
    assert [tuple(x) for x in r.b] == [(1, 5), (11, 11)] and r.c == [1, 1, 2] and tuple(r.s) == (200 + 200 + 20 + 40, 140)
    a = adapters.Adapters({"grouping": spark.createDataFrame([(1, 1, 5, "x"), (2, 1, 6, "y")], adapters.CONTRACTS["grouping"][1])})
    assert a.ask("grouping", spark.createDataFrame([(1,)], "page_id long"), ["page_id"]).count() == 1
    with pytest.raises(NotImplementedError):
        a.ask("ocr", profile, ["page_id"])


def test_fields(spark):
    import datetime

    from broadsheet.functions import fields, routing

    assert one(spark, lambda a, b: fields.first_value(a, b, default="d"), " ", None) == "d" and one(spark, fields.first_value, " x ") == "x"
    date = lambda stated, text: one(spark, lambda a, b: fields.article_date(a, b, F.lit(2024)), stated, text)
    assert date("2023-02-01x", None) == datetime.date(2023, 2, 1) and date("Aug 4", "") == datetime.date(2024, 8, 4) and date("issue of March 5, 2020", "") == datetime.date(2020, 3, 5)
    assert date(None, "PATNA, Aug 12: text") == datetime.date(2024, 8, 12) and date(None, None) is None and date("Feb 31", "") is None
    assert [one(spark, lambda c: fields.image_items(c), v) for v in (None, "x", "{}", "[]")] == [[], [], [], []]
    assert one(spark, fields.slug, " The Hindu-Daily! ") == "the_hindu_daily" and one(spark, lambda c: fields.highlighted(c, "a.b"), "A.B axb") == "<mark>A.B</mark> axb"
    assert one(spark, routing.pipeline_of, None) == "hindi" and one(spark, routing.pipeline_of, "Urdu") == "urdu" and routing.dimension(spark).count() == 13
    assert one(spark, lambda c: routing.provider(c, local=True), "te") == "local"
    assert one(spark, lambda c: fields.page_links(F.lit(1), F.lit(1)), "") == [1] and one(spark, lambda c: fields.page_links(F.lit(5), F.lit(9)), "") == [1, 0, 4, 5, 6, 0, 9]


def test_mastheads(spark):
    import datetime

    from broadsheet.operators import masthead as M

    lines = spark.createDataFrame([(1, 0, "THE TIMES OF 1NDIA", 0.9), (1, 1, "Chandigarh 4 August 2024", 0.9), (2, 0, "Something else", 0.9), (3, 0, "The Hindu", 0.1)], "document_id long, y1 int, text string, confidence double")
    templates = spark.createDataFrame([(1, "The Times of India"), (1, "Times of India"), (2, "The Hindu"), (3, "Hindustan Times")], "template_id int, variant string")
    registry = spark.createDataFrame([(1, "The Times of India", "Chandigarh", True), (2, "The Hindu", None, False)], "template_id int, newspaper_name string, edition string, verified boolean")
    assert {(r.document_id, r.template_id) for r in M.match_templates(lines, templates).collect()} == {(1, 1), (3, 2)}
    got = M.masthead_metadata(lines, templates, registry, datetime.date(2024, 8, 3)).collect()
    assert [(r.document_id, r.newspaper_name, r.edition, r.publish_date) for r in got] == [(1, "The Times of India", "Chandigarh", datetime.date(2024, 8, 4))]
    old = spark.createDataFrame([("t", "A", "x", 2, False)], "template_id string, newspaper_name string, edition string, confirmation_count int, verified boolean")
    new = {r.newspaper_name: (r.confirmation_count, r.verified) for r in M.learn(old, spark.createDataFrame([("A", "x"), ("B", "y")], "newspaper_name string, edition string")).collect()}
    assert new == {"A": (3, True), "B": (1, False)}
