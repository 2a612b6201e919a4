"""Similarities, overlaps and keywords that are worked out a text or a pair at a time, against their plain forms."""

import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from broadsheet.functions import lexicons as X
from broadsheet.functions import text as T
from broadsheet.operators import linkage as K
from broadsheet.plans import catalogue
from broadsheet.plans.text_queries import keyword_ranks
from tests.conftest import SF

AWKWARD = [
    None, "", "  ", "the and of", "harbour bridge", "Harbour Bridge and harbour  bridge, Harbour\tBridge; HARBOUR harbour.", "Bank bank BANK Bank Note Bank\nNote",
    "naïve İstanbul Kelvin ΣΑΣ σας Straße straße एक दो तीन एक दो तीन", "see page 4 see page 4 see page 4 " * 9, "\x1csteel\x1dprice steel price warning steel price warning",
]


def plain(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_ratio_is_difflibs():
    r = random.Random(7)
    for k in range(4000):
        letters = ("ab", "abcde é", "abcdefghijklmnopqrstuvwxyzकख𝒳 ")[k % 3]
        a, b = ("".join(r.choice(letters) for _ in range(r.randrange(50))) for _ in range(2))
        b = b if k % 4 else b[:9] + a[len(a) // 2 :] + b[9:]
        assert K.ratio(a, b) == plain(a, b), (a, b)
    assert K.ratio("", "") == plain("", "") == 1.0 and K.ratio("a", "") == 0.0


def test_ratio_of_long_texts_takes_a_fraction_of_difflibs_time(spark):
    texts = [" ".join(r.text.lower().split())[:900] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 1000").orderBy("doc_id").limit(21).collect()]
    pairs = list(zip(texts, texts[1:], strict=False))
    took = []
    for f in (plain, K.ratio):
        began = time.process_time()
        took.append(([f(a, b) for a, b in pairs], time.process_time() - began))
    assert len(pairs) > 10 and took[0][0] == took[1][0] and 3 * took[1][1] < took[0][1]


def test_overlap_is_text_overlap(spark):
    texts = AWKWARD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    d = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    ends = T.match_text(F.right(T.text_of("a"), F.lit(T.NEAR_BREAK))), T.match_text(F.left(T.text_of("b"), F.lit(T.NEAR_BREAK)))
    for r in d.select(T.text_overlap(F.col("a"), F.col("b")).alias("x"), K.overlap_udf()(*ends).alias("y")).collect():
        assert r.x == r.y


def test_keywords_are_keyword_ranks(spark):
    d = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    rows = {}
    for r in keyword_ranks(d, "doc_id", "text").collect():
        rows.setdefault(r.doc_id, {})[r.rank] = r.keyword
    for r in d.select("doc_id", K.keywords_udf()("text").alias("found")).collect():
        assert r.found == [k for _, k in sorted(rows.get(r.doc_id, {}).items())], r.doc_id


def test_pages_and_first_words_are_those_of_the_whole_patterns(spark):
    texts = AWKWARD + ["Continued on Page 12", "p. 7", "CONTINUED ON\npages p 3 and pg-14", "page 3, more on pg. 4", "ſee page 8 page 9", "turn to x\ny page 2", "see p12345 p.1", "   one  two", "Full report on P:0009."]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.coalesce(*(T.first_match(T.text_of("t"), f"(?iu){p}") for p in (X.TARGET_PHRASE, X.TARGET_PAGE))).try_cast("int")
    for r in d.select("t", whole.alias("a"), T.jump_page(F.col("t")).alias("b"), *(F.slice(T.words("t"), 1, n).alias(f"w{n}") for n in (1, 2, 8)), *(T.first_words("t", n).alias(f"f{n}") for n in (1, 2, 8))).collect():
        assert r.a == r.b and (r.w1, r.w2, r.w8) == (r.f1, r.f2, r.f8), r


def test_continuations_need_no_row_for_each_word(spark):
    plan = catalogue.QUERIES["k15_continuations"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "documents.parquet" not in plan
