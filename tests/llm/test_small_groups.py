"""The quality rules judge small groups too."""

import random

from broadsheet.llm import quality
from tests.llm.test_others import prose


def test_small_groups_are_judged_by_their_language(spark):
    rng = random.Random(9)
    rows = [(10 * s + k, prose(rng, rng.randint(80, 250)), lang, f"s{s}") for s in range(40) for lang in ["en" if s % 2 else None] for k in range(3)]
    rows += [(1000, prose(rng, 150, 0.8), "en", "s1"), (1001, prose(rng, 150, 0.8), None, "s2"), (1002, prose(rng, 150, 0.8), "en", None), (1003, prose(rng, 150), "xx", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {1000, 1001, 1002}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == set(got) - {1000, 1001, 1002}
