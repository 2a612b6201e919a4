"""Sections are whole texts."""

from broadsheet.plans import catalogue


def test_words_past_the_beginning_count(spark, tmp_path):
    first = " ".join(f"start{k}" for k in range(60))
    texts = {1: first + " " + " ".join(f"later{k}" for k in range(600)), 41: first}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.section_id: r for r in catalogue.QUERIES["j15_sections"](spark, str(tmp_path)).collect()}
    assert got[1].article_id == 1 and got[41].article_id == 1 and got[41].score == 1.0
    far = {1: first + " tail1 tail2 tail3", 42: "q " * 200 + " ".join(f"word{k}" for k in range(40)), 82: " ".join(f"word{k}" for k in range(30)) + " " + " ".join(f"own{k}" for k in range(30))}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in far.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/2/documents.parquet")
    got = {r.section_id: r for r in catalogue.QUERIES["j15_sections"](spark, f"{tmp_path}/2").collect()}
    assert {1, 42, 82} <= set(got) and got[42].article_id == 42 and got[42].score == 1.0
