"""Lines of one or two words take part in the query and in the pipeline."""

import random

import corpus_pipeline
from broadsheet.llm import queries
from tests.llm.helpers import awkward, table


def kept(texts: list[str | None]) -> list[str | None]:
    """Without a floor: every line with a word goes if an earlier one is similar."""
    seen, out = [], []
    for text in texts:
        left = []
        for line in (text or "").encode().split(b"\n"):
            w = set(line.split())
            if not w or not any(9 * len(w & v) >= 4 * (len(w) + len(v)) for v in seen):
                left.append(line)
            seen += [w] if w else []
        out.append(None if text is None else b"\n".join(left).decode())
    return out


def corpus() -> list[str | None]:
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 7)))
    return ["Read more\na b c d e", "x\nRead  more\n\n" + "no " * 50, "more Read\nno\nx", *awkward(), *("\n".join(line() for _ in range(rng.randint(1, 6))) for _ in range(60))]


def test_short_lines_go(spark, tmp_path):
    texts = corpus()
    docs = table(spark, texts)
    want = kept(texts)
    assert want[2] == ""
    assert {r.doc_id: r.text for r in corpus_pipeline.line_similarity(spark, docs, "").collect()} == dict(enumerate(want))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_chars for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: len(t or "") for i, t in enumerate(want)}
