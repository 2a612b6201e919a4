import random

import numpy as np
import pyarrow as pa
import pytest

from broadsheet.llm import blocks, line_dedup, near_duplicates, set_join
from tests.llm.helpers import awkward, kept_lines, table
from tests.llm.helpers import near_duplicates as brute_near


def copies(seed: int, n: int, words: int, edits: int) -> list[str]:
    """Near copies of one text, with some lines in common."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(200)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(1000)}"
        out.append("\n".join(" ".join(w[k : k + 12]) for k in range(0, words, 12)))
    return out


CASES = {"awkward": awkward(), "copies": copies(1, 40, 120, 4), "mixed": [*copies(2, 25, 60, 3), *awkward(), *copies(3, 12, 300, 12)], "one": ["a b c d e f"], "none": []}


@pytest.mark.parametrize("name", CASES)
def test_near_duplicates(spark, name, monkeypatch):
    monkeypatch.setattr(set_join, "CELL", 7)  # several cells even here
    texts = CASES[name]
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id, r.stays) for r in near_duplicates.near_duplicates(table(spark, texts)).collect()}
    want = brute_near(list(enumerate(texts)))
    assert got == {i: (*v, i == v[2]) for i, v in want.items()}


@pytest.mark.parametrize("name", ["mixed", "copies"])
def test_hot_elements_in_parts_and_salted_ranges(spark, name, monkeypatch):
    """Parts of three postings, ranges salted from two records on, several blocks: the same results."""
    monkeypatch.setattr(set_join, "HOT", 3)
    monkeypatch.setattr(set_join, "SALT_ABOVE", 2)
    monkeypatch.setattr(set_join, "MANY", 2)
    monkeypatch.setattr(blocks.pack, "__defaults__", (False, 800))
    texts = CASES[name]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert got == dict(enumerate(kept_lines(list(enumerate(texts)))))
    monkeypatch.setattr(near_duplicates, "CHAIN_ABOVE", 3)
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in near_duplicates.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_near(list(enumerate(texts)))


def test_one_hot_element_is_spread_over_units(spark):
    """An element that 40,000 records have: no unit holds more than two parts of it, and the similar pairs come out."""
    n, rng = 40_000, np.random.default_rng(3)
    record = np.arange(n, dtype=np.int64)
    bitmap = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    bitmap[1::1000] = bitmap[::1000]  # 40 pairs that no filter tells apart
    row = {"bucket": 0, "element": np.full(n, 7, "<u8").tobytes(), "record": record.tobytes(), "size": np.full(n, 10, "<i4").tobytes(), "place": np.zeros(n, "<i4").tobytes(), "bitmap": bitmap.tobytes()}
    parts = set_join.link(pa.Table.from_pylist([row], set_join.POSTED), set_join.Threshold(), None, 4)
    assert len(parts) == 3 and parts["a"].null_count == 3 and max(len(x.as_py()) for x in parts["record"]) == set_join.HOT * 8
    links = set_join.across(spark.createDataFrame(parts), set_join.Threshold(), None).collect()
    found = {frozenset((r.a, r.b)) for r in links}
    assert {frozenset((k, k + 1)) for k in range(0, n, 1000)} <= found


def test_nothing_stays_in_the_catalog(spark):
    near_duplicates.near_duplicates(table(spark, CASES["one"])).collect()
    line_dedup.measure_lines(table(spark, CASES["one"])).collect()
    assert spark.catalog.listTables() == []


def test_record_numbers_end_with_an_error_not_with_the_next_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PLACE_BITS", 1)
    monkeypatch.setattr(blocks.pack, "__defaults__", (False, 50))
    with pytest.raises(Exception, match="has no number"):
        blocks.pack(table(spark, ["x" * 60] * 40).coalesce(1)).count()


def test_blocks_of_empty_texts_end(spark, monkeypatch):
    monkeypatch.setattr(blocks.pack, "__defaults__", (False, 16 * 8))
    sizes = [len(r["ids"]) // 8 for r in blocks.pack(table(spark, [None] * 40).coalesce(1)).collect()]
    assert sum(sizes) == 40 and max(sizes) == 8


def test_totals_beyond_32_bits():
    x = np.array([1, 1 << 40, 5], np.int64)
    assert (blocks.stretch(blocks.shrink(x)).astype(np.int64) == x).all()


def test_long_postings_link_alike(spark, monkeypatch):
    texts = CASES["mixed"]
    monkeypatch.setattr(near_duplicates, "CHAIN_ABOVE", 3)
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in near_duplicates.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_near(list(enumerate(texts)))


def test_near_duplicates_with_repeated_and_null_ids(spark):
    texts = ["a b c d e f", "a b c d e f", "q r s t u v", None, "a b c d e f"]
    rows = near_duplicates.near_duplicates(table(spark, texts, [5, 5, 5, None, None])).collect()
    assert len(rows) == 5 and sum(r.stays for r in rows) == 3
    assert {r.class_id for r in rows if r.doc_id == 5} == {None, 5}  # the null id leads its class


def test_one_of_each_group_keeps_rows(spark):
    docs = table(spark, CASES["mixed"])
    kept = near_duplicates.one_of_each_group(docs)
    assert kept.schema == docs.schema
    want = {i for i, v in brute_near(list(enumerate(CASES["mixed"]))).items() if v[2] == i}
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id in want)


def test_pruning_rarely_drops_a_true_pair():
    rng = random.Random(0)
    lost = 0
    for _ in range(400):
        shared, rest = rng.sample(range(10**9), 160), rng.sample(range(10**9, 2 * 10**9), 40)
        a, b = np.array(shared + rest[:20], np.uint64), np.array(shared + rest[20:], np.uint64)  # Jaccard 0.8
        rows = {"signature": np.array([near_duplicates.signature(blocks.mix(x)) for x in (a, b)], object)}
        left, _ = near_duplicates._plausible(rows, np.array([0]), np.array([1]))
        lost += not len(left)
    assert lost == 0
    assert near_duplicates.fewest_matches(64) > 16  # and unlike pairs fall


@pytest.mark.parametrize("name", CASES)
def test_line_dedup(spark, name, monkeypatch):
    monkeypatch.setattr(set_join, "CELL", 5)
    texts = CASES[name]
    docs = table(spark, texts)
    kept = line_dedup.dedup_lines(docs)
    assert [f.name for f in kept.schema] == docs.columns
    got = {r.doc_id: (r.text, r.n_chars, r.record) for r in kept.collect()}
    want = kept_lines(list(enumerate(texts)))
    assert got == {i: (t, None if t is None else len(t), f"r{i}") for i, t in enumerate(want)}


def test_line_dedup_counts(spark):
    texts = CASES["mixed"]
    rows = {r.doc_id: r for r in line_dedup.measure_lines(table(spark, texts)).collect()}
    for i, t in enumerate(kept_lines(list(enumerate(texts)))):
        assert rows[i].n_lines == (texts[i] or "").count("\n") + 1 and rows[i].kept_chars == len(t or "")
        if rows[i].n_removed < rows[i].n_lines:
            assert rows[i].n_removed == rows[i].n_lines - ((t or "").count("\n") + 1)


def test_line_dedup_order_is_doc_id(spark):
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, ["a b c d", "a b c d", "a b c d"], [9, 3, None])).collect()}
    assert got == {9: "", 3: "", None: "a b c d"}


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    rng = random.Random(2)
    seen: dict = {}
    for size in (50, 1 << 18):
        monkeypatch.setattr(blocks, "HASH_BYTES", size)
        for _ in range(60):
            texts = [b"".join(rng.choice([b"a", b"bc", b" ", b"\n", b"\t", "é".encode(), b"x" * 80, b"x" * 300, b"\x0b", b"\x1c"]) for _ in range(rng.randint(0, 40))) for _ in range(8)]
            h, n = blocks.hash_words(texts)
            assert n.tolist() == [len(t.split()) for t in texts]
            for w, x in zip([w for t in texts for w in t.split()], h.tolist(), strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_keys_survive_packing():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert (blocks.unsqueeze(blocks.squeeze(x)) == x).all() and (blocks.stretch(blocks.shrink(np.arange(999))) == np.arange(999)).all()


def test_small_blocks_give_the_same(spark, monkeypatch):
    texts = CASES["mixed"]
    monkeypatch.setattr(blocks.pack, "__defaults__", (False, 400))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert got == dict(enumerate(kept_lines(list(enumerate(texts)))))
