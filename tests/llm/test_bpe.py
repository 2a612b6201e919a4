import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from broadsheet.llm import bpe, token_counts, token_files
from tests.llm.helpers import awkward, table

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts(n=150):
    rng, v = random.Random(1), bpe.vocabulary(PATH)
    tokens = [b.decode("utf-8", "ignore") for b in v.bytes_of]
    more = ["<|endoftext|>", "<|endof", " ", "  ", "\n", "\t \n", " \n", "\xa0", "\x1c", "'s", "é", "日本", "😀", "²", "́", "՘", "a" * 700, "1" * 300, "!?" * 400, " " * 400]
    return ["".join(rng.choice([rng.choice(tokens)] * 6 + more) for _ in range(rng.randint(0, 30))) for _ in range(n)] + awkward()


def test_lookahead_of_small_merge_lists():
    width = {0: 1, 1: 1, 2: 2, 3: 3, 4: 4}
    assert bpe.sufficient_lookahead([], width) == 0
    assert bpe.sufficient_lookahead([(0, 1, 2)], width) == 1
    # (a, ab) needs ab, whose end b falls to no rule: two bytes
    assert bpe.sufficient_lookahead([(0, 1, 2), (0, 2, 3)], width) == 2
    # (b, a) first: whether a follows b; then (a, b) has to wait for what b does
    assert bpe.sufficient_lookahead([(1, 0, 2), (0, 1, 2)], width) == 2


def test_encoder_equals_library(library):
    for t in odd_texts():
        assert bpe.encode(t, PATH).tolist() == ids(library, t)


def test_parts_of_any_size_give_the_same(library):
    rng = random.Random(2)
    for t in [x for x in odd_texts(80) if x]:
        e, out, at = bpe.StreamEncoder(PATH), b"", 0
        while at < len(t):
            k = rng.choice([1, 2, 7, 100, 5000])
            out += e.feed(t[at : at + k])
            at += k
        assert np.frombuffer(out + e.finish(), e.v.dtype).tolist() == ids(library, t)


def test_long_piece_keeps_constant_state(library):
    v = bpe.vocabulary(PATH)
    t, text, out = bpe.PieceTransducer(v), "".join(random.Random(3).choice("abcdefghij") for _ in range(20_000)), []
    for at in range(0, len(text), 500):
        out += t.feed(text[at : at + 500].encode())
        assert len(t.held) <= v.lookahead + 3 * t.STEP
    assert out + list(t.finish()) == ids(library, text)


def test_decoder_holds_cut_characters():
    d = bpe.StreamDecoder(PATH)
    parts = [d.feed([i]) for i in bpe.encode("日本😀é", PATH).tolist()]
    assert "".join(parts) + d.finish() == "日本😀é"
    d.feed([bpe.vocabulary(PATH).byte_id[0xE6]])
    assert d.finish() == "�"


def test_documents(spark, library):
    texts = odd_texts(40)
    docs = table(spark, texts, [*range(len(texts) - 1), None])
    got = {r.doc_id: r for r in bpe.digest_documents(docs, PATH).collect()}
    assert len(got) == len(texts)
    for i, t in zip([*range(len(texts) - 1), None], texts, strict=True):
        x = ids(library, t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()}
    assert back == {i: t or "" for i, t in zip([*range(len(texts) - 1), None], texts, strict=True)}
    assert bpe.digest_documents(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("counts", [[0, 0], [0, 7], [1, 1], [5, 1, 1, 1], [1 << k for k in range(30)], [1] * 1000])
def test_code_lengths(counts):
    counts = np.array(counts)
    lengths = token_files.code_lengths(counts, 12)
    used = counts > 0
    assert (lengths[used] > 0).all() and (lengths[~used] == 0).all() and lengths.max(initial=0) <= 12
    assert sum(2.0 ** -float(n) for n in lengths[used]) <= 1
    codes = token_files.canonical_codes(lengths)
    shown = sorted(format(codes[i], f"0{lengths[i]}b") for i in np.flatnonzero(used))
    assert not any(b.startswith(a) for a, b in zip(shown, shown[1:], strict=False))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_decode_alone(n):
    x = np.random.default_rng(n).zipf(1.4, n) % 3000
    lengths = token_files.code_lengths(np.bincount(x, minlength=3000))
    payload, marks = token_files.pack(x, lengths, token_files.canonical_codes(lengths))
    assert (token_files.unpack(payload, marks, n, token_files.decoding_table(lengths)) == x).all()


def test_token_files(spark, library):
    texts = odd_texts(40) + ["same", "same"]
    keys = [*range(len(texts) - 4, 0, -1), 7000, 7000, None, -5]
    got = token_files.digest(*token_files.write(table(spark, texts, keys), PATH)).orderBy("start").collect()
    assert len(got) == len(texts)
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and got[0].doc_id is None
    by_key: dict = {}
    for k, t in zip(keys, texts, strict=True):
        by_key.setdefault(k, []).append(zlib.crc32(np.array([*ids(library, t), 0], "<u4").tobytes()))
    at = 0
    for r in got:
        assert r.start == at and r.ids_crc32 in by_key[r.doc_id]
        by_key[r.doc_id].remove(r.ids_crc32)
        at += r.n_tokens
    assert token_files.digest(*token_files.write(table(spark, []), PATH)).count() == 0


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long")


def test_token_counts(spark):
    r = token_counts.Rollup(spark)
    first = changes(spark, [("insert", 1, "a", "en", "t1", 10), ("insert", 2, "a", None, "t1", 20), ("insert", 1, "a", "en", "t2", 7), ("insert", 1, "a", "en", "t1", 10), ("insert", None, "b", "en", "t1", 1), ("insert", None, "b", "en", "t1", 1)])
    assert r.apply("b1", first) and not r.apply("b1", first)
    total = lambda: sorted(map(tuple, r.totals().collect()), key=str)
    assert total() == sorted([("a", "en", "t1", 1, 10), ("a", None, "t1", 1, 20), ("a", "en", "t2", 1, 7), ("b", "en", "t1", 2, 2)], key=str)
    assert r.apply("b2", changes(spark, [("delete", 2, None, None, "t1", None), ("revise", 1, "c", "en", "t1", 11), ("delete", 99, None, None, "t1", None), ("delete", 1, None, None, "t1", None), ("delete", None, "b", "en", "t1", 1)]))
    assert total() == sorted([("c", "en", "t1", 1, 11), ("a", "en", "t2", 1, 7), ("b", "en", "t1", 2, 2)], key=str)
    again = token_counts.Rollup(spark, r.path)
    assert again.committed() == ["b1", "b2"] and not again.apply("b2", first)
    assert again.apply("b3", changes(spark, [])) and total() == sorted(map(tuple, again.totals().collect()), key=str)


def test_a_run_that_broke_off_leaves_nothing(spark):
    r = token_counts.Rollup(spark)
    row = changes(spark, [("insert", 1, "a", "en", "t1", 10)])
    row.select("doc_id", "source", "lang", "tokenizer", "n_tokens").selectExpr("*", "1 AS sign").write.parquet(f"{r.path}/ledger/b1")
    assert r.committed() == [] and r.totals().count() == 0
    assert r.apply("b1", row) and [tuple(x) for x in r.totals().collect()] == [("a", "en", "t1", 1, 10)]


LONG_TEXTS = {
    "mixed": "ab1,", "cjk": "日本語、文章。", "space": " ", "tabs": "\t \n", "letters": "abcde", "digits": "1234567", "signs": "!?'", "apostrophes": "'re'", "code": "function(a){return a+1;}", "unassigned": "\u0378a", "free": "\u0378", "base64": "QUJDREVG09+/", "words": "some words, ",
}


@pytest.mark.parametrize("name", LONG_TEXTS)
def test_state_stays_small_whatever_the_text(library, name):
    unit = LONG_TEXTS[name]
    text = "start" + unit * (200_000 // len(unit)) + "x  " + unit * 300 + " "
    for part in (977, 1 << 16):
        e, got, most = bpe.StreamEncoder(PATH), [], 0
        for at in range(0, len(text), part):
            got.append(e.feed(text[at : at + part]))
            most = max(most, len(e.held) + (len(e.open.held) if e.open else 0))
        got.append(e.finish())
        assert np.frombuffer(b"".join(got), e.v.dtype).tolist() == ids(library, text)
        assert most <= 4 * bpe.LONG_PIECE + e.v.lookahead + 2 * bpe.PieceTransducer.STEP


def test_any_parts_give_the_same_ids(library):
    rng = random.Random(9)
    bits = ["'", "r", "e", "'re", "'s", " ", "  ", "\n", "a", "é", "1", "!", "日", "\u0378", "\x1c", "<|endoftext|>", "<|end", " " * 1100, "a" * 1100, "!" * 1100, "\u0378" * 1100, "\n" * 1100]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        e, got, at = bpe.StreamEncoder(PATH), [], 0
        while at < len(text):
            n = rng.choice([1, 2, 3, 7, 50, 1025, 3000])
            got.append(e.feed(text[at : at + n]))
            at += n
        got.append(e.finish())
        assert np.frombuffer(b"".join(got), e.v.dtype).tolist() == ids(library, text), repr(text)


def test_null_tokenizers_and_sequence(spark):
    r, columns = token_counts.Rollup(spark), "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, seq long, sign int, part int"
    rows = lambda x: spark.createDataFrame([(*c, 9, 9) for c in x], columns)  # noqa: E731  columns with the ledger's own names
    total = lambda: {(x.source, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert r.apply("1", rows([("insert", 1, "a", "en", None, 10, None)])) and r.apply("2", rows([("insert", 1, "a", "en", None, 10, None)]))
    assert total() == {("a", None): (1, 10)}
    assert r.apply("3", rows([("insert", 2, "a", "en", "t", 5, 1), ("revise", 2, "a", "en", "t", 4, 3), ("delete", 2, None, None, "t", None, 2), ("revise", 1, "b", "en", None, 8, 1), ("delete", 1, None, None, None, None, 2)]))
    assert total() == {("a", "t"): (1, 4)}  # the last change of each document, not the largest
    for bad in (None, "upsert"):
        with pytest.raises(Exception, match="no such change"):
            r.apply("4", rows([("insert", 7, "a", "en", "t", 1, 1), (bad, 2, "a", "en", "t", 1, 1)]))
    assert r.committed() == ["1", "2", "3"] and total() == {("a", "t"): (1, 4)}
    assert r.compact() and r.apply("5", rows([("revise", 2, "c", "en", "t", 6, None), ("insert", None, "d", "en", "t", 1, None)])) and r.compact()
    assert r.apply("6", rows([("delete", 2, None, None, "t", None, None)])) and not r.apply("5", rows([]))
    assert total() == {("d", "t"): (1, 1)} and r.current().count() == 0


def test_random_changes_against_a_dictionary(spark):
    rng, r, state = random.Random(6), token_counts.Rollup(spark), {}
    for b in range(4):
        batch = [(rng.choice(["insert", "delete", "revise"]), rng.randrange(12), rng.choice("ab"), None, rng.choice(["t", None]), rng.randrange(50), k) for k in range(15)]
        assert r.apply(str(b), spark.createDataFrame(batch, "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, seq long"))
        for op, i, source, _, t, n, _ in batch:
            state.pop((i, t), None) if op == "delete" else state.update({(i, t): (source, n)})
        want = {}
        for (_, t), (source, n) in state.items():
            docs, tokens = want.get((source, t), (0, 0))
            want[source, t] = (docs + 1, tokens + n)
        assert {(x.source, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()} == want


def test_a_batch_reads_the_parts_of_its_keys(spark):
    r = token_counts.Rollup(spark)
    r.apply("1", changes(spark, [("insert", k, "a", "en", "t", 1) for k in range(500)]))
    keys = spark.createDataFrame([(3, "t")], "doc_id long, tokenizer string")
    plan = r.current(keys=keys)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters")[1].split("]")[0]


def test_two_writers_at_once(spark, monkeypatch):
    """The second writer finds its number taken and starts over from what the first committed."""
    r, other = token_counts.Rollup(spark), None
    other = token_counts.Rollup(spark, r.path)
    write, done = token_counts.Rollup._write, []

    def slow(self, signed, files):
        out = write(self, signed, files)
        if self is r and not done:
            done.append(other.apply("b", changes(spark, [("insert", 1, "b", "en", "t", 5)])))
        return out

    monkeypatch.setattr(token_counts.Rollup, "_write", slow)
    assert r.apply("a", changes(spark, [("insert", 1, "a", "en", "t", 3)])) and done == [True]
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "t", 1, 3)]


def test_encoded_documents_decode(spark, library):
    texts = odd_texts(30)
    rows = {r.doc_id: r for r in bpe.encode_documents(table(spark, texts), PATH, decoded=True).collect()}
    assert all(rows[i].ids == ids(library, t) and rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts))


def test_count_tokens(spark, library):
    texts = odd_texts(20)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, texts), PATH).collect()}
    assert got == {i: len(ids(library, t)) for i, t in enumerate(texts)}
