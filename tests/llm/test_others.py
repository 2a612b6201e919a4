import base64
import collections
import gzip
import hashlib
import io
import itertools
import math
import random
import re

import numpy as np
import pytest

from broadsheet.llm import chat, contamination, lm_scores, quality, warc
from tests.compare import difference, duck
from tests.conftest import SF
from tests.llm.helpers import awkward, table

SPACES = r"[^\x20\x09-\x0D]+"


def test_statistics(spark):
    texts = awkward()
    rows = {r.doc_id: r for r in quality.statistics(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(SPACES, t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = collections.Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(SPACES, x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def prose(rng, n, junk=0.0):
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    return " ".join(("##" if rng.random() < junk else "") + rng.choice(vocabulary) for _ in range(n))


def test_outliers_go_and_small_groups_stay(spark):
    rng = random.Random(7)
    rows = [(k, prose(rng, rng.randint(60, 300)), "en", "big") for k in range(80)] + [(1000 + k, prose(rng, 150, 0.8), "en", "big") for k in range(6)]
    rows += [(2000 + k, prose(rng, 150, 0.8), "fr", None) for k in range(5)] + [(3000, None, "en", "big"), (3001, prose(rng, 100), "en", "big"), (3001, prose(rng, 100), "en", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = collections.defaultdict(list)
    for r in quality.judge(docs).collect():
        got[r.doc_id].append(r.kept)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[k] == [True] for k in range(80)) and all(got[1000 + k] == [False] for k in range(6))
    assert all(got[2000 + k] == [True] for k in range(5)) and got[3000] == [False] and got[3001] == [True, True]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(sum(v) for v in got.values())
    assert quality.judge(docs.limit(0)).count() == 0


def test_estimate_is_that_of_the_nearest_rows(spark):
    """After the last step, centre and scatter are those of rows within one distance of the step before."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, prose(rng, rng.randint(40, 400), 0.02 * (k % 3)), "en", "s") for k in range(120)], "doc_id long, text string, lang string, source string")
    x = quality.vectors(quality.statistics(docs))
    est = quality.estimates(x).first()
    values = [[r[f"x{i}"] / quality.SCALE for i in range(5)] for r in x.collect()]
    mean = [sum(v[i] for v in values) / len(values) for i in range(5)]
    assert all(abs(est[f"m{i}"] - mean[i]) < 0.5 for i in range(5)) and all(est[f"l{i}_{i}"] > 0 for i in range(5)) and est["rows"] == 120


def test_chi_square():
    """Values of printed tables."""
    assert abs(quality.chi_square_quantile(0.95, 5) - 11.0705) < 1e-4 and abs(quality.chi_square_quantile(0.975, 1) - 5.02389) < 1e-4
    assert abs(quality.chi_square_quantile(0.999, 10) - 29.5883) < 1e-4 and abs(quality.chi_square(2 * math.log(2), 2) - 0.5) < 1e-9
    assert abs(quality.consistency(1, 0.5) - 0.5 / (0.5 - 2 * 0.6744898 * 0.3177766)) < 1e-4  # of the middle half of a normal sample


def test_estimate_is_the_least_determinant(spark, monkeypatch):
    """Against all subsets of small groups; bins so narrow that each holds one row."""
    monkeypatch.setattr(quality, "BINS_PER_OCTAVE", 1 << 20)
    rng, floors, p = np.random.default_rng(4), [f for _, _, f in quality.features()], 5
    groups = {}
    for g in range(12):
        a = rng.normal(size=(11, p)) @ rng.normal(size=(p, p)) * 8
        a[:2] += rng.normal(size=p) * 60  # outliers
        groups[f"s{g}"] = np.round(a * quality.SCALE).astype(int)
    rows = [(s, *map(int, r)) for s, a in groups.items() for r in a]
    x = spark.createDataFrame(rows, "source string, " + ", ".join(f"x{i} long" for i in range(p))).selectExpr("CAST(null AS string) AS lang", "*")
    got, c, best = {r.source: r for r in quality.estimates(x).collect()}, quality.consistency(p, quality.COVER), 0
    for s, a in groups.items():
        tried = []
        for chosen in itertools.combinations(range(len(a)), math.ceil(len(a) * quality.COVER)):
            v = a[list(chosen)] / quality.SCALE
            tried.append((np.linalg.det(c * np.cov(v.T, bias=True) + np.diag(np.square(floors))), tuple(v.mean(0))))
        least, centre = min(tried)
        assert got[s].det > least * (1 - 1e-6)
        if got[s].det < least * (1 + 1e-6):
            best += 1
            assert np.allclose([got[s][f"m{i}"] for i in range(p)], centre)
    assert best >= 10  # concentration may end in a local minimum


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["<|start|>", "<|end|>\n", "<|next|>", "<|text|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<\\|", "<\\\\|x", "\\", "[\\INST]", "plain", "\n", "é", "<", "|", "", "😀"]
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 9)):
            rows.append((c if c else None, t, rng.choice(["user", "assistant", "assistant", "system", None, "<|x"]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 8))), 1))
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pieces int")
    formatted = chat.format_turns(chat.collect_turns(docs))
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        groups[c].append((t, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in formatted.collect():
        body = re.sub(r"<\|(start|text|next|end)\|>", "", r.formatted)
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", body)
        runs = len([1 for _ in itertools.groupby(x[1] for x in groups[r.conv_id])])
        assert r.formatted.count(chat.START) == runs and r.formatted.count(chat.END) == runs
    assert chat.digest(chat.format_turns(chat.collect_turns(docs.limit(0)))).count() == 0


def test_merged_turns_and_mask_are_values(spark):
    rows = [(1, 0, "user", "a<|x"), (1, 1, "user", "b"), (1, 2, "assistant", "é</s>😀"), (1, 3, "assistant", ""), (1, 4, "assistant", "d"), (1, 5, "user", "e"), (1, 6, "assistant", "f")]
    r = chat.format_turns(chat.collect_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [(m.role, m.texts) for m in r.merged] == [("user", ["a<|x", "b"]), ("assistant", ["é</s>😀", "", "d"]), ("user", ["e"]), ("assistant", ["f"])]
    texts = re.split(re.escape(chat.END) + "|" + re.escape(chat.NEXT), r.formatted)
    assert [texts[m.text][m.start : m.start + m.length] for m in r["mask"]] == ["é<\\/s>😀", "", "d", "f"]


def test_a_long_conversation(spark):
    """Twenty thousand turns of one role, and as many of alternating ones."""
    rows = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "'assistant' AS role", "concat('t', id, '<|') AS text")
    rows = rows.union(spark.range(20_000).selectExpr("2L", "id", "if(id % 2 = 0, 'user', 'assistant')", "concat('t', id)"))
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(chat.collect_turns(rows))).collect()}
    for c, loss in ((1, "".join(f"t{k}<|" for k in range(20_000))), (2, "".join(f"t{k}" for k in range(1, 20_000, 2)))):
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (20_000, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_ties(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s")]
    f = chat.format_turns(chat.collect_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first().formatted
    assert f == "<|start|>system<|text|>s<|end|>\n<|start|>user<|text|>a<|next|>a<|next|>b<|end|>\n"


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(text, items, window=13):
    w, hit, found = plain_words(text), set(), set()
    for i, x in items:
        iw = plain_words(x)
        windows = {tuple(iw[k : k + window]) for k in range(len(iw) - window + 1)} if len(iw) >= window else ({tuple(iw)} if iw else set())
        for q in windows:
            for k in range(len(w) - len(q) + 1):
                if tuple(w[k : k + len(q)]) == q:
                    hit.update(range(k, k + len(q)))
                    found.add(i)
    return len(w), hit, found


@pytest.mark.parametrize("part_words", [2_000_000, 20])
def test_contamination(spark, part_words, monkeypatch):
    monkeypatch.setattr(contamination, "PART_WORDS", part_words)
    rng = random.Random(3)
    for letters in ("ab", "abcdefgh"):
        items = [(i, None if i == 7 else " ".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 12, 13, 14, 40])))) for i in [*range(9), 3, None]]
        texts = [" ".join([*(rng.choice(letters + "Zé") for _ in range(rng.randint(0, 40))), (rng.choice(items)[1] or "").upper(), "q" * rng.randint(0, 2)]) for _ in range(40)] + awkward()
        docs, bench = table(spark, texts), spark.createDataFrame(items, "item_id long, text string")
        rows = {r.doc_id: r for r in contamination.measure(docs, bench).collect()}
        for i, t in enumerate(texts):
            n, hit, found = brute_hits(t, items)
            names = sorted(str(x) for x in found if x is not None)
            assert (rows[i].n_words, rows[i].n_hit, rows[i].n_items) == (n, len(hit), len(names))
            assert rows[i].items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
            assert rows[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
        kept = contamination.decontaminate(docs, bench)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {i for i in range(len(texts)) if not rows[i].contaminated}
        assert contamination.measure(docs, bench.limit(0)).filter("n_hit > 0").count() == 0 and contamination.measure(docs.limit(0), bench).count() == 0


def test_cut_removes_only_hit_words():
    item = " ".join(f"t{k}" for k in range(14))
    part = contamination.Benchmark([("1", contamination.words(item))])
    cut = lambda t: contamination.cut(t, *contamination.scan(t, part)[:2])
    long = "Start here. " + " ".join(f"w{k}" for k in range(600))
    assert cut(f"{long} {item.upper()}, end.") == f"{long} , end."
    assert cut(item) is None and cut("clean") == "clean"


def test_one_part_of_the_benchmark_at_a_time(spark, monkeypatch):
    """Parts hold no more words than they may, an item longer than a part included, and every window lies in one of them."""
    monkeypatch.setattr(contamination, "PART_WORDS", 30)
    items = [(1, " ".join(f"a{k}" for k in range(100))), (2, "b1 b2"), (3, None), (4, " ".join(f"c{k}" for k in range(29)))]
    seen, windows = [], set()
    for part in contamination.load(spark.createDataFrame(items, "item_id long, text string").coalesce(1)):
        seen.append(part)
        assert len(part.vocabulary) <= 30
    back = lambda p, x: contamination.scan(x, p)[1]
    for k in range(88):
        window = " ".join(f"a{j}" for j in range(k, k + 13))
        windows.add(any(back(p, window) == [(0, 13)] for p in seen))
    assert windows == {True} and len(seen) > 4
    docs = spark.createDataFrame([(1, items[0][1], "x", 5, 7)], "doc_id long, text string, spans string, Items int, n_chars long")
    assert contamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "x" * 1500), (2, "http://b", "x" * 1500), (3, None, "x" * 1500), (4, "u\r\nv", "y"), (5, "u", "y"), (6, "u", None), (7, "é", "é" * 200_000), (8, "q", "é" * 200_000), (None, "z", "x" * 1500), (9, "w", "WARC/1.1\r\n\r\n" * 90), (9, "w", "WARC/1.1\r\n\r\n" * 90)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload string")
    path = warc.write(pages)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, h in rows:
        best[h] = max(best.get(h, -1), -1 if i is None else i)
    want = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        keeper = best[h] if len(data) >= 1000 and best[h] != (-1 if i is None else i) else None
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if keeper else "response", keeper] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(bytes(r.payload).decode() == next(h or "" for i, _, h in rows if i == r.page_id) for r in got if r.record_type == "response")
    assert warc.read(spark, path).filter("record_type = 'revisit'").count() == 4 == warc.read(spark, path, types="revisit").count()
    assert {r.page_id for r in warc.read(spark, path).filter("page_id IN (4, 5)").collect()} == {4, 5}
    assert warc.read(spark, path, payload="false").filter("payload IS NULL AND payload_bytes IS NULL").count() == len(rows)
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_headers_come_first_and_unwanted_blocks_are_skipped():
    base = {"page_id": 1, "target_uri": "u", "refers_to": None, "record_type": "response"}
    made = [dict(base, page_id=k, payload=bytes([65 + k]) * 50_000, payload_bytes=50_000, payload_digest=hashlib.sha1(bytes([65 + k]) * 50_000).hexdigest()) for k in range(4)]
    for pack in (warc.member, bytes, lambda x: __import__("gzip").compress(x)):
        data = b"".join(pack(warc.record(r, "2024-01-01T00:00:00Z")) for r in made)
        seen = [(h["page-id"], b and len(b) > 50_000) for h, b in warc.records(io.BytesIO(data), lambda h: h["page-id"] == "2")]
        assert seen == [("0", None), ("1", None), ("2", True), ("3", None)]


def foreign(kind, block, *head, eol="\r\n"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:x>", *head, f"Content-Length: {len(block)}", "", ""]
    return eol.join(lines).encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    body = b"some resource of bytes"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    sha = hashlib.sha1(body)
    b32 = base64.b32encode(sha.digest()).decode()
    kinds = [
        foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign("resource", body, "Content-Type: image/png", f"WARC-Payload-Digest: sha1:{sha.hexdigest()}"),
        foreign("response", http, "Content-Type: application/http;", " msgtype=response", f"WARC-Payload-Digest: SHA1:{b32.lower()}", "WARC-Target-URI: http://a/", "\tb"),
        foreign("response", http, "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{b32}"),
        foreign("response", chunked, "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{b32}"),
        foreign("metadata", b"", "WARC-Payload-Digest: md5:abc"),
        foreign("revisit", b"", "Content-Type: application/http"),
    ]
    for name, pack in (("a.warc", bytes), ("b.warc.gz", gzip.compress)):
        (tmp_path / name).write_bytes(b"".join(map(pack, kinds)))
        rows = warc.read(spark, str(tmp_path / name)).collect()
        assert [r.record_type for r in rows] == ["warcinfo", "resource", "response", "response", "response", "metadata", "revisit"]
        assert [r.payload_bytes for r in rows] == [13, 22, 22, 22, 13, 0, None] and bytes(rows[1].payload) == bytes(rows[2].payload) == body
        assert rows[1].payload_digest == rows[2].payload_digest == sha.hexdigest() and rows[2].target_uri == "http://a/ b"
        assert warc.read(spark, str(tmp_path / name), types="resource").count() == 1
        whole = b"".join(map(pack, kinds))
        for cut in (len(whole) - 1, len(whole) - len(pack(kinds[-1])) - 3, len(whole) - len(pack(kinds[-1])) + 20):
            for wanted in (lambda h: True, lambda h: False):
                with pytest.raises(EOFError):
                    list(warc.records(io.BytesIO(whole[:cut]), wanted))
    wrong = foreign("response", http, "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + "0" * 40)
    with pytest.raises(ValueError, match="digest"):
        [warc.row(*x) for x in warc.records(io.BytesIO(wrong), lambda h: True)]


def test_members_that_tell_their_length_are_not_cut_off_unseen():
    base = {"page_id": 1, "target_uri": "u", "refers_to": None, "record_type": "response", "payload": b"x" * 90_000, "payload_bytes": 90_000, "payload_digest": hashlib.sha1(b"x" * 90_000).hexdigest()}
    data = warc.member(warc.record(base, "2024-01-01T00:00:00Z"))
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(data + data[:-5]), lambda h: False))


def brute_scores(texts, order=3, backoff=0.4):
    docs = [(t or "").encode().split() for t in texts]
    grams = [collections.Counter(tuple(d[i - k + 1 : i + 1]) for k in range(1, order + 1) for i in range(k - 1, len(d))) for d in docs]
    every = sum(grams, collections.Counter())
    out = []
    for d, own in zip(docs, grams, strict=True):
        left, n = (lambda g, own=own: every[g] - own[g]), sum(map(len, docs)) - len(d)
        total = 0.0
        for i in range(len(d)):
            p = left((d[i],)) / n if left((d[i],)) else backoff / (n + 1)
            for k in range(2, order + 1):
                if i >= k - 1:
                    g = tuple(d[i - k + 1 : i + 1])
                    p = left(g) / left(g[:-1]) if left(g) else backoff * p
            total += math.log(p)
        out.append((len(d), round(total, 4)))
    return out


def test_lm_scores(spark):
    texts = awkward() + ["a b c d e", "c d e f"]
    got = {r.doc_id: (r.n_words, r.score) for r in lm_scores.score(table(spark, texts)).collect()}
    for i, (n, s) in enumerate(brute_scores(texts)):
        assert got[i][0] == n and abs(got[i][1] - s) < 1e-3
    assert lm_scores.score(table(spark, [])).count() == 0
    assert [(r.doc_id, r.n_words) for r in lm_scores.score(table(spark, ["a", None], [None, None])).collect()] in ([(None, 1), (None, 0)], [(None, 0), (None, 1)])


def test_registered_queries(spark):
    """All eleven run at the smallest size; those with SQL agree with it."""
    import __spark_entry__ as entry

    con, names = duck(SF), [q for q in entry.queries() if re.match(r"op\d+_|pipeline", q)]
    assert len(names) == 11
    for q in names:
        df = entry.queries()[q](spark, SF)
        sql = entry.oracle_sql().get(q)
        assert difference(df, con, sql) == "" if sql else df.count() > 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= n
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs, n = out, out.count()
