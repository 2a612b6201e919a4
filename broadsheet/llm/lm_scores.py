"""Stupid-backoff language-model scores, each document scored by the n-gram counts of all the others.

Tables of n-gram counts, partitioned by hash, are joined to the documents' n-grams (both sides in blocks, see ``blocks``), and the logarithms summed per document.
S(w | context) is count(context w) / count(context) where the numerator is above 0, else BACKOFF times S(w | context without its first word);
below unigrams stands BACKOFF / (N + 1) for a word that no other document has. N: words of the other documents. Counts leave the document's own
occurrences out; the first words of a document have shorter contexts.

Null and wordless texts: no words, score 0. Repeated rows are documents of their own (equal texts support each other). Null doc_ids stay null. Texts of any
length are scored whole. An empty table gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.blocks import NO_ID, ask, distinct, follow, hash_words, mix, pack, places, spread, unpack, visit

ORDER = 3
BACKOFF = 0.4
_SEEDS = [np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)]


def grams(words: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order k the hashes of the k-grams that end at each word; 0 where the document has fewer words before."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    out = [mix(words ^ _SEEDS[0])]
    for k in range(1, order):
        longer = np.zeros_like(words)
        longer[k:] = follow(out[-1][k - 1 : -1], words[k:])
        longer[place < k] = 0
        out.append(longer)
    return out


def _keys(order: int):
    def keys(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate(grams(*hash_words(texts), order))
        return distinct(every[every != 0])

    return keys


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, score (sum of natural logarithms, 4 decimals)."""
    keys = _keys(order)
    packed = pack(docs)
    sums = packed.mapInArrow(_count_words, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()
    every = int(sums[0])

    def use(block: dict, answers: list[dict]) -> pa.Table:
        ids, texts = unpack(block)
        words, n = hash_words(texts)
        del texts
        doc = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        found = grams(words, n, order)
        real = [g != 0 for g in found]
        known, at = places(np.concatenate([g[r] for g, r in zip(found, real, strict=True)]))
        total = spread(answers, known)[at]
        left, end = [], 0
        for g, r in zip(found, real, strict=True):
            count = np.zeros(len(g), np.int64)
            count[r] = total[end : (end := end + int(r.sum()))]
            shared = np.flatnonzero(count > 1)  # others can only have it then
            pair = mix(g[shared] + mix(doc[shared].astype(np.uint64) + _SEEDS[1]))
            _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
            others = np.zeros(len(g), np.int64)
            others[shared] = count[shared] - own[back]
            left.append(others)
        rest = (every - n)[doc]
        value = np.where(left[0] > 0, left[0] / np.maximum(rest, 1), backoff / (rest + 1))
        for k in range(1, order):
            context = np.zeros(len(words), np.int64)
            context[1:] = left[k - 1][:-1]
            seen = left[k] / np.maximum(context, 1)
            value = np.where(place < k, value, np.where(left[k] > 0, seen, backoff * value))
        ends = np.cumsum(n)
        sums = np.zeros(len(n))
        full = np.flatnonzero(n)
        if len(full):
            sums[full] = np.add.reduceat(np.log(value), (ends - n)[full])
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "n_words": pa.array(n, pa.int64()), "score": np.round(sums, 4) + 0.0})

    return visit(packed, ask(packed, lambda r: (*keys(*unpack(r)), None), least=2), use, "doc_id long, n_words long, score double")


def _count_words(batches):
    for b in batches:
        for r in b.to_pylist():
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(t.split()) for t in unpack(r)[1])], pa.int64())})


SQL = f"""
WITH words AS (
  SELECT k, i, w FROM (
    SELECT doc_id AS k, regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') AS ws FROM documents) AS d,
    unnest(ws) WITH ORDINALITY AS u (w, i) WHERE w <> ''),
g AS (SELECT k, i, w, lag(w) OVER p AS v, lag(w, 2) OVER p AS u FROM words WINDOW p AS (PARTITION BY k ORDER BY i)),
c1 AS (SELECT w, count(*) AS c FROM g GROUP BY w),
o1 AS (SELECT k, w, count(*) AS c FROM g GROUP BY k, w),
c2 AS (SELECT v, w, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT k, v, w, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY k, v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM g WHERE u IS NOT NULL GROUP BY u, v, w),
o3 AS (SELECT k, u, v, w, count(*) AS c FROM g WHERE u IS NOT NULL GROUP BY k, u, v, w),
size AS (SELECT k, count(*) AS n, sum(count(*)) OVER () AS n_all FROM g GROUP BY k),
left_over AS (
  SELECT g.k, g.i, s.n_all - s.n AS rest, c1.c - o1.c AS w1, p1.c - q1.c AS v1, c2.c - o2.c AS w2, p2.c - q2.c AS v2, c3.c - o3.c AS w3
  FROM g JOIN size AS s USING (k)
  JOIN c1 ON c1.w = g.w JOIN o1 ON o1.k = g.k AND o1.w = g.w
  LEFT JOIN c1 AS p1 ON p1.w = g.v LEFT JOIN o1 AS q1 ON q1.k = g.k AND q1.w = g.v
  LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w LEFT JOIN o2 ON o2.k = g.k AND o2.v = g.v AND o2.w = g.w
  LEFT JOIN c2 AS p2 ON p2.v = g.u AND p2.w = g.v LEFT JOIN o2 AS q2 ON q2.k = g.k AND q2.v = g.u AND q2.w = g.v
  LEFT JOIN c3 ON c3.u = g.u AND c3.v = g.v AND c3.w = g.w LEFT JOIN o3 ON o3.k = g.k AND o3.u = g.u AND o3.v = g.v AND o3.w = g.w),
s1 AS (SELECT *, CASE WHEN w1 > 0 THEN w1 / greatest(rest, 1)::DOUBLE ELSE {BACKOFF} / (rest + 1)::DOUBLE END AS p FROM left_over),
s2 AS (SELECT * REPLACE (CASE WHEN w2 IS NULL THEN p WHEN w2 > 0 THEN w2 / v1::DOUBLE ELSE {BACKOFF} * p END AS p) FROM s1),
s3 AS (SELECT k, CASE WHEN w3 IS NULL THEN p WHEN w3 > 0 THEN w3 / v2::DOUBLE ELSE {BACKOFF} * p END AS p FROM s2),
sums AS (SELECT k, count(*) AS n, sum(ln(p)) AS s FROM s3 GROUP BY k)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(s, 0), 4)::DOUBLE AS score
FROM documents AS d LEFT JOIN sums ON k = doc_id
"""
