"""Near-duplicate documents: a Jaccard join of five-word shingle sets with Bayesian pruning of candidates.

Equal texts are one class, led by the least doc_id. Candidates come from the exact prefix filter of ``set_join``; their MinHash values are
compared a few at a time, and a pair is dropped once the posterior probability (uniform prior) that its similarity reaches the threshold falls
below TOLERANCE. The rest is verified exactly.

A text of one to four words is one shingle of them all; null and wordless texts have none and are like no other text, but equal ones are still a class.
Texts of any length are compared whole, a very long one in a block of its own; an empty table gives an empty result. Repeated rows are copies. Of equal doc_ids the one stored first leads. A null doc_id orders before all others. Other columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.blocks import NO_ID, RECORD_BITS, Marks, ask, distinct, follow, hash_words, mix, pack, ranges, rows_again, unpack, unsqueeze, visit
from broadsheet.llm.set_join import Sets, Threshold, components, forest, members, of_groups, postings, sets_of, units, verify
from broadsheet.operators.graph import connected_components
from broadsheet.storage import materialise

SHINGLE = 5
THRESHOLD = Threshold(4, 5)
HASHES, STEP = 64, 16
TOLERANCE = 1e-9
#: Elements with more postings than this link them in order of size instead of pair by pair; verification is the same.
CHAIN_ABOVE = 512
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ends and distinct shingle hashes of each text."""
    return sets_of(texts, _shingles)


def _shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, n = hash_words(texts)
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    owner = np.repeat(np.arange(len(n)), n)
    size = n[owner]
    now, chosen, hashes = mix(words), size == 1, mix(words)
    for k in range(1, SHINGLE):
        longer = np.zeros_like(now)
        longer[k:] = follow(now[k - 1 : -1], words[k:])
        now = longer
        take = (place >= k) if k == SHINGLE - 1 else (size == k + 1) & (place == k)
        chosen = chosen | take
        hashes[take] = now[take]
    return of_groups(owner[chosen], hashes[chosen], len(n))


def _all(block: dict) -> tuple[np.ndarray, list[bytes], Sets]:
    ids, texts = unpack(block)
    ends, elements = shingles(texts)
    return ids, texts, Sets(np.arange(len(ids)), ends, elements)


def _tell(block: dict):
    ids, texts, sets = _all(block)
    marks = Marks(sets.number, *(np.array([xxhash.xxh64_intdigest(t, seed) for t in texts], np.uint64) for seed in (1, 2)), ids)
    return *distinct(sets.elements), marks


def signature(elements: np.ndarray) -> bytes:
    """MinHash values of one set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 4096):
        least = np.minimum(least, mix(elements[at : at + 4096] ^ _SEEDS[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def fewest_matches(compared: int, threshold: Threshold = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Least matches among so many compared values at which the posterior P(similarity >= threshold) is not below the tolerance.

    With a uniform prior, that posterior is P(X <= matches) for a binomial X of compared + 1 trials.
    """
    t, below = threshold.num / threshold.den, 0.0
    for m in range(compared + 1):
        below += math.comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
        if below >= tolerance:
            return m
    return compared


_FEWEST = [fewest_matches(k) for k in range(STEP, HASHES + 1, STEP)]


def _plausible(rows: dict, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(b"".join(rows["signature"]), "<u4").reshape(-1, HASHES)
    matches = np.zeros(len(left), np.int64)
    for k, fewest in enumerate(_FEWEST):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (values[left, part] == values[right, part]).sum(axis=1)
        keep = matches >= fewest
        left, right, matches = left[keep], right[keep], matches[keep]
    return left, right


def _describe(block: dict, numbers: np.ndarray) -> dict:
    _, texts = unpack(block)
    ends, elements = shingles([texts[i] for i in numbers.tolist()])
    parts = np.split(elements, ends[:-1])
    return {"size": np.array([len(p) for p in parts], np.int32), "elements": pa.array([p.tobytes() for p in parts], pa.binary()), "signature": pa.array([signature(p) for p in parts], pa.binary())}


def _digest(rows: dict, left: np.ndarray, right: np.ndarray) -> pa.Table:
    record = rows["record"]
    n = np.bincount(np.concatenate([left, right]), minlength=len(record))
    root = record[forest(left, right, len(record))]
    keep = n > 0
    return pa.table({"record": record[keep], "n_links": n[keep], "root": root[keep]})


def _record_ids(batches):
    for b in batches:
        for r in b.to_pylist():
            ids = np.frombuffer(r["ids"], "<i8")
            yield pa.RecordBatch.from_pydict({"record": r["block"] << RECORD_BITS | np.arange(len(ids)), "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID)})


def _owners_of(batches):
    for b in batches:
        for r in b.to_pylist():
            record = r["block"] << RECORD_BITS | unsqueeze(r["at"]).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"record": record, "owner": np.frombuffer(r["owner"], "<i8"), "class_id": np.frombuffer(r["owner_id"], "<i8")})


def _grouped(packed: DataFrame, threshold: Threshold) -> DataFrame:
    """record, owner (record that leads the class), class_id, n_links, group_id, leader (record that leads the group)."""
    answers = materialise(ask(packed, _tell, least=2), "answers")
    bits = ranges(packed)
    posted = postings(packed, answers, lambda block: _all(block)[2], threshold, bits)
    found = components(posted, bits, threshold, CHAIN_ABOVE)
    records = members(packed, found, _describe, ", signature binary")
    verified = materialise(verify(units(records, found), threshold, _plausible, _digest, "record long, n_links long, root long"), "links")
    links = verified.groupBy("record").agg(F.sum("n_links").alias("n_links"))
    groups = connected_components(verified, "record", "root").select(F.col("node").alias("owner"), "component")
    mine = answers.filter("kind = 'own'").select("block", "at", "owner", "owner_id").mapInArrow(_owners_of, "record long, owner long, class_id long")
    least = groups.join(mine.filter("record = owner"), "owner").groupBy("component").agg(F.min(F.struct("class_id", "record")).alias("least"))
    by_class = links.withColumnRenamed("record", "owner").join(groups, "owner").join(least, "component").drop("component")
    linked = mine.join(by_class, "owner", "left")
    return linked.select("record", "owner", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least.class_id", "class_id").alias("group_id"), F.coalesce("least.record", "owner").alias("leader"))


def near_duplicates(docs: DataFrame, threshold: Threshold = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of equal texts), n_links (other classes that are near duplicates of this one), group_id (the least
    class_id that links lead to), stays (this row stands for its group)."""
    packed = pack(docs)
    grouped = _grouped(packed, threshold)
    ids = packed.select("block", "ids").mapInArrow(_record_ids, "record long, doc_id long")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return ids.join(grouped, "record").select("doc_id", known("class_id"), "n_links", known("group_id"), (F.col("record") == F.col("leader")).alias("stays"))


def one_of_each_group(docs: DataFrame, threshold: Threshold = THRESHOLD) -> DataFrame:
    """The rows of docs that stand for their groups, all columns as they were."""
    packed = pack(docs, whole=True)
    stays = _grouped(packed, threshold).filter("record = leader").select(F.shiftright("record", RECORD_BITS).alias("block"), "record")
    schema = docs.schema

    def use(block: dict, got: list[dict]) -> pa.Table:
        numbers = np.sort(np.array([r["record"] for r in got], np.int64) & ((1 << RECORD_BITS) - 1))
        return rows_again(block, schema).take(pa.array(numbers))

    return visit(packed, stays, use, docs._jdf.schema().toDDL())
