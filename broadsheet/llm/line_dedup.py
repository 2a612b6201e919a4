"""Line dedup by an exact set-similarity join: lines whose word sets are similar (Jaccard) to those of an earlier line go.

Lines are what lies between \\n; their words are runs of anything but ASCII white space, their order is (doc_id, place stored, line). A line goes if any
earlier line of the corpus, one that goes itself included, reaches the threshold. Lines of fewer than `least` distinct words stay and remove
nothing: the query and the pipeline pass 1, so that only lines without words stay; LEAST_WORDS is the functions' default. Lines with equal word
sets are settled first: the earliest owns the set, the others go; owners meet in ``set_join``, but those too small to be similar to any other set.

Null texts stay null, and texts without removed lines stay as they were. A text all of whose lines go becomes empty. Repeated rows are
documents of their own, so the later one loses its lines. A null doc_id comes before all others. Other columns don't matter, but come along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.blocks import NO_ID, RECORD_BITS, Marks, ask, distinct, hash_words, mix, pack, ranges, rows_again, shrink, spread, stretch, unpack, visit
from broadsheet.llm.set_join import Sets, Threshold, components, members, of_groups, postings, sets_of, units, verify
from broadsheet.storage import materialise

LEAST_WORDS = 3
THRESHOLD = Threshold(4, 5)


def lines(texts: list[bytes], least: int = LEAST_WORDS) -> tuple[list[bytes], np.ndarray]:
    """All lines that may have `least` distinct words, and the text that each is from."""
    found, owner = [], []
    for i, t in enumerate(texts):
        mine = [x for x in t.split(b"\n") if len(x.split(None, least)) >= least]
        found += mine
        owner += [i] * len(mine)
    return found, np.array(owner, np.int64)


def _sets(found: list[bytes]) -> Sets:
    def make(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words, n = hash_words(some)
        return of_groups(np.repeat(np.arange(len(n)), n), words, len(n))

    return Sets(np.arange(len(found)), *sets_of(found, make))


def _pick(sets: Sets, keep: np.ndarray) -> Sets:
    return Sets(sets.number[keep], np.cumsum(sets.sizes[keep]), sets.elements[np.repeat(keep, sets.sizes)])


def _all(block: dict, least: int) -> tuple[np.ndarray, Sets]:
    """The ids of the lines that have enough words, and their sets; numbers count all lines found."""
    ids, texts = unpack(block)
    found, owner = lines(texts, least)
    sets = _sets(found)
    enough = sets.sizes >= least
    return ids[owner][enough], Sets(sets.number[enough], np.cumsum(sets.sizes[enough]), sets.elements[np.repeat(enough, sets.sizes)])


def _tell(block: dict, least: int):
    ids, sets = _all(block, least)
    starts = sets.ends - sets.sizes
    mark = lambda seed: np.add.reduceat(mix(sets.elements ^ np.uint64(seed)), starts) if len(starts) else np.empty(0, np.uint64)
    return *distinct(sets.elements), Marks(sets.number, mark(0xA4093822299F31D0), mark(0x082EFA98EC4E6C89), ids)


def _describe(block: dict, numbers: np.ndarray, least: int) -> dict:
    ids, texts = unpack(block)
    found, owner = lines(texts, least)
    sets = _sets([found[i] for i in numbers.tolist()])
    parts = np.split(sets.elements, sets.ends[:-1])
    return {"size": sets.sizes.astype(np.int32), "elements": pa.array([p.tobytes() for p in parts], pa.binary()), "id": ids[owner[numbers]]}


def _later(rows: dict, left: np.ndarray, right: np.ndarray) -> pa.Table:
    """The later line of each pair."""
    record, ids = rows["record"], rows["id"]
    swap = (ids[left] > ids[right]) | ((ids[left] == ids[right]) & (record[left] > record[right]))
    return pa.table({"record": np.unique(record[np.where(swap, left, right)])})


def _removed(packed: DataFrame, threshold: Threshold, least: int) -> DataFrame:
    """block, kind, at, value (of all lines with enough words, 1 where it owns its set), record (an owner that goes all the same)."""
    answers = materialise(ask(packed, lambda block: _tell(block, least), least=2), "answers")
    bits = ranges(packed)
    posted = postings(packed, answers, lambda block: _all(block, least)[1], threshold, bits, threshold.smallest())
    found = components(posted, bits, threshold)
    dealt = units(members(packed, found, lambda block, numbers: _describe(block, numbers, least), ", id long"), found)
    gone = verify(dealt, threshold, lambda rows, a, b: (a, b), _later, "record long").distinct()
    own = answers.filter("kind = 'own'").select("block", "kind", "at", "value", F.lit(None).cast("long").alias("record"))
    return own.unionByName(gone.select(F.shiftright("record", RECORD_BITS).alias("block"), F.lit("gone").alias("kind"), F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("value"), "record"))


def _kept(block: dict, got: list[dict], least: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Ids, texts without removed lines, lines and removed lines of each."""
    ids, texts = unpack(block)
    found, owner = lines(texts, least)
    gone = spread([{**r, "value": _flip(r["value"])} for r in got if r["kind"] == "own"], len(found), "own") > 0
    gone[np.array([r["record"] & ((1 << RECORD_BITS) - 1) for r in got if r["kind"] == "gone"], np.int64)] = True
    n = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    less = np.bincount(owner[gone], minlength=len(texts))
    flags = np.split(gone, np.flatnonzero(np.diff(owner)) + 1) if len(owner) else []
    by_text = dict(zip(owner[np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])].tolist(), flags, strict=True)) if len(owner) else {}
    out = list(texts)
    for i in np.flatnonzero(less).tolist():
        left, k = [], 0
        for x in texts[i].split(b"\n"):
            if len(x.split(None, least)) >= least:
                k += 1
                if by_text[i][k - 1]:
                    continue
            left.append(x)
        out[i] = b"\n".join(left)
    return ids, out, n, less


def _flip(value: bytes) -> bytes:
    return shrink(1 - stretch(value).astype(np.int64))


def dedup_lines(docs: DataFrame, threshold: Threshold = THRESHOLD, least: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs without removed lines; n_chars, if there, follows the text."""
    packed = pack(docs, whole=True)
    schema = docs.schema
    out = visit(packed, _removed(packed, threshold, least), lambda block, got: rows_again(block, schema, _kept(block, got, least)[1]), docs._jdf.schema().toDDL())
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def measure_lines(docs: DataFrame, threshold: Threshold = THRESHOLD, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars, text_sha256 (of what stays; a null text counts as empty)."""
    packed = pack(docs)

    def use(block: dict, got: list[dict]) -> pa.Table:
        ids, texts, n, less = _kept(block, got, least)
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "n_lines": n, "n_removed": less, "kept_chars": pa.array([len(t.decode()) for t in texts], pa.int64()), "text_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())})

    return visit(packed, _removed(packed, threshold, least), use, "doc_id long, n_lines long, n_removed long, kept_chars long, text_sha256 string")
