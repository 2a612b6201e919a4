"""Token ids in Huffman-coded files: canonical, length-limited codes from global counts, in blocks that decode alone.

File format (a Parquet folder that Spark writes and commits, so that lost executors and stores are its business):
``blocks``: one row per block of whole documents in ascending doc_id order: ``start`` (ids of all blocks before), ``doc_ids``, ``sizes`` (ids
per document), ``marks`` (uint32 bit offsets of every CHECKPOINT-th id) and ``payload`` (bits, most significant first);
``codebook``: one row with the code length of every id (one byte each), from which the canonical codes follow.

Null texts count as empty; each document gets its end id. Rows of equal doc_id come in the order of their texts' hashes. Null doc_ids come first. A text of any
length is one document, whose ids lie whole in one block. Repeated rows are documents of their own. Empty tables give files without blocks. Other columns
don't matter, whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from broadsheet.llm.bpe import Vocabulary, vocabulary
from broadsheet.storage import discard, materialise

LIMIT = 20
BLOCK_IDS = 1 << 18
CHECKPOINT = 128
#: Pieces that a worker remembers the library's answer to.
MEMO_ENTRIES = 1_200_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    items = counts[used].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        both = np.concatenate([items, packages])
        order = np.argsort(both, kind="stable")
        levels.append(np.cumsum(order < len(items)))
        both = both[order]
        packages = both[0 : len(both) // 2 * 2 : 2] + both[1::2]
    take, depth = 2 * len(items) - 2, np.zeros(len(items), np.uint8)
    for singles in reversed(levels):
        k = int(singles[take - 1]) if take else 0
        depth[:k] += 1
        take = 2 * (take - k)
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by ascending length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == n)
        code <<= n - last
        codes[ids] = code + np.arange(len(ids))
        code, last = code + len(ids), n
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and marks of one block."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    start = end - n
    marks = start[::CHECKPOINT].astype("<u4" if not len(end) or end[-1] < 1 << 32 else "<u8").tobytes()
    if not len(ids):
        return b"", b""
    shift = 64 - (start & 31) - n  # a code of at most 32 bits begins in a 32-bit cell and may end in the next one
    wide = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    cell = start >> 5
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    out = np.zeros(int(end[-1] - 1 >> 5) + 2, np.uint32)
    at = cell[first]
    out[at] = np.add.reduceat(wide >> np.uint64(32), first)
    out[at + 1] |= np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first).astype(np.uint32)
    return out.astype(">u4").tobytes()[: int(end[-1] + 7 >> 3)], marks


def decoding_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Width in bits, and for each value of so many next bits the id and its code's length."""
    width = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (width - lengths[used].astype(np.int64))
    ids, bits = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    ids[: spans.sum()], bits[: spans.sum()] = np.repeat(used, spans), np.repeat(lengths[used], spans)
    return width, ids, bits


def unpack(payload: bytes, marks: bytes, n: int, table: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a block: all its checkpoints advance together, one id a step."""
    width, ids, bits = table
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    lanes = -(-n // CHECKPOINT)
    at = np.frombuffer(marks, "<u4" if len(marks) == 4 * lanes else "<u8").astype(np.int64)
    out = np.empty((lanes, CHECKPOINT), np.uint32)
    down, last = np.uint32(32 - width), len(window) - 1
    for k in range(CHECKPOINT):
        key = window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32) >> down
        out[:, k] = ids[key]
        at += bits[key]
    return out.reshape(-1)[:n]


def _places_of_none(values: list) -> Iterator[int]:
    k = -1
    try:
        while True:
            yield (k := values.index(None, k + 1))
    except ValueError:
        return


class LibraryIds:
    """Ids as the tokenizers library gives them; pieces that occurred before come from a memo of its answers."""

    def __init__(self, path: str):
        self.v: Vocabulary = vocabulary(path)
        self.library, self.memo = Tokenizer.from_file(path), {}
        self.model = self.library.model
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = "H" if self.v.dtype.itemsize == 2 else "I"

    def _ask(self, piece: str) -> bytes:
        """The library's merges of one piece, in the characters that stand for its bytes."""
        shown = "".join(map(self.v.alphabet.__getitem__, piece.encode()))
        return array(self.kind, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        known, found, gaps, wanted = self.memo.get, [], [], set()
        for t in texts:
            if any(a in t for a in self.v.added):  # the library cuts added tokens out first
                found.append([array(self.kind, self.library.encode(t, add_special_tokens=False).ids).tobytes()])
                continue
            pieces = self.v.pieces(t)
            packed = list(map(known, pieces))
            gaps.append((packed, holes := [(k, pieces[k]) for k in _places_of_none(packed)]))
            wanted.update(p for _, p in holes)
            found.append(packed)
        answers = {p: self._ask(p) for p in wanted}
        for packed, holes in gaps:
            for k, p in holes:
                packed[k] = answers[p]
        if len(self.memo) < MEMO_ENTRIES:
            self.memo.update(answers)
        return [b"".join(x) for x in found]


@functools.lru_cache(2)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


def tokenise(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """part, at (ids before in that part), doc_id, n, ids (packed): parts and their rows ascend by doc_id.

    A last row of each part has no ids but counts: how often it has each id (packed int64).
    """
    size = max(len(vocabulary(path).bytes_of), end_id + 1)

    def run(batches):
        encode, part, at = library_ids(path), TaskContext.get().partitionId(), 0
        end, dtype = np.array([end_id], encode.v.dtype).tobytes(), encode.v.dtype
        total = np.zeros(size, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                b = batch.slice(k, 128)
                ids = [x + end for x in encode([t or "" for t in b["text"].to_pylist()])]
                total += np.bincount(np.frombuffer(b"".join(ids), dtype), minlength=size)
                n = np.array([len(x) // dtype.itemsize for x in ids], np.int64)
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(ids), pa.int32()), "at": before, "doc_id": b["doc_id"], "n": n, "ids": pa.array(ids, pa.binary()), "counts": pa.nulls(len(ids), pa.binary())})
        if at:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "at": pa.nulls(1, pa.int64()), "doc_id": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "ids": pa.nulls(1, pa.binary()), "counts": pa.array([total.tobytes()], pa.binary())})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "part int, at long, doc_id long, n long, ids binary, counts binary")


def count_ids(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs. What reaches the driver is bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b["counts"]:
                total += np.frombuffer(x.as_buffer(), np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int32()), "n": total[used]})

    counts = np.zeros(size, np.int64)
    parts = ids.filter("counts IS NOT NULL").select("counts")
    for i, n in parts.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        counts[i] = n
    return counts


def write(docs: DataFrame, path: str, end_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """Encode every document and write the files; the two tables read back: blocks, codebook."""
    spark, v = docs.sparkSession, vocabulary(path)
    size, dtype = max(len(v.bytes_of), end_id + 1), v.dtype.str
    rows = materialise(tokenise(docs, path, end_id), "ids", "snappy")  # ids hardly get smaller, so the cheaper codec
    lengths = code_lengths(count_ids(rows, size))
    ids = rows.filter("counts IS NULL").drop("counts")
    codebook = materialise(spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary"), "codebook")
    totals = ids.groupBy("part").agg(F.sum("n").alias("n"))
    base = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))  # a row per part

    def run(batches):
        codes = canonical_codes(lengths)
        held, n, first, due = [], 0, 0, 0

        def block():
            payload, marks = pack(np.concatenate([x for _, x in held]), lengths, codes)
            return pa.RecordBatch.from_pydict({
                "start": pa.array([first], pa.int64()), "doc_ids": pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
                "sizes": pa.array([[len(x) for _, x in held]], pa.list_(pa.int64())), "marks": pa.array([marks], pa.binary()), "payload": pa.array([payload], pa.binary()),
            })

        for b in batches:
            for d, start, x in zip(b["doc_id"].to_pylist(), b["start"].to_pylist(), b["ids"], strict=True):
                x = np.frombuffer(x.as_buffer(), dtype)
                if held and (start != due or n + len(x) > BLOCK_IDS):
                    yield block()
                    held, n = [], 0
                if not held:
                    first = start
                held.append((d, x))
                n, due = n + len(x), start + len(x)
        if held:
            yield block()

    placed = ids.join(base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "ids")
    blocks = materialise(placed.mapInArrow(run, "start long, doc_ids array<long>, sizes array<long>, marks binary, payload binary"), "blocks")
    discard(rows)
    return blocks, codebook


def _decoded(blocks: DataFrame, codebook: DataFrame, kind: pa.DataType, of_slice, schema: str) -> DataFrame:
    """doc_id, start, n_tokens, and of_slice(ids as little-endian uint32) of every document in the files."""
    lengths = np.frombuffer(bytes(codebook.first()["lengths"]), np.uint8)  # one row, bounded by the vocabulary

    def run(batches):
        table = decoding_table(lengths)
        for b in batches:
            for r in b.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                ids = unpack(r["payload"], r["marks"], int(sizes.sum()), table).astype("<u4")
                ends = np.cumsum(sizes)
                found = [of_slice(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + ends - sizes), pa.array(sizes), pa.array(found, kind)], ["doc_id", "start", "n_tokens", "found"])

    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, found {schema}")


def read(blocks: DataFrame, codebook: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of every document in the files."""
    return _decoded(blocks, codebook, pa.binary(), lambda ids: ids.tobytes(), "binary").withColumnRenamed("found", "ids")


def digest(blocks: DataFrame, codebook: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; the ids stay where they are decoded."""
    return _decoded(blocks, codebook, pa.int64(), zlib.crc32, "long").withColumnRenamed("found", "ids_crc32")
