"""Key counts over a corpus without a row per key: documents in blocks, keys in sorted arrays, an exchange by hash range.

``pack`` lays documents into blocks of bounded size, each a row. ``ask`` lets every block send its distinct keys (64-bit hashes, with counts) to the
tables of their hash ranges, which add them up and answer each block with the totals of its keys. ``visit`` brings blocks and answers
together. A key has one entry in each block that holds it, however often it occurs there, so frequent keys don't skew any range. Work in memory is bounded
by a block, or by a hash range, whose number grows with that of the blocks.
"""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from broadsheet.storage import discard, materialise, new_path

BLOCK_BYTES = 8 << 20
#: What a text counts in a block besides its bytes.
ROW_BYTES = 16
#: Bits for a record's number within its block (a string has fewer than 2^31 bytes, so fewer lines), for a block's within its task, and for the task's.
RECORD_BITS, PLACE_BITS, TASK_BITS = 31, 12, 20
PACKED = "block long, ids binary, sizes binary, texts binary, rows binary"
BLOCK = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "sizes", "texts", "rows"))])
#: Stands for a null doc_id, before all others.
NO_ID = -(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: Words of more bytes than this are hashed one by one.
_PLACES = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
HASH_BYTES = 1 << 16


def _hash_buffer(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a buffer: eight bytes of all words at a time."""
    padded = b" " + data + b" " * 8
    solid = _SOLID[np.frombuffer(padded, np.uint8)]
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    value = mix((eight[start + 1] & _MASKS[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64) + np.uint64(0x13198A2E03707344)))
    far, at = np.flatnonzero(size > 8), 8
    while len(far) and at < _PLACES:
        value[far] = follow(value[far], eight[start[far] + 1 + at] & _MASKS[np.minimum(size[far] - at, 8)])
        at += 8
        far = far[size[far] > at]
    for k in far.tolist():
        value[k] = xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]])
    return start, value


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of anything but ASCII white space) of all texts, and each text's number of words."""
    hashes, n = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
    held, at, size = [], 0, 0

    def flush(end: int) -> None:
        nonlocal held, at, size
        start, h = _hash_buffer(b"\n".join(held))
        hashes.append(h)
        offsets = np.cumsum([0, *(len(t) + 1 for t in held)])
        n[at:end] = np.diff(np.searchsorted(start, offsets))
        held, at, size = [], end, 0

    for i, t in enumerate(texts):
        if len(t) > HASH_BYTES:  # in parts that end between words
            flush(i)
            p = 0
            while p < len(t):
                q = min(p + HASH_BYTES, len(t))
                while q < len(t) and _SOLID[t[q]]:
                    q += 1
                _, h = _hash_buffer(t[p:q])
                hashes.append(h)
                n[i] += len(h)
                p = q
            at = i + 1
            continue
        held.append(t)
        size += len(t)
        if size > HASH_BYTES:
            flush(i + 1)
    flush(len(texts))
    return np.concatenate(hashes), n


def follow(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of sequences one word longer."""
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + word)


def squeeze(sorted_keys: np.ndarray) -> bytes:
    """Ascending numbers as the byte planes of their differences, compressed."""
    d = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def shrink(x: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed; a first byte says how many planes there are."""
    width = 4 if not len(x) or int(x.max()) < 1 << 32 else 8
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def stretch(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1)


def pack(docs: DataFrame, whole: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents into blocks, a table bucketed by block: later visits don't move the texts again.

    A null doc_id counts as NO_ID, a null text as empty; whole: the rows come along, for ``rows_again``. A text larger than a block is a block
    of its own; every text counts ROW_BYTES besides its own, so that blocks of empty texts end, too. Block numbers leave RECORD_BITS bits for the records
    of a block, as many as the longest string has lines. The table is not left in the catalog, its files in the shared folder go with the session.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").cast("binary").alias("text"), *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if whole else []))

    def run(batches):
        give_back()
        task, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            if task >> TASK_BITS or k >> PLACE_BITS:
                raise OverflowError(f"block {k} of task {task} has no number: more, smaller tasks or larger blocks are needed")
            t = pa.Table.from_batches(held)
            text = pa.concat_arrays([*t["text"].chunks, pa.array([], t["text"].type)])
            sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype("<i8")
            squash = zstandard.ZstdCompressor(level=3).compress
            packed = {"block": task << PLACE_BITS | k, "ids": t["id"].to_numpy().astype("<i8").tobytes(), "sizes": sizes.tobytes(), "texts": squash(_joined(text)), "rows": squash(_stream(t["row"])) if whole else None}
            return pa.RecordBatch.from_pylist([packed], BLOCK)

        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False)
            first = 0
            for at, n in enumerate((sizes + ROW_BYTES).tolist()):
                if size and size + n > block_bytes:
                    held.append(b.slice(first, at - first))
                    yield block()
                    k, held, size, first = k + 1, [], 0, at
                size += n
            held.append(b.slice(first))
        if any(h.num_rows for h in held):
            yield block()
        held = []
        give_back()

    blocks = materialise(rows.mapInArrow(run, PACKED), "blocks")
    spark, n = docs.sparkSession, max(1, min(blocks.count(), 100_000))
    name, path = f"blocks_{uuid.uuid4().hex}", new_path(spark, "blocks")
    blocks.repartition(n, "block").write.format("parquet").bucketBy(n, "block").option("compression", "none").option("path", path).saveAsTable(name)
    discard(blocks)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of an external table only the entry goes; the plan has its files and buckets by now
    return table


def _joined(text: pa.Array) -> pa.Buffer | bytes:
    """All texts end to end, where they lie."""
    offsets, data = text.buffers()[1:]
    first, last = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(text.type) else np.int32)[[text.offset, text.offset + len(text)]].tolist() if len(text) else (0, 0)
    return data.slice(first, last - first) if last > first else b""


def _stream(rows: pa.ChunkedArray) -> bytes:
    """Rows but their texts, which the block has already."""
    t = pa.table({str(k): f for k, f in enumerate(rows.combine_chunks().flatten() if rows.num_chunks != 1 else rows.chunk(0).flatten())})
    names = [f.name for f in rows.type]
    t = t.set_column(names.index("text"), str(names.index("text")), pc.is_null(t[names.index("text")]))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def rows_again(block: dict, schema: StructType, texts: list[bytes] | None = None) -> pa.Table:
    """The rows of a block packed whole, with other texts if given; null texts stay null."""
    t = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(block["rows"])).read_all()
    place = schema.fieldNames().index("text")
    texts = unpack(block)[1] if texts is None else texts
    back = pa.array([None if gone else x for gone, x in zip(t[place].to_pylist(), texts, strict=True)], pa.binary()).cast(pa.string())
    target = to_arrow_schema(schema)
    return pa.Table.from_arrays([back if k == place else t[k] for k in range(len(target))], target.names).cast(target)


def unpack(row: dict) -> tuple[np.ndarray, list[bytes]]:
    sizes = np.frombuffer(row["sizes"], "<i8")
    raw, ends = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=int(sizes.sum())) if sizes.sum() else b"", np.cumsum(sizes).tolist()
    return np.frombuffer(row["ids"], "<i8"), [raw[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]


def ascending(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of 64-bit hashes, and the hashes in it: their high bits are sorted with the places in the low ones, which is
    much faster than sorting places; if hashes agree in their high bits and come out of order, places are sorted after all."""
    low = np.uint64(len(keys).bit_length())
    packed = keys >> low << low | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    s = keys[order]
    if (s[1:] < s[:-1]).any():
        order = np.argsort(keys, kind="stable")
        s = keys[order]
    return order, s


def stretches(texts: list[bytes], size: int) -> list[tuple[int, int]]:
    """First and end of consecutive texts of about so many bytes, so that work on them stays in a small memory."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(ends, np.arange(size, int(ends[-1]) + size, size)) + 1 if len(texts) else np.empty(0, np.int64)
    marks = np.unique(np.concatenate([[0], np.minimum(cuts, len(texts))])).tolist()
    return list(zip(marks, marks[1:]))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and their counts."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def places(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """How many distinct keys there are, and the place of each key among them."""
    order, s = ascending(keys)
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]), dtype=np.int32) if len(keys) else 0
    return (int(at.max()) + 1 if len(keys) else 0), at


def give_back() -> None:
    """Return memory to the system: what is freed, which a worker that waits for its next task would keep, and the memos of operators that ran
    in this worker before."""
    for module, memo in (("bpe", "_memo"), ("bpe", "vocabulary"), ("token_files", "library_ids")):
        if loaded := sys.modules.get(f"{__package__}.{module}"):
            getattr(loaded, memo).cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def ranges(packed: DataFrame) -> int:
    """Bits of a hash that name its range: one or two ranges for each block."""
    return max(4, min(20, packed.count().bit_length()))


def spans(sorted_keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Range, first and end of the keys in each range that has any."""
    cuts = np.searchsorted(sorted_keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
    return [(i, a, z) for i, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]


MESSAGE = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("bucket", pa.int32()), ("first", pa.int64()), *((c, pa.binary()) for c in ("keys", "counts", "second", "number", "id"))])
ANSWER = pa.schema([("block", pa.int64()), ("kind", pa.string()), *((c, pa.binary()) for c in ("at", "value", "owner", "owner_id"))])
ANSWERS = "block long, kind string, at binary, value binary, owner binary, owner_id binary"


@dataclass
class Marks:
    """Records that may equal others: number within the block (ascending), 128 bits of hash, and the id that orders them."""

    number: np.ndarray
    first: np.ndarray
    second: np.ndarray
    id: np.ndarray


def ask(packed: DataFrame, tell: Callable[[dict], tuple[np.ndarray, np.ndarray, Marks | None]], least: int = 1) -> DataFrame:
    """tell(block's row) gives its distinct keys, their counts, and records that may have equals. The answers to each block, by kind:

    "sum": by position among the block's keys, the totals over all blocks, of keys whose total reaches `least`;
    "own": by number, 1 where a record is the first of its equals (by id, then record), with that first record and its id.
    """
    bits = ranges(packed)

    def send(batches):
        for b in batches:
            for r in b.to_pylist():
                keys, counts, marks = tell(r)
                rows = [{"block": r["block"], "kind": "sum", "bucket": i, "first": a, "keys": squeeze(keys[a:z]), "counts": shrink(counts[a:z])} for i, a, z in spans(keys, bits)]
                if marks is not None:
                    order = np.argsort(marks.first, kind="stable")
                    m = Marks(*(x[order] for x in (marks.number, marks.first, marks.second, marks.id)))
                    rows += [{"block": r["block"], "kind": "own", "bucket": i, "keys": m.first[a:z].tobytes(), "second": m.second[a:z].tobytes(), "number": m.number[a:z].astype("<i8").tobytes(), "id": m.id[a:z].astype("<i8").tobytes()} for i, a, z in spans(m.first, bits)]
                yield pa.RecordBatch.from_pylist(rows, MESSAGE)
        give_back()

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.Table.from_pylist([*_sums([r for r in rows if r["kind"] == "sum"], least), *_owners([r for r in rows if r["kind"] == "own"])], ANSWER)

    sent = packed.mapInArrow(send, "block long, kind string, bucket int, first long, keys binary, counts binary, second binary, number binary, id binary")
    return sent.groupBy("bucket").applyInArrow(answer, ANSWERS)


def _sums(rows: list[dict], least: int) -> list[dict]:
    if not rows:
        return []
    parts = [unsqueeze(r["keys"]) for r in rows]
    order, s = ascending(every := np.concatenate(parts))
    new = np.concatenate([[True], s[1:] != s[:-1]])
    sums = np.add.reduceat(np.concatenate([stretch(r["counts"]) for r in rows]).astype(np.int64)[order], np.flatnonzero(new))
    total = np.empty(len(every), np.int64)
    total[order] = sums[np.cumsum(new) - 1]
    out, end = [], 0
    for r, p in zip(rows, parts, strict=True):
        t, end = total[end : end + len(p)], end + len(p)
        at = np.flatnonzero(t >= least)
        if len(at):
            out.append({"block": r["block"], "kind": "sum", "at": squeeze((at + r["first"]).astype(np.uint64)), "value": shrink(t[at])})
    return out


def _owners(rows: list[dict]) -> list[dict]:
    if not rows:
        return []
    column = lambda c, kind: [np.frombuffer(r[c], kind) for r in rows]
    numbers = column("number", "<i8")
    record = np.concatenate([r["block"] << RECORD_BITS | n for r, n in zip(rows, numbers, strict=True)])
    first, second, ids = (np.concatenate(column(c, kind)) for c, kind in (("keys", "<u8"), ("second", "<u8"), ("id", "<i8")))
    order = np.lexsort((record, ids, second, first))
    new = np.concatenate([[True], (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)])
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    owner, owner_id = np.empty_like(record), np.empty_like(ids)
    owner[order], owner_id[order] = record[lead], ids[lead]
    out, end = [], 0
    for r, n in zip(rows, numbers, strict=True):
        here = slice(end, end + len(n))
        end += len(n)
        by = np.argsort(n)
        out.append({"block": r["block"], "kind": "own", "at": squeeze(n[by].astype(np.uint64)), "value": shrink((owner[here] == record[here])[by].astype(np.int64)), "owner": owner[here][by].tobytes(), "owner_id": owner_id[here][by].tobytes()})
    return out


def spread(answers: list[dict], size: int, kind: str = "sum") -> np.ndarray:
    """The values of all answers of a kind at their places, 0 elsewhere."""
    out = np.zeros(size, np.int64)
    for r in answers:
        if r["kind"] != kind:
            continue
        out[unsqueeze(r["at"]).astype(np.int64)] = stretch(r["value"])
    return out


def visit(packed: DataFrame, answers: DataFrame, use: Callable[[dict, list[dict]], pa.Table], schema: str) -> DataFrame:
    """use(block's row, its answers) for each block; a block without answers has none."""

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        found = replies.to_pylist()
        out = pa.concat_tables([use(r, found) for r in blocks.to_pylist()] or [empty])
        give_back()
        return out

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
