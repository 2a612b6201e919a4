"""Exact set-similarity join (Jaccard) of the records of packed texts.

1. ``ask`` tells in how many records of the corpus each element occurs. Elements go by rarity (then by hash); two sets as similar as asked for
   share one of the first few, so only these are posted, and of them only those that some other record has.
2. Postings meet by hash range. Pairs that the length, positional and bitmap filters leave link their records; a range returns a forest of links, not pairs.
   An element of more than HOT postings is cut into parts, and each pair of parts is a task's unit; beyond SALT_ABOVE its postings are in several ranges.
3. Records of a connected component are verified against each other in units of bounded size: a component beyond CELL records is dealt into cells,
   and each pair of cells is a unit. Every pair of similar records lies in exactly one unit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from broadsheet.llm.blocks import RECORD_BITS, ascending, mix, places, spread, stretches, visit
from broadsheet.operators.graph import connected_components
from broadsheet.storage import materialise

CELL = 256
#: Postings of one element that one task pairs; of an element with more, each pair of so many is a unit.
HOT = 1 << 14
#: An element that more records have than this is posted to several ranges, by block, so that no task holds all its postings.
SALT_ABOVE = 1 << 22
#: Units of one record or more that one task verifies together.
BIN_RECORDS = 2048
PAIRS_AT_ONCE, LINKS_AT_ONCE = 1 << 16, 1 << 20
#: Postings of an element from which on they are paired row by row. Below, the pairs of all elements are worked out together: the calls for a row and
#: the links for an element would cost more than its pairs.
MANY = 1024


@dataclass
class Sets:
    """Records of a block: number within the block, end of each one's elements, distinct elements (64-bit hashes)."""

    number: np.ndarray
    ends: np.ndarray
    elements: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)


@dataclass(frozen=True)
class Threshold:
    """A Jaccard similarity of at least num / den, decided in whole numbers."""

    num: int = 4
    den: int = 5

    def shared(self, sizes: np.ndarray) -> np.ndarray:
        """Least number of shared elements for a sum of two sizes."""
        return -(-self.num * sizes // (self.num + self.den))

    def least(self, size: np.ndarray) -> np.ndarray:
        """Least size of a set similar to one of the given size."""
        return -(-self.num * size // self.den)

    def smallest(self) -> int:
        """Least size of a set that is similar to a set unequal to it: one with a single element more is the most similar."""
        return -(-self.num // (self.den - self.num)) if self.den > self.num else 1 << 31

    def similar(self, shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (self.num + self.den) * shared >= self.num * sizes


def of_groups(owner: np.ndarray, elements: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and distinct elements of n sets; owners ascend."""
    pair = mix(elements ^ mix(owner.astype(np.uint64) + np.uint64(0x452821E638D01377)))
    order, s = ascending(pair)
    keep = np.ones(len(owner), bool)
    keep[order[1:][s[1:] == s[:-1]]] = False
    return np.cumsum(np.bincount(owner[keep], minlength=n)), elements[keep]


#: Bytes of texts that are hashed and made distinct at a time.
PART_BYTES = 1 << 19


def sets_of(texts: list[bytes], make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ends and distinct elements of the sets of all texts; make gives those of a stretch of them."""
    ends, elements, n = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    for a, z in stretches(texts, PART_BYTES):
        e, x = make(texts[a:z])
        ends.append(e + n)
        elements.append(x)
        n += len(x)
    return np.concatenate(ends), np.concatenate(elements)


def by_rarity(sets: Sets, at: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, position, and index of every element, each set in order of its elements' totals, then of their hashes.

    at: the place of each element among the block's distinct ones, by which total goes.
    """
    owner = np.repeat(np.arange(len(sets.number)), sets.sizes)
    rank = np.empty(len(total), np.int64)
    rank[np.argsort(np.minimum(total, 0x7FFFFFFF) << 32 | np.arange(len(total)))] = np.arange(len(total))
    order = np.argsort(owner << 32 | rank[at])
    return owner, np.arange(len(owner)) - np.repeat(sets.ends - sets.sizes, sets.sizes), order


def bitmaps(sets: Sets, words: int = 2) -> np.ndarray:
    """Parity bitmaps: bits that differ between two of them are no more than the elements that differ."""
    out = np.zeros((len(sets.number), words), np.uint64)
    h = mix(sets.elements ^ np.uint64(0x243F6A8885A308D3))
    bit, word = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) % np.uint64(words)
    full = sets.sizes > 0
    for k in range(words):
        v = np.where(word == k, bit, np.uint64(0))
        if full.any():
            out[full, k] = np.bitwise_xor.reduceat(v, (sets.ends - sets.sizes)[full])
    return out


#: read(block's row): all records of the block that were marked.
Reader = Callable[[dict], Sets]


def postings(packed: DataFrame, answers: DataFrame, read: Reader, threshold: Threshold, bits: int, smallest: int = 1) -> DataFrame:
    """Rows (bucket, and packed arrays element, record, size, position, bitmap) of the prefix elements that other records have; only
    records that own their sets, and have `smallest` elements, are posted. The low bits of a bucket name the hash range, the others the salt of an element
    that very many records have."""

    def use(block: dict, found: list[dict]) -> pa.Table:
        sets = read(block)
        known, at = places(sets.elements)
        total = spread(found, known)
        own = spread(found, int(sets.number.max(initial=-1)) + 1, "own")[sets.number] > 0
        owner, place, order = by_rarity(sets, at, total)
        n = sets.sizes
        pick = (place < (n - threshold.least(n) + 1)[owner]) & (total[at[order]] > 1) & (own & (n >= smallest))[owner]
        who, element, place, salts = owner[pick], sets.elements[order[pick]], place[pick], total[at[order[pick]]] // SALT_ABOVE
        salt = np.where(salts > 0, 1 + np.int64(mix(np.array([block["block"]], np.uint64))[0] >> np.uint64(1)) % np.maximum(salts, 1), 0)
        bucket = salt << bits | (element >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket)
        who, element, place, bucket = who[order], element[order], place[order], bucket[order]
        maps = bitmaps(sets)
        out = []
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, z in zip([0, *cuts], [*cuts, len(bucket)]) if len(bucket) else ():
            w = who[a:z]
            record = block["block"] << RECORD_BITS | sets.number[w]
            out.append({"bucket": int(bucket[a]), "element": element[a:z].tobytes(), "record": record.astype("<i8").tobytes(), "size": n[w].astype("<i4").tobytes(), "place": place[a:z].astype("<i4").tobytes(), "bitmap": maps[w].tobytes()})
        return pa.Table.from_pylist(out, POSTED)

    return visit(packed, answers, use, "bucket long, element binary, record binary, size binary, place binary, bitmap binary")


POSTED = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("element", "record", "size", "place", "bitmap"))])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is connected to."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _rows(size: np.ndarray, left: np.ndarray, first: np.ndarray, bitmap: np.ndarray, threshold: Threshold, join: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """The pairs of one element that pass the filters: each posting against all before it, which lie side by side."""
    planes, of_size, found, n = [np.ascontiguousarray(x) for x in bitmap.T], -1, [], 0
    for j in range(len(size)):
        if size[j] != of_size:  # postings go by size
            of_size = size[j]
            need = threshold.shared(size + of_size)
            enough, slack = left >= need, size + of_size - 2 * need
        i0 = int(first[j])
        keep = enough[i0:j] & (need[i0:j] <= left[j])
        differ = np.zeros(j - i0, np.uint8)
        for x in planes:
            differ += np.bitwise_count(x[i0:j] ^ x[j])
        i = np.flatnonzero(keep & (differ <= slack[i0:j])) + i0
        if len(i):
            found.append((i, np.full(len(i), j)))
            n += len(i)
        if n > LINKS_AT_ONCE or j == len(size) - 1 and n:
            join(*(np.concatenate(x) for x in zip(*found, strict=True)))
            found, n = [], 0


def _links(key: np.ndarray, record: np.ndarray, size: np.ndarray, place: np.ndarray, bitmap: np.ndarray, threshold: Threshold, chain_above: int | None, side: np.ndarray | None = None) -> pa.Table:
    """Links (a, b) that connect the records of all pairs which have an element in common and pass the filters. key: the elements, as small numbers;
    side: only pairs of different sides count. An element of more than chain_above postings links neighbours by size instead of pairs."""
    order = np.argsort(key << 32 | size)
    key, record, size, place, bitmap = key[order], record[order], size[order], place[order], bitmap[order]
    side = side if side is None else side[order]
    nodes, node = np.unique(record, return_inverse=True)
    label = np.arange(len(nodes))
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    # Ordered by size within an element, the partners before a posting begin at the first that is long enough.
    by_size = group * (1 << 32) + size
    first = np.searchsorted(by_size, group * (1 << 32) + threshold.least(size))
    here = np.arange(len(key))
    long = np.zeros(len(key), bool) if chain_above is None else (count > chain_above)[group]
    chained = np.flatnonzero(long & (first < here))
    label = forest(np.concatenate([node[chained], here[:0]]), node[chained - 1], len(nodes))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        keep = label[node[i]] != label[node[j]]
        if side is not None:
            keep &= side[i] != side[j]
        if keep.any():
            label = forest(np.concatenate([node[i[keep]], np.arange(len(nodes))]), np.concatenate([node[j[keep]], label]), len(nodes))

    left = size - place
    many = (count >= MANY)[group] & ~long
    todo = np.where(long | many, 0, here - first)
    upto = np.cumsum(todo)
    at, found, passed = 0, [], 0
    while at < len(todo):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        n = todo[at:end]
        j = np.repeat(here[at:end], n)
        i = j - 1 - (np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n))
        at = end
        need = threshold.shared(size[i] + size[j])
        keep = np.minimum(left[i], left[j]) >= need
        i, j, need = i[keep], j[keep], need[keep]
        differ = np.bitwise_count(bitmap[i] ^ bitmap[j]).sum(axis=1, dtype=np.int64)
        keep = size[i] + size[j] - differ >= 2 * need
        found.append((i[keep], j[keep]))
        passed += len(found[-1][0])
        if passed > LINKS_AT_ONCE or at == len(todo):
            join(*(np.concatenate(x) for x in zip(*found, strict=True)))
            found, passed = [], 0
    starts = np.flatnonzero(new & many)
    for a, z in zip(starts.tolist(), (starts + count[group[starts]]).tolist(), strict=True):
        _rows(size[a:z], left[a:z], first[a:z] - a, bitmap[a:z], threshold, lambda i, j, a=a: join(i + a, j + a))
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"a": nodes[linked], "b": nodes[label[linked]]})


def _arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Records, sizes, places and bitmaps of all rows of postings."""
    column = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]])
    record = column("record", "<i8")
    return record, column("size", "<i4").astype(np.int64), column("place", "<i4").astype(np.int64), column("bitmap", "<u8").reshape(len(record), -1)


LINKED_ARROW = pa.schema([*((c, pa.int64()) for c in ("a", "b", "element", "bucket")), ("part", pa.int32()), *((c, pa.binary()) for c in ("record", "size", "place", "bitmap"))])
LINKED = "a long, b long, element long, bucket long, part int, record binary, size binary, place binary, bitmap binary"


def link(table: pa.Table, threshold: Threshold, chain_above: int | None, bits: int) -> pa.Table:
    """Links (a, b) of one hash range. Elements of a salted range, and those of more than HOT postings that are not chained, come out in parts instead."""
    element = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in table["element"]])
    record, size, place, bitmap = _arrays(table)
    bucket, (n, key) = table["bucket"][0].as_py(), places(element)
    key = key.astype(np.int64)
    hot = np.full(len(element), bucket >> bits > 0)
    if chain_above is None:
        hot |= (np.bincount(key, minlength=n) > HOT)[key]
    cold = ~hot
    links = _links(key[cold], record[cold], size[cold], place[cold], bitmap[cold], threshold, chain_above)
    parts = []
    if hot.any():
        chosen = np.flatnonzero(hot)
        chosen = chosen[np.argsort(key[chosen], kind="stable")]
        for mine in np.split(chosen, np.flatnonzero(np.diff(key[chosen])) + 1):
            for at in range(0, len(mine), HOT):
                k = mine[at : at + HOT]
                parts.append({"element": int(element[k[0]].astype(np.int64)), "bucket": bucket, "part": at // HOT, "record": record[k].tobytes(), "size": size[k].astype("<i4").tobytes(), "place": place[k].astype("<i4").tobytes(), "bitmap": bitmap[k].tobytes()})
    return pa.concat_tables([pa.Table.from_pylist(parts, LINKED_ARROW), pa.table({f.name: links[f.name] if f.name in ("a", "b") else pa.nulls(len(links), f.type) for f in LINKED_ARROW}, LINKED_ARROW)])


def across(hot: DataFrame, threshold: Threshold, chain_above: int | None) -> DataFrame:
    """Links (a, b) of elements that many records have: their parts are numbered, and each pair of parts is a unit of its own."""

    def meet(table: pa.Table) -> pa.Table:
        record, size, place, bitmap = _arrays(table)
        side = None if len(table) == 1 else np.repeat([0, 1], [len(x.as_py()) // 8 for x in table["record"]])
        return _links(np.zeros(len(record), np.int64), record, size, place, bitmap, threshold, chain_above, side)

    numbered = hot.select("element", "bucket", "part").withColumn("cell", F.row_number().over(W.partitionBy("element").orderBy("bucket", "part")) - 1)
    cells = numbered.groupBy("element").agg(F.count(F.lit(1)).cast("int").alias("cells"))
    dealt = hot.drop("a", "b").join(numbered, ["element", "bucket", "part"]).join(cells, "element").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    units = dealt.withColumn("i", F.least("cell", "other")).withColumn("j", F.greatest("cell", "other"))
    return units.groupBy("element", "i", "j").applyInArrow(meet, "a long, b long")


def components(posted: DataFrame, bits: int, threshold: Threshold, chain_above: int | None = None) -> DataFrame:
    """record, component of every record that some filtered pair names."""
    linked = posted.groupBy("bucket").applyInArrow(lambda t: link(t, threshold, chain_above, bits), LINKED)
    linked = materialise(linked, "linked")
    links, hot = linked.filter("a IS NOT NULL").select("a", "b"), linked.filter("element IS NOT NULL")
    if not hot.isEmpty():
        links = links.unionByName(across(hot, threshold, chain_above))
    found = connected_components(links).select(F.col("node").alias("record"), "component")
    return materialise(found, "components")


def members(packed: DataFrame, found: DataFrame, describe: Callable[[dict, np.ndarray], dict], fields: str) -> DataFrame:
    """record, size, elements and other fields of the records in components: describe(block's row, numbers) gives all but the record."""
    ddl = f"record long, size int, elements binary{fields}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def use(block: dict, got: list[dict]) -> pa.Table:
        mine = np.sort(np.array([r["record"] for r in got], np.int64)) & ((1 << RECORD_BITS) - 1)
        if not len(mine):
            return schema.empty_table()
        return pa.table({"record": block["block"] << RECORD_BITS | mine, **describe(block, mine)}, schema)

    return visit(packed, found.select(F.shiftright("record", RECORD_BITS).alias("block"), "record"), use, ddl)


def units(records: DataFrame, found: DataFrame) -> DataFrame:
    """The records with component, bin (a task's worth), i, j (the unit: a pair of cells) and cell."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    counted = sizes.withColumn("cells", F.ceil(F.col("m") / CELL).cast("int"))
    every = counted.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    bins = max(1, every // BIN_RECORDS)
    placed = records.join(found, "record").join(counted, "component")
    cell = F.pmod(F.xxhash64("record"), F.col("cells")).cast("int")
    dealt = placed.withColumn("cell", cell).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    out = dealt.withColumn("i", F.least("cell", "other").cast("int")).withColumn("j", F.greatest("cell", "other").cast("int"))
    small = F.pmod(F.xxhash64("component"), F.lit(bins))
    return out.withColumn("bin", F.when(F.col("cells") == 1, small).otherwise(F.xxhash64("component", "i", "j"))).drop("m", "cells", "other")


def shared_counts(elements: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements the sets left[k] and right[k] share, for each k."""
    n = len(elements)
    if len(left) <= 4 * n:
        return np.array([len(np.intersect1d(elements[a], elements[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    owner = np.repeat(np.arange(n), [len(e) for e in elements])
    _, back, count = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    keep = count[back] > 1
    owner, back = owner[keep], column[back[keep]]
    out, step = np.zeros((n, n), np.float64), 8192
    order = np.argsort(back, kind="stable")
    owner, back = owner[order], back[order]
    for at in range(0, int(back[-1]) + 1 if len(back) else 0, step):
        a, z = np.searchsorted(back, [at, at + step])
        dense = np.zeros((n, step), np.float32)
        dense[owner[a:z], back[a:z] - at] = 1
        out += dense @ dense.T
    return out[left, right].astype(np.int64)


def verify(dealt: DataFrame, threshold: Threshold, survives, digest, schema: str) -> DataFrame:
    """digest(rows, left, right) for the similar pairs (indices into rows) of each unit.

    survives(rows, left, right) may drop candidate pairs before the exact check; rows is a dict of the unit's columns.
    """

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table[c].to_numpy(zero_copy_only=False) if c != "elements" else None for c in table.column_names}
        elements = [np.frombuffer(x.as_buffer(), "<u8") for x in table["elements"]]
        key = np.lexsort((columns["record"], columns["j"], columns["i"], columns["component"]))
        ordered = {c: v[key] for c, v in columns.items() if v is not None}
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(ordered["component"]) != 0) | (np.diff(ordered["i"]) != 0) | (np.diff(ordered["j"]) != 0)]))
        out = []
        for a, z in zip(cut, np.append(cut[1:], len(key)), strict=True):
            rows = {c: v[a:z] for c, v in ordered.items()}
            sets = [elements[k] for k in key[a:z]]
            left, right = np.triu_indices(z - a, 1)
            size, cell = rows["size"].astype(np.int64), rows["cell"]
            ok = np.minimum(size[left], size[right]) >= threshold.least(np.maximum(size[left], size[right]))
            if rows["i"][0] != rows["j"][0]:
                ok &= cell[left] != cell[right]
            left, right = left[ok], right[ok]
            left, right = survives(rows, left, right)
            if not len(left):
                continue
            ok = threshold.similar(shared_counts(sets, left, right), size[left] + size[right])
            if ok.any():
                out.append(digest(rows, left[ok], right[ok]))
        return pa.concat_tables(out) if out else empty



    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return dealt.groupBy("bin").applyInArrow(run, schema)
