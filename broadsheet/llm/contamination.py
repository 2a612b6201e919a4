"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton holds every stretch of words of every item. A document's words stream through it: each state and matched length say which
items the last words run through. A window is WINDOW consecutive words of an item, or a whole shorter item. A matched length of WINDOW or more,
or a match that ends in a whole short item, hits those words; a document is contaminated when the hit words reach 1 / SHARE of it.

The automaton is built on the driver from the benchmark, PART_WORDS words at a time: a larger benchmark becomes several automata, one in memory at a time, and
each is a pass over the documents; an item that is longer is cut into stretches that share WINDOW - 1 words, so that every window lies in one.
Texts of any length stream through word by word. Null and wordless texts and items hit nothing. Repeated items count once for each item_id.
Repeated documents give repeated rows; empty tables give empty results, an empty benchmark hits nothing. Other columns don't matter, whatever their names;
null item_ids are left out of the lists of items.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.storage import discard, materialise

WINDOW = 13
SHARE = 20
#: Words of items in one automaton (at most about 120 MB), and in memory at once; a benchmark may have any number of such parts.
PART_WORDS = 200_000

_LETTERS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII punctuation, space and controls, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


class SuffixAutomaton:
    """Generalised over several sequences of integers: built online, one sequence after another from the root."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> list[int]:
        """The state after each element: that of the prefix which ends there."""
        last, path = 0, []
        for c in sequence:
            last = self._extend(last, c)
            path.append(last)
        return path

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The class of q cut at the strings that extend p by c."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, c, known)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new


class Benchmark:
    """Items, their automaton, and which windows each state stands for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in items]
        self.least = min((min(len(x), window) for x in coded if x), default=window)
        a = self.automaton = SuffixAutomaton()
        ends = [a.add(x) for x in coded]
        by_state: list[set[int]] = [set() for _ in a.next]  # items whose windows end in the state's strings
        short: list[dict[int, set[int]]] = [{} for _ in a.next]
        for i, (x, path) in enumerate(zip(coded, ends, strict=True)):
            if 0 < len(x) < window:
                short[self._holder(path[-1], len(x))].setdefault(len(x), set()).add(i)
            for s in path[window - 1 :]:
                by_state[self._holder(s, window)].add(i)
        order = sorted(range(len(a.next)), key=a.length.__getitem__)
        # Down the links: the windows of a state are those of its suffixes too.
        self.wide: list[frozenset[int]] = [frozenset()] * len(a.next)
        self.short: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(a.next)
        for s in order[1:]:
            above = a.link[s]
            # what a state holds for the full window begins at the state whose class has that length
            self.wide[s] = frozenset(by_state[s]) or self.wide[above]
            self.short[s] = tuple(sorted([*self.short[above], *((n, frozenset(v)) for n, v in short[s].items())], key=lambda x: x[0]))

    def _holder(self, state: int, n: int) -> int:
        """The suffix of the state's strings with n words lies in this state's class."""
        a = self.automaton
        while a.length[a.link[state]] >= n:
            state = a.link[state]
        return state

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit spans (merged, by word), items with occurring windows."""
        found = words(text)
        codes = np.fromiter(map(self.vocabulary.get, found, _MINUS), np.int32, len(found))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        known = np.flatnonzero(np.diff(codes >= 0, prepend=False, append=False))
        for start, end in known.reshape(-1, 2).tolist():  # outside the vocabulary no match goes on
            if end - start >= self.least:
                self._walk(codes[start:end].tolist(), start, spans, items)
        return len(found), spans, items

    def _walk(self, codes: list[int], at: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        edges, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        state, n = 0, 0
        for k, c in enumerate(codes, at + 1):
            while state and c not in edges[state]:
                state = link[state]
                n = length[state]
            state = edges[state].get(c, 0)
            n = n + 1 if state else 0
            if n >= self.window:
                items |= self.wide[state]
                hit = n
            else:
                hit = 0
            if self.short[state]:
                fits = self.short[state][: bisect_right(self.short[state], n, key=lambda x: x[0])]
                for _, which in fits:
                    items |= which
                hit = max([hit, *(m for m, _ in fits[-1:])])
            if hit:
                first = k - hit
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, k))


class _Forever:
    """-1 without end: the default of each look-up."""

    def __iter__(self):
        return self

    def __next__(self) -> int:
        return -1


_MINUS = _Forever()


def load(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Benchmark]:
    """One automaton after the other over all items, which stream to the driver; at least one, maybe empty."""
    held, size, most = [], 0, max(PART_WORDS, 2 * window)
    chosen = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for item, text in chosen.toLocalIterator():
        ws = words(text)
        for at in range(0, max(len(ws) - window + 1, 1), most - window + 1) if ws else ():
            some = ws[at : at + most]
            if held and size + len(some) > PART_WORDS:
                yield Benchmark(held, window)
                held, size = [], 0
            held.append((item, some))
            size += len(some)
    yield Benchmark(held, window)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def scan(text: str | None, part: Benchmark, spans: list | None = None, items: list | None = None) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, hit spans, ids of the items with occurring windows, in this part and in those before, whose finds are given."""
    n, some, which = part.scan(text)
    before = [(s["first"], s["end"]) for s in spans or ()]
    return n, merged(before + some), sorted({*(items or ()), *(part.items[i] for i in which)} - {None})


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _pass(rows: DataFrame, benchmark: DataFrame, window: int, finish: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema) -> DataFrame:
    """finish(batch, scans of its texts) for all rows, after every part of the benchmark has seen them; what earlier parts found comes along in two columns."""
    spans, items = _unused("spans", rows.columns), _unused("items", rows.columns)
    names = rows.columns
    rows = rows.withColumn(spans, F.lit(None).cast("array<struct<first: long, end: long>>")).withColumn(items, F.lit(None).cast("array<string>"))
    parts, before = load(benchmark, window), None

    def run(part: Benchmark, last: bool):
        def scans(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    b = batch.slice(k, 512)
                    found = [scan(t, part, s, i) for t, s, i in zip(b["text"].to_pylist(), b[spans].to_pylist(), b[items].to_pylist(), strict=True)]
                    if last:
                        yield finish(b.select(names), found)
                        continue
                    b = b.set_column(len(names), spans, pa.array([[{"first": a, "end": z} for a, z in x[1]] for x in found], SPANS))
                    yield b.set_column(len(names) + 1, items, pa.array([x[2] for x in found], pa.list_(pa.string())))

        return scans

    part = next(parts)
    for following in parts:
        rows = materialise(rows.mapInArrow(run(part, False), rows.schema), "contamination")
        if before is not None:
            discard(before)
        part, before = following, rows
    return rows.mapInArrow(run(part, True), schema)


def contaminated(n_hit: int, n_words: int, share: int = SHARE) -> bool:
    return n_hit > 0 and share * n_hit >= n_words


def measure(docs: DataFrame, benchmark: DataFrame, share: int = SHARE, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (first and one past the last word of each hit stretch)."""

    def finish(b: pa.RecordBatch, scans: list) -> pa.RecordBatch:
        out = []
        for n, spans, items in scans:
            hit = sum(z - a for a, z in spans)
            out.append((n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), contaminated(hit, n, share), [{"first": a, "end": z} for a, z in spans]))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), SPANS]
        return pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _pass(rows, benchmark, window, finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first: long, end: long>>")


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _upper(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def cut(text: str, n: int, spans: list[tuple[int, int]], share: int = SHARE) -> str | None:
    """The text of n words without its hit stretches; None where they reach the limit of coverage."""
    if not spans:
        return text
    if contaminated(sum(z - a for a, z in spans), n, share):
        return None
    places = [m.span() for m in _WORD.finditer(_upper(text))]
    out, at = [], 0
    for a, z in spans:
        out.append(text[at : places[a][0]])
        at = places[z - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int = SHARE, window: int = WINDOW) -> DataFrame:
    """The columns of docs: contaminated documents are gone, hit stretches are cut out of the others; n_chars, if there, follows the text."""
    place = docs.columns.index("text")

    def finish(b: pa.RecordBatch, scans: list) -> pa.RecordBatch:
        old = b["text"].to_pylist()
        new = [None if t is None else cut(t, n, spans, share) for t, (n, spans, _) in zip(old, scans, strict=True)]
        keep = pa.array([t is None or x is not None for t, x in zip(old, new, strict=True)], pa.bool_())
        return b.set_column(place, "text", pa.array(new, b["text"].type)).filter(keep)

    out = _pass(docs, benchmark, window, finish, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
