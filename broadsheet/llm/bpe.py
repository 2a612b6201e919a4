"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

The merge list fixes how many bytes to the right of a token boundary can still change that boundary
(``sufficient_lookahead``). The encoder emits each token as soon as that many bytes follow it, or its piece is settled, so its state stays
constant in size however long the text is, and whatever it is made of. ``StreamDecoder`` turns ids back into text with an incremental UTF-8 state machine.

Results: a null text counts as the empty text and gives no ids. Any text, of any length, gives the ids of the tokenizers library. Every row gives
a row, so repeated rows are repeated; null doc_ids stay null; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

#: Pieces longer than this many characters are not memoised but run through the transducer byte by byte.
LONG_PIECE = 256
#: Entries that a worker's memo holds at most.
MEMO_ENTRIES = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: itself if visible, else the next one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in visible}
    for b in range(256):
        shown.setdefault(b, chr(256 + len(shown) - len(visible)))
    return [shown[b] for b in range(256)]


def unsettled() -> str:
    """A character class of what Python's Unicode tables have no category for: newer tables may call such a character a letter, others not."""
    out, start = [], None
    for c in range(0x80, sys.maxunicode + 2):
        free = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if free and start is None:
            start = c
        elif not free and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "[" + "".join(out) + "]"


def sufficient_lookahead(merges: list[tuple[int, int, int]], width: dict[int, int]) -> int:
    """Bytes right of a boundary that can decide whether it survives.

    Rule i = (a, b) removes a boundary if b follows it and b's right end still stands when i applies. That end can only fall earlier to a
    rule k < i whose left token lies on the right spine of b. So rule i looks at len(b) bytes plus what the widest such k looks at;
    ranks fall along the chain, and one pass in rank order gives the longest.
    """
    reach: dict[int, int] = {}
    right: dict[int, list[int]] = {}
    for a, b, made in merges:
        todo, furthest = [b], 0
        while todo:
            x = todo.pop()
            furthest = max(furthest, reach.get(x, 0))
            todo += right.get(x, ())
        reach[a] = max(reach.get(a, 0), width[b] + furthest)
        right.setdefault(made, []).append(b)
    return max(reach.values(), default=0)


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    #: The fixed split of byte-level pre-tokenization.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    #: In texts of these characters alone, Python's own classes split alike, and faster: in them, word characters are letters, 0-9 and _.
    PLAIN = r"[\x09-\x0d\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u02af\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e]*"
    PLAIN_SPLIT = r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        self.alphabet = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.size = 1 + max(ids.values())
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * max(self.size, 1 + max(self.added.values(), default=0))
        for token, i in ids.items():
            if token not in self.added:
                self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [ids[c] for c in self.alphabet]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.merges = {(a, b): (rank, made) for rank, (a, b, made) in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, {i: len(x) for i, x in enumerate(self.bytes_of)})
        self.dtype = np.dtype("<u2" if len(self.bytes_of) <= 1 << 16 else "<u4")
        self.plain, self.plain_split = re.compile(self.PLAIN), re.compile(self.PLAIN_SPLIT)
        self.split, self.unassigned = regex.compile(self.SPLIT), re.compile(unsettled())
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def pieces(self, text: str) -> list[str]:
        """The pieces that merges don't cross. Texts with characters on which Unicode tables differ are left to the library's."""
        if (text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f")) or self.plain.fullmatch(text):
            return self.plain_split.findall(text)
        if not self.unassigned.search(text):
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece, seen whole: the pair of lowest rank merges first, of equal ranks the leftmost."""
        tokens = [self.byte_id[b] for b in data]
        n, rules = len(tokens), self.merges
        if n < 40:
            while len(tokens) > 1:
                best, at = None, 0
                for i in range(len(tokens) - 1):
                    rule = rules.get((tokens[i], tokens[i + 1]))
                    if rule and (best is None or rule < best):
                        best, at = rule, i
                if best is None:
                    break
                tokens[at : at + 2] = [best[1]]
            return tokens
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rule[0], i, tokens[i], tokens[i + 1], rule[1]) for i in range(n - 1) if (rule := rules.get((tokens[i], tokens[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (rule := rules.get((tokens[x], tokens[after[x]]))):
                    heapq.heappush(heap, (rule[0], x, tokens[x], tokens[after[x]], rule[1]))
        return [t for t in tokens if t >= 0]


class PieceTransducer:
    """Encodes one piece fed in parts. Holds at most the lookahead plus one step of bytes."""

    STEP = 256

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, b""

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.STEP):
            self.held += data[at : at + self.STEP]
            stable, end = len(self.held) - self.v.lookahead, 0
            if stable < self.STEP:
                continue
            for token in self.v.merge(self.held):
                if end + len(self.v.bytes_of[token]) > stable:
                    break
                end += len(self.v.bytes_of[token])
                yield token
            self.held = self.held[end:]

    def finish(self) -> Iterator[int]:
        yield from self.v.merge(self.held)
        self.held = b""


class _Memo(dict):
    """Ids of short pieces, packed."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONG_PIECE:
            t, data = PieceTransducer(self.v), piece.encode()
            return np.fromiter((x for part in (t.feed(data), t.finish()) for x in part), self.v.dtype).tobytes()
        packed = np.array(self.v.merge(piece.encode()), self.v.dtype).tobytes()
        if len(self) < MEMO_ENTRIES:
            self[piece] = packed
        return packed


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(2)
def _memo(path: str) -> _Memo:
    return _Memo(vocabulary(path))


class StreamEncoder:
    """feed() text in parts of any size, then finish(): both return packed ids that no later text can change."""

    #: Characters cut off the input at a time.
    PART = 1 << 16
    #: Pieces that end so many characters before what is known, white space at its end apart, are settled: the longest look at what follows is that of
    #: an apostrophe at two letters.
    SETTLED = 3

    def __init__(self, path: str):
        self.v, self.memo = vocabulary(path), _memo(path)
        self.held, self.open, self.kind = "", None, None
        self.added = sorted(self.v.added, key=len, reverse=True)
        self.mark = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.space, self.spaces, self.tail = regex.compile(r"\s*"), regex.compile(r"\s*", regex.REVERSE), ""
        self.kinds = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")]

    def feed(self, text: str) -> bytes:
        return b"".join(self._part(text[at : at + self.PART], False) for at in range(0, len(text), self.PART))

    def finish(self) -> bytes:
        return self._part("", True)

    def _part(self, text: str, last: bool) -> bytes:
        text, out = self.held + text, []
        self.held = ""
        if self.mark:
            at = 0
            for m in self.mark.finditer(text):
                out += [self._plain(text[at : m.start()], True), np.array([self.v.added[m[0]]], self.v.dtype).tobytes()]
                at = m.end()
            text = text[at:]
            if not last:  # what may be the start of an added token waits
                keep = max((k for a in self.added for k in range(min(len(a) - 1, len(text)), 0, -1) if text.endswith(a[:k])), default=0)
                text, kept = text[: len(text) - keep], text[len(text) - keep :]
                out.append(self._plain(text, False))
                self.held += kept
                return b"".join(out)
        out.append(self._plain(text, last))
        return b"".join(out)

    def _plain(self, text: str, last: bool) -> bytes:
        """Text without added tokens; last: the next character, if any, is not part of the same stretch."""
        out = []
        if self.open is not None:  # inside a piece too long to hold
            text, ids = self._go_on(text, last)
            out.append(np.array(ids, self.v.dtype).tobytes())
        if text and self.open is None:
            pieces = self.v.pieces(text)
            if not last:
                space = self.spaces.match(text).start()  # the white space at the end of the text
                end, cut = len(text), []
                while pieces and end > min(len(text) - self.SETTLED, space):
                    cut.append(pieces.pop())
                    end -= len(cut[-1])
                self.held = text[end:]
            out += map(self.memo.__getitem__, pieces)
            if not last and len(cut[0]) > 4 * LONG_PIECE:
                out.append(self._start(cut[0], space < len(text)))
        return b"".join(out)

    def _start(self, body: str, space: bool) -> bytes:
        """The last piece so far goes to a transducer; of white space the last character waits, which may belong to what follows."""
        self.open, self.held, self.tail = PieceTransducer(self.v), body[-1:] if space else "", body[-2:]
        self.kind = "space" if space else next((k for k in self.kinds if k.fullmatch(body.lstrip(" "))), None)
        return np.fromiter(self.open.feed((body[:-1] if space else body).encode()), self.v.dtype).tobytes()

    def _go_on(self, text: str, last: bool) -> tuple[str, list[int]]:
        """What the open piece leaves of the text, and its ids that are settled."""
        if self.kind == "space":
            run = self.space.match(text).end()
            whole = run == len(text)
            n = run if whole and last else run - 1
            if whole and not last:
                self.held, rest = text[n:], ""
            else:
                rest = text[n:]
        else:
            if self.kind is None or self.v.unassigned.search(text):  # the library says how far the piece goes
                n = len(self.v.pieces(self.tail + text)[0]) - len(self.tail)
            else:
                m = self.kind.match(text)
                n = m.end() if m else 0
            whole, rest = n == len(text), text[n:]
            self.tail = (self.tail + text[:n])[-2:]
        ids = list(self.open.feed(text[:n].encode()))
        if last or not whole:
            ids += self.open.finish()
            self.open = self.kind = None
        return rest, ids


def encode(text: str | None, path: str) -> np.ndarray:
    """The ids of a whole text."""
    e = StreamEncoder(path)
    return np.frombuffer(e.feed(text or "") + e.finish(), e.v.dtype)


class StreamDecoder:
    """feed() ids in parts: returns the text that is complete. finish() replaces a cut character by U+FFFD."""

    def __init__(self, path: str):
        self.table = vocabulary(path).bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def digests(text: str | None, path: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text; one part of ids in memory at a time."""
    encoder, decoder = StreamEncoder(path), StreamDecoder(path)
    shown, back, n = hashlib.sha256(), hashlib.sha256(), 0
    decimal = encoder.v.decimal

    def take(packed: bytes) -> None:
        nonlocal n
        ids = np.frombuffer(packed, encoder.v.dtype).tolist()
        if ids:
            shown.update(("," * (n > 0) + ",".join(map(decimal.__getitem__, ids))).encode())
            back.update(decoder.feed(ids).encode())
            n += len(ids)

    text = text or ""
    for at in range(0, len(text), encoder.PART):
        take(encoder.feed(text[at : at + encoder.PART]))
    take(encoder.finish())
    back.update(decoder.finish().encode())
    return n, shown.hexdigest(), back.hexdigest()


def _slices(batches, rows: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_documents(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids of each document's whole text. A null text gives no ids; other columns don't matter.

    decoded: also decoded_sha256, of the UTF-8 of what the ids decode to.
    """

    def back(ids: np.ndarray) -> str:
        d = StreamDecoder(path)
        return hashlib.sha256((d.feed(ids.tolist()) + d.finish()).encode()).hexdigest()

    def run(batches):
        for b in _slices(batches):
            ids = [encode(t, path) for t in b["text"].to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            values = np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)
            out = {"doc_id": b["doc_id"], "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))}
            if decoded:
                out["decoded_sha256"] = pa.array([back(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids array<int>" + (", decoded_sha256 string" if decoded else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of each row of ids; null ids give the empty text."""

    def run(batches):
        for b in _slices(batches):
            texts = []
            for ids in b["ids"].to_pylist():
                d = StreamDecoder(path)
                texts.append(d.feed(ids or ()) + d.finish())
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "text": pa.array(texts, pa.string())})

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding, with only digests leaving the executors."""

    def run(batches):
        for b in _slices(batches):
            rows = [digests(t, path) for t in b["text"].to_pylist()]
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(text, pa.string())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
