"""Small documents with every awkward case, and brute-force versions."""

from __future__ import annotations

import itertools
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block long, record string, x0 double"


def table(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}", None if t is None else len(t), k, f"r{k}", 0.5) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def awkward() -> list[str | None]:
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    prose = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(6)]
    near = [prose[0].replace("w1 ", "zz ", 1), prose[0] + " tail", prose[1] + "\n" + prose[2]]
    lines = ["one two three four five", "one two three four five six", "a b", "a b"]
    return [None, "", " \n\t", "word", "a b c d", "a b c d", *prose, *near, prose[0], "\n".join(lines + prose[:2]), "é" * 700 + " " + "x" * 2000, "日本 語 " * 50, " ".join(vocabulary * 30)]


def union_find(nodes, edges) -> dict:
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingle_set(text: str | None) -> set:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a: set, b: set) -> bool:
    both = len(a & b)
    return 9 * both >= 4 * (len(a) + len(b)) and both > 0


def near_duplicates(rows: list[tuple]) -> dict:
    """(doc_id, text) with distinct ids to (class_id, n_links, group_id)."""
    lead: dict = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lead.setdefault(t or "", i)
    sets = {i: shingle_set(t) for t, i in lead.items()}
    edges = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if similar(sets[a], sets[b])]
    group = union_find(sets, edges)
    n = {i: sum(i in e for e in edges) for i in sets}
    return {i: (lead[t or ""], n[lead[t or ""]], group[lead[t or ""]]) for i, t in rows}


def kept_lines(rows: list[tuple]) -> list[str | None]:
    """Texts of (doc_id, text), in order of rows, without lines like an earlier one."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen: list[set] = []
    out: list[str | None] = [None] * len(rows)
    for k in order:
        text = rows[k][1]
        if text is None:
            continue
        left = []
        for line in text.encode().split(b"\n"):
            w = set(line.split())
            if len(w) < 3:
                left.append(line)
                continue
            if not any(9 * len(w & v) >= 4 * (len(w) + len(v)) for v in seen):
                left.append(line)
            seen.append(w)
        out[k] = b"\n".join(left).decode()
    return out
