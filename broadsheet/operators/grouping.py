"""Order-dependent passes over the blocks of a page: each page's rows meet in one task, in the total order (y1, x1, block_id).

What such a pass decides for one block depends on what it decided for those before, which no join expresses. Pages hold tens of blocks; ``per_page``
streams sorted pages through plain Python, many pages to a task. Without images there is no separator, as for pages that come without one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from itertools import groupby
from statistics import median
from types import SimpleNamespace as Block

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from broadsheet.functions.lexicons import IMAGES

FAR, NEAR, REACH = 90_000, 10_000, 300
ROUNDS = 25
CHAIN_GAP = 700


def per_page(rows: DataFrame, f: Callable[[list[Block]], Iterable[tuple]], schema: str, key: str = "page_id", order: tuple[str, ...] = ("y1", "x1", "block_id")) -> DataFrame:
    """f(a page's rows in order) gives result rows without the page, which comes first."""
    kind = StructType.fromDDL(f"{key} long, {schema}")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[Block]:
            for b in batches:
                for r in b.to_pylist():
                    yield Block(**r)

        out: list[tuple] = []
        for page, group in groupby(every(), key=lambda r: getattr(r, key)):
            out += [(page, *x) for x in f(list(group))]
            if len(out) >= 4096:
                yield _batch(out, arrow)
                out = []
        yield _batch(out, arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# Measures of two boxes, as in functions.geometry.


def shared_width(a: Block, b: Block) -> int:
    return max(0, min(a.x2, b.x2) - max(a.x1, b.x1))


def shared_height(a: Block, b: Block) -> int:
    return max(0, min(a.y2, b.y2) - max(a.y1, b.y1))


def col_iou(a: Block, b: Block) -> float:
    both = shared_width(a, b)
    return both / max(1, max(1, a.x2 - a.x1) + max(1, b.x2 - b.x1) - both)


def col_overlap(a: Block, b: Block) -> float:
    return shared_width(a, b) / max(1, min(a.x2 - a.x1, b.x2 - b.x1))


def containment(a: Block, b: Block) -> float:
    return shared_width(a, b) / max(1, a.x2 - a.x1)


def row_overlap(a: Block, b: Block) -> float:
    low = min(a.y2 - a.y1, b.y2 - b.y1)
    return shared_height(a, b) / low if low > 0 else 0.0


def area(a: Block) -> int:
    return max(0, a.x2 - a.x1) * max(0, a.y2 - a.y1)


def common(a: Block, b: Block) -> int:
    return shared_width(a, b) * shared_height(a, b)


def gap(a: Block, b: Block) -> int:
    return max(0, b.y1 - a.y2, a.y1 - b.y2)


def distance(a: Block, b: Block) -> float:
    return 0.0 if one_line(a, b) else gap(a, b) + (1 - col_iou(a, b)) * 100_000


def one_line(a: Block, b: Block) -> bool:
    """Fragments of one banner line."""
    if a.cls != "title" or b.cls != "title":
        return False
    low = max(1, min(a.y2 - a.y1, b.y2 - b.y1))
    side = max(a.x1, b.x1) - min(a.x2, b.x2)
    return low / max(1, a.y2 - a.y1, b.y2 - b.y1) >= 0.75 and max(abs(a.y1 - b.y1), abs(a.y2 - b.y2)) <= 0.35 * low and side <= 0.75 * low and -side <= 0.5 * max(1, min(a.x2 - a.x1, b.x2 - b.x1))


def union(blocks: list[Block]) -> Block:
    first = blocks[0]
    return Block(**{**vars(first), "x1": min(b.x1 for b in blocks), "y1": min(b.y1 for b in blocks), "x2": max(b.x2 for b in blocks), "y2": max(b.y2 for b in blocks)})


def components(items: list, linked: Callable) -> list[list]:
    """Groups of items connected by linked pairs, each in order of its first item."""
    groups: list[list] = []
    for x in items:
        touched = [g for g in groups if any(linked(x, y) for y in g)]
        if touched:
            touched[0].append(x)
            for g in touched[1:]:
                touched[0].extend(g)
                groups.remove(g)
        else:
            groups.append([x])
    return groups


# Articles from geometry


def group_page(page: list[Block]) -> list[list[Block]]:
    """The articles of a page."""
    titles = [b for b in page if b.cls == "title"]
    fragments: dict[int, list[Block]] = {}
    away: set[int] = set()
    for g in components(titles, one_line):
        if len(g) > 1:
            g.sort(key=lambda b: (b.y1, b.x1, b.block_id))
            fragments[g[0].block_id] = g
            away |= {b.block_id for b in g[1:]}
    work = [union(fragments[b.block_id]) if b.block_id in fragments else b for b in page if b.block_id not in away]
    above = {b.block_id: min((b.y1 - o.y2 for o in work if o is not b and o.y2 <= b.y1 and col_iou(b, o) >= 0.35), default=None) for b in work}
    positive = [g for g in above.values() if g]
    limit = max(25, 2 * (median(positive) if positive else 0))
    content = sorted((b for b in work if b.cls in ("title", "plain text", "figure_caption", *IMAGES)), key=lambda b: (b.y1, b.x1, b.block_id))
    texts = [b for b in content if b.cls == "plain text"]

    def is_root(t: Block) -> bool:
        bodied = any(x.y1 >= t.y2 + 2 and containment(x, t) >= 0.35 for x in texts)
        return bodied or above[t.block_id] is None or above[t.block_id] >= limit

    roots = [b for b in content if b.cls == "title" and is_root(b)] or content[:1]
    images = [b for b in content if b.cls in IMAGES]
    articles = {r.block_id: [r] for r in roots}
    tips = {r.block_id: [r] for r in roots}
    rooted, orphans = set(articles), []
    for b in content:
        if b.block_id in rooted:
            continue
        best = None
        for r in roots:
            if r.y1 > b.y1 or containment(b, r) < 0.35:
                continue
            near = [t for t in tips[r.block_id] if col_iou(b, t) >= 0.35]
            tip = min(near, key=lambda t: gap(b, t)) if near else r
            d = gap(b, tip)
            broken = any(i is not b and i.y1 >= tip.y2 and i.y2 <= b.y1 and i.x2 - i.x1 > 2 * (r.x2 - r.x1) for i in images)
            if d <= CHAIN_GAP and not broken and (best is None or d < best[0]):
                best = (d, r, tip)
        if best:
            _, r, tip = best
            articles[r.block_id].append(b)
            kept = [t for t in tips[r.block_id] if t is not tip] if r.block_id in fragments else []
            tips[r.block_id] = [*kept, b]
        elif b.cls == "title":
            roots.append(b)
            articles[b.block_id], tips[b.block_id] = [b], [b]
        else:
            orphans.append(b)
    heads = [r for r in roots if r.cls == "title"]

    def together(a: Block, b: Block) -> bool:
        low = max(1, min(a.y2 - a.y1, b.y2 - b.y1))
        if row_overlap(a, b) >= 0.5 and max(a.x1, b.x1) - min(a.x2, b.x2) <= 0.5 * low:
            return True
        hi, lo = (a, b) if a.y1 <= b.y1 else (b, a)
        if max(containment(lo, hi), containment(hi, lo)) < 0.5 or gap(a, b) > CHAIN_GAP:
            return False
        return not any(hi.y2 <= (t.y1 + t.y2) / 2 <= lo.y1 and shared_width(t, lo) for t in heads)

    groups = list(articles.values()) + components(orphans, together)
    lone = [g for g in groups if all(b.cls == "title" for b in g)]
    full = [g for g in groups if g not in lone]
    for g in lone:
        t = g[0]
        fits = [h for h in full if col_iou(t, h[0]) >= 0.35]
        over = [h for h in fits if h[0].y1 <= t.y1]
        under = [h for h in fits if h[0].y1 > t.y1]
        if over:
            max(over, key=lambda h: h[0].y1).extend(g)
        elif under:
            min(under, key=lambda h: h[0].y1).extend(g)
        else:
            full.append(g)
    back = [[x for b in g for x in fragments.get(b.block_id, [b])] for g in full]
    return [g for g in back if not (len(g) == 1 and g[0].cls == "title")]


def group_articles(blocks: DataFrame) -> DataFrame:
    """page_id, article_id (1, 2, ... down the page), block_id."""

    def run(page: list[Block]) -> Iterator[tuple]:
        for k, g in enumerate(sorted(group_page(page), key=lambda g: min((b.y1, b.x1, b.block_id) for b in g)), 1):
            yield from ((k, b.block_id) for b in sorted(g, key=lambda b: b.block_id))

    return per_page(blocks, run, "article_id int, block_id int")


# Blocks that lie far from their article


def reassign_page(page: list[Block]) -> dict[int, int]:
    """block_id to article_id after at most ROUNDS moves, each the nearest one."""
    owner = {b.block_id: b.article_id for b in page}
    titles = [b for b in page if b.cls == "title"]

    def title_between(a: Block, b: Block) -> bool:
        top, bottom = min(a.y2, b.y2), max(a.y1, b.y1)
        left, right = max(a.x1, b.x1), min(a.x2, b.x2)
        return any(t.block_id not in (a.block_id, b.block_id) and top <= (t.y1 + t.y2) / 2 <= bottom and t.x1 < right and t.x2 > left for t in titles)

    for _ in range(ROUNDS):
        moves = []
        for b in page:
            mates = [o for o in page if o is not b and owner[o.block_id] == owner[b.block_id]]
            if not mates or min(distance(b, o) for o in mates) < FAR:
                continue
            best = None
            for article in sorted(set(owner.values()) - {owner[b.block_id]}):
                near = min((o for o in page if owner[o.block_id] == article), key=lambda o: (distance(b, o), o.block_id))
                d = distance(b, near)
                if (best is None or d < best[0]) and d < NEAR and gap(b, near) <= REACH and not title_between(b, near):
                    best = (d, b.block_id, article)
            if best:
                moves.append(best)
        if not moves:
            break
        _, block, article = min(moves)
        owner[block] = article
    return owner


def reassign_orphans(members: DataFrame) -> DataFrame:
    """page_id, block_id, article_id after reassignment."""
    return per_page(members, lambda page: sorted(reassign_page(page).items()), "block_id int, article_id int")


# The text of an article


def uncovered(blocks: list[Block]) -> list[Block]:
    """From small to large, blocks that those kept before don't cover to 0.6."""
    kept: list[Block] = []
    for b in sorted(blocks, key=lambda b: (area(b), b.block_id)):
        if area(b) == 0 or sum(common(b, k) for k in kept) < 0.6 * area(b):
            kept.append(b)
    return kept


def coverage_dedupe(members: DataFrame) -> DataFrame:
    """page_id, article_id, block_id of the blocks that stay."""

    def run(page: list[Block]) -> Iterator[tuple]:
        for article in sorted({b.article_id for b in page}):
            yield from ((article, b.block_id) for b in sorted(uncovered([b for b in page if b.article_id == article]), key=lambda b: b.block_id))

    return per_page(members, run, "article_id int, block_id int")


def in_columns(blocks: list[Block]) -> list[Block]:
    """Body blocks column by column: by x1 into the first column whose span they share 0.3 of the narrower with."""
    columns: list[list] = []
    for b in sorted(blocks, key=lambda b: (b.x1, b.y1, b.block_id)):
        for c in columns:
            if max(0, min(c[1], b.x2) - max(c[0], b.x1)) >= 0.3 * max(1, min(c[1] - c[0], b.x2 - b.x1)):
                c[0], c[1] = min(c[0], b.x1), max(c[1], b.x2)
                c[2].append(b)
                break
        else:
            columns.append([b.x1, b.x2, [b]])
    return [b for c in sorted(columns, key=lambda c: c[0]) for b in sorted(c[2], key=lambda b: (b.y1, b.block_id))]


def article_text(blocks: list[Block]) -> tuple[str, float]:
    """Text and mean confidence of an article: no covered or prefixed blocks, headings first, then the columns."""
    own = uncovered([b for b in blocks if b.cls in ("plain text", "title", "figure_caption") and (b.text or "").strip()])
    own = [b for b in own if not any(o is not b and len(o.text) > len(b.text) and o.text.startswith(b.text[:30]) for o in own)]
    heads = sorted((b for b in own if b.cls == "title"), key=lambda b: (b.y1, b.block_id))
    ordered = heads + in_columns([b for b in own if b.cls != "title"])
    sure = [b.ocr_confidence for b in ordered if b.ocr_confidence is not None]
    return "\n".join(b.text.strip() for b in ordered), sum(sure) / len(sure) if sure else 0.0


def assemble_texts(members: DataFrame) -> DataFrame:
    """page_id, article_id, text, confidence."""

    def run(page: list[Block]) -> Iterator[tuple]:
        for article in sorted({b.article_id for b in page}):
            text, sure = article_text([b for b in page if b.article_id == article])
            yield article, text, round(sure, 6)

    return per_page(members, run, "article_id int, text string, confidence double")


# Detections that repeat or enclose others


def merge_duplicates(blocks: DataFrame) -> DataFrame:
    """page_id, block_id, kept_id: of two boxes that share 0.9 of the smaller and say the same, the less sure one goes (kept_id is the other)."""

    def run(page: list[Block]) -> Iterator[tuple]:
        gone: dict[int, int] = {}
        for i, a in enumerate(page):
            for b in page[i + 1 :]:
                if a.block_id in gone or b.block_id in gone or common(a, b) < 0.9 * max(1, min(area(a), area(b))):
                    continue
                s, t = (a.text or "").strip().lower(), (b.text or "").strip().lower()
                if s in t or t in s or SequenceMatcher(None, s, t).ratio() >= 0.6:
                    loser, winner = (a, b) if (a.ocr_confidence or 0.0) < (b.ocr_confidence or 0.0) else (b, a)
                    gone[loser.block_id] = winner.block_id
        yield from sorted(gone.items())

    return per_page(blocks, run, "block_id int, kept_id int")


def enclosures(blocks: DataFrame) -> DataFrame:
    """page_id, block_id of text blocks that enclose others; title_y2: where the title ends that is carved from its top (null: none)."""

    def run(page: list[Block]) -> Iterator[tuple]:
        texts = [b for b in page if b.cls in ("plain text", "title", "figure_caption")]
        for b in texts:
            held = sorted((o for o in texts if o is not b and area(o) < area(b) and common(o, b) >= 0.6 * max(1, area(o))), key=lambda o: (o.y1, o.x1, o.block_id))
            apart: list[Block] = []
            for o in held:
                if all(common(o, k) == 0 for k in apart):
                    apart.append(o)
            room = held[0].y1 - b.y1 if held else 0
            if len(apart) >= 2 or (len(apart) == 1 and room >= 20):
                yield b.block_id, len(apart), held[0].y1 if room >= 20 else None

    return per_page(blocks, run, "block_id int, n_enclosed int, title_y2 int")


# Figures and captions


def pair_figures(page: list[Block]) -> list[tuple[int, int, int]]:
    """One-to-one pairs (figure, caption, gap), the least gap first: from -20 to the larger of 150 and half the figure's height."""
    found = []
    for f in (b for b in page if b.cls in IMAGES):
        for c in (b for b in page if b.cls == "figure_caption"):
            d = c.y1 - f.y2
            if shared_width(f, c) and -20 <= d <= max(150, 0.5 * (f.y2 - f.y1)):
                found.append((d, f.block_id, c.block_id))
    out, used = [], set()
    for d, f, c in sorted(found):
        if ("f", f) not in used and ("c", c) not in used:
            used |= {("f", f), ("c", c)}
            out.append((f, c, d))
    return out


def figures_and_captions(blocks: DataFrame) -> DataFrame:
    """page_id, figure_id, caption_id, gap."""
    return per_page(blocks, pair_figures, "figure_id int, caption_id int, gap int")


# Boxes beside a dominant article


def absorb_page(page: list[Block]) -> dict[int, int]:
    """article_id to the article that takes it in: rows of side boxes go to the one dominant parent they adjoin, then single boxes to grown parents."""
    rect = {b.article_id: b for b in page}
    into: dict[int, int] = {}

    def parent(box: Block, barred: set[int], candidates: Iterable[int]) -> int | None:
        fits = []
        for i in candidates:
            p = rect[i]
            level = abs(p.y1 - box.y1) <= 40 or abs(p.y2 - box.y2) <= 40 or (p.y1 <= box.y1 and p.y2 >= box.y2)
            side = max(p.x1, box.x1) - min(p.x2, box.x2)
            if i not in barred and level and 0 <= side <= 20 and area(p) >= 2 * max(1, area(box)) and box.x2 - box.x1 <= 0.8 * (p.x2 - p.x1):
                fits.append(i)
        return fits[0] if len(fits) == 1 else None

    grown: set[int] = set()
    while True:
        live = [rect[i] for i in sorted(rect) if i not in into]
        rows = [g for g in components(live, lambda a, b: abs(a.y1 - b.y1) <= 20 and abs(a.y2 - b.y2) <= 20 and col_overlap(a, b) <= 0.2) if len(g) > 1]
        done = True
        for g in rows:
            ids = {b.article_id for b in g}
            p = parent(union(g), ids, [b.article_id for b in live])
            if p is not None:
                for b in g:
                    into[b.article_id] = p
                rect[p] = union([rect[p], *g])
                grown.add(p)
                done = False
                break
        if done:
            for b in live:
                p = parent(b, {b.article_id}, sorted(grown - set(into)))
                if p is not None:
                    into[b.article_id] = p
                    rect[p] = union([rect[p], b])
                    done = False
                    break
        if done:
            return into


def absorb_sideboxes(rects: DataFrame) -> DataFrame:
    """page_id, article_id, parent_id."""
    return per_page(rects, lambda page: sorted(absorb_page(page).items()), "article_id int, parent_id int", order=("y1", "x1", "article_id"))
