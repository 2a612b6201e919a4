"""Continuations: links between articles that belong together, their cleaning, scoring, one-to-one matching and merging into logical articles."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from broadsheet.functions import text as T
from broadsheet.functions.lexicons import STOP_WORDS as STOPS
from broadsheet.operators.archive import first_wins
from broadsheet.operators.graph import connected_components
from broadsheet.operators.grouping import per_page


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of two texts (2 x matches over both lengths, without junk heuristics): what difflib gives, in about a twelfth of its time.

    The longest common run (the first in a, then in b, of equal ones) counts, then those left and right of it. As no earlier run was as long, what lies left
    of it has shorter ones only; a search ends as soon as it has a run of the greatest length possible.
    """
    find, matches = b.find, 0
    todo = [(0, len(a), 0, len(b), len(a))]
    while todo:
        a0, a1, b0, b1, most = todo.pop()
        most = min(most, a1 - a0, b1 - b0)
        size, at, to, i = 0, a0, b0, a0
        while size < most and i + size < a1:
            j = find(a[i : i + size + 1], b0, b1)
            while j >= 0:
                size, at, to = size + 1, i, j
                end = min(a1 - i, b1 - j)
                while size < end and a[i + size] == b[j + size]:
                    size += 1
                j = find(a[i : i + size + 1], j + 1, b1) if i + size < a1 else -1
            i += 1
        if size:
            matches += size
            todo += [(a0, at, b0, to, size - 1), (at + size, a1, to + size, b1, size)]
    return 2.0 * matches / (len(a) + len(b)) if a or b else 1.0


def ratio_udf():
    """ratio() in Arrow batches; a null text: 0."""

    @F.arrow_udf("double")
    def ratios(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([0.0 if x is None or y is None else ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return ratios


STOP_WORDS = frozenset(STOPS)
PHRASES, WORDS = re.compile(T.PHRASE, re.ASCII), re.compile("[A-Za-z]{4,}")


def keywords(text: str, most: int = 10) -> list[str]:
    """T05 of one text, in order of rank: capitalised phrases by count, then words of four letters found twice; the first of equal spellings stays."""
    words: Counter[str] = Counter()
    for w, n in Counter(WORDS.findall(text)).items():
        words[w.lower()] += n
    ranked = Counter(PHRASES.findall(text)).most_common() + [(w, n) for w, n in words.most_common() if n >= 2 and w not in STOP_WORDS]
    first: dict[str, str] = {}
    for k, _ in ranked:
        first.setdefault(k.lower(), k)
    return list(first.values())[:most]


def keywords_udf():
    """keywords() in Arrow batches, without a row for each word; a null text: none."""

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([keywords(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    return found


def overlap(a: str, b: str) -> tuple[float, float, float, int, bool]:
    """Of the match texts of a source's end and a target's beginning, what functions.text.text_overlap gives."""
    s, t = ([w for w in x.split(" ") if len(w) >= 3 and w not in STOP_WORDS] for x in (a, b))
    x, y = set(s), set(t)
    if not x or not y:
        return 0.0, 0.0, 0.0, 0, False
    g, h = (set(zip(w, w[1:], w[2:])) for w in (s, t))  # noqa: B905
    both = len(x & y)
    return both / len(x | y), len(g & h) / min(len(g), len(h)) if g and h else 0.0, both / min(len(x), len(y)), both, True


def overlap_udf():
    """overlap() in Arrow batches."""
    kind = StructType.fromDDL("jaccard double, trigram double, min_share double, shared int, comparable boolean")
    fields = list(to_arrow_schema(kind))

    @F.arrow_udf(kind)
    def overlaps(a: pa.Array, b: pa.Array) -> pa.Array:
        columns = list(zip(*map(overlap, a.to_pylist(), b.to_pylist()), strict=True)) or [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)

    return overlaps


def merge_texts(texts: list[str | None]) -> str:
    """texts one after another without what they repeat: equal or contained ones go, containing ones replace, common ends of 5 to 100 words merge."""
    out = ""
    for t in texts:
        t = (t or "").strip()
        if not t or t in out:
            continue
        if out in t:
            out = t
            continue
        have, more = out.split(), t.split()
        n = next((k for k in range(min(100, len(have), len(more)), 4, -1) if have[-k:] == more[:k]), 0)
        out = f"{out} {' '.join(more[n:])}".strip() if n else f"{out}\n\n{t}"
    return out


def merged_texts(segments: DataFrame) -> DataFrame:
    """logical_id, article_text of segments in order, without overlaps."""

    @F.arrow_udf("string")
    def merge(texts: pa.Array) -> pa.Array:
        return pa.array([merge_texts(x or []) for x in texts.to_pylist()], pa.string())

    lists = segments.groupBy("logical_id").agg(F.array_sort(F.collect_list(F.struct("segment_order", "article_text"))).alias("s"))
    return lists.select("logical_id", merge(F.col("s")["article_text"]).alias("article_text"))


def clean_links(links: DataFrame, known: DataFrame, least: float = 0.75) -> DataFrame:
    """Known ends, not to itself, sure enough, each source and each target once (the surest link first, then the smaller ids)."""
    ids = known.select(F.col("article_id").alias("source_id"))
    ok = links.filter((F.col("source_id") != F.col("target_id")) & (F.col("confidence") >= least))
    ok = ok.join(ids, "source_id", "left_semi").join(ids.withColumnRenamed("source_id", "target_id"), "target_id", "left_semi")
    order = [F.desc("confidence"), "source_id", "target_id"]
    return first_wins(first_wins(ok, ["source_id"], order), ["target_id"], order).select("source_id", "target_id", "confidence")


def logical_articles(articles: DataFrame, links: DataFrame) -> DataFrame:
    """article_id, logical_id (least article_id of the component), status: merged or standalone."""
    comp = connected_components(links, "source_id", "target_id")
    out = articles.select("article_id").join(comp.withColumnRenamed("node", "article_id"), "article_id", "left")
    return out.select("article_id", F.coalesce("component", "article_id").alias("logical_id"), F.when(F.col("component").isNull(), "standalone").otherwise("merged").alias("status"))


def candidates(sources: DataFrame, targets: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """A source's printed target page, by its document's page map or as it is, and the eligible articles on that page of the same document.

    Sources and targets: document_id, page, article_id, text, headline, and, if there, about (words of entities, topics and keywords); sources also
    next_page. `pages`: document_id, folio, page. A source's own page becomes own_page, a target's columns begin with target_. A source without a
    document or a page to go to has no candidates; repeated rows stay.
    """
    s = sources.withColumnRenamed("page", "own_page").withColumn("page", F.col("next_page"))
    if pages is not None:
        known = pages.groupBy("document_id", F.col("folio").alias("next_page")).agg(F.min("page").alias("mapped"))
        s = s.join(known, ["document_id", "next_page"], "left").withColumn("page", F.coalesce("mapped", "page")).drop("mapped")
    more = [c for c in ("about",) if c in targets.columns]
    t = targets.select("document_id", "page", *(F.col(c).alias(f"target_{c.removeprefix('article_')}") for c in ("article_id", "text", "headline", *more)))
    return s.join(t, ["document_id", "page"]).filter(F.col("article_id") != F.col("target_id"))


# Least score, shared tokens, text score and metadata score of an accepted link, by source and target.
ARTICLE, TITLELESS, SPECIAL = (0.25, 3, 0.20, 0.0), (0.22, 3, 0.20, 0.0), (0.22, 2, 0.12, 0.08)
CERTAIN_TEXT, CLEAR, SLUG_SHARED = 0.42, 0.045, 3


def _good(whole, text, meta, shared, limits: tuple[float, int, float, float], special: bool):
    """Whether scores reach their limits: of columns or of numbers."""
    score, words, least_text, least_meta = limits
    good = (whole >= score) & (shared >= words) & (text >= least_text)
    return good & ((meta >= least_meta) | (text >= CERTAIN_TEXT)) if special else good


def score(found: DataFrame, every: bool = False) -> DataFrame:
    """source_id, target_id, score, text_score, meta_score, shared and what acceptance needs: how well a target goes on from a source.

    `found` as from candidates(): article_id, text, headline, target_id, target_text, target_headline; if there, content_type (else article),
    jump_slug, about and target_about (arrays of tokens), own_page. Text score: 0.38 Jaccard, 0.27 trigrams, 0.20 characters around the break, 0.15 share
    of the smaller; 0 if either side has no tokens. Metadata: Jaccard of the tokens of `about`. Then 0.68 of the text and 0.32 of the metadata for captions
    and references, 0.72 and 0.28 for targets without a title, else 0.58 and 0.22 and 0.20 of the headlines. A slug of two words or more that the target's
    headline has in full gives 0.80 of its similarity and 0.20 of the text if that is more. Nulls are empty texts.

    Characters and headlines are compared one pair at a time, so (unless `every`) only where they can matter: headlines for sources of which some target
    could be accepted if both agreed fully, characters for the targets of those sources that could come within the margin of what the best one has without
    them. The other scores lack these parts, and are neither best nor near it either way.
    """
    ratio = ratio_udf()
    has = lambda c: c in found.columns
    kind = F.lower(T.strip("content_type")) if has("content_type") else F.lit("article")
    slug = T.text_of("jump_slug") if has("jump_slug") else F.lit("")
    none = F.array().cast("array<string>")
    about = T.jaccard(*(F.array_distinct(F.coalesce(c, none)) for c in ("about", "target_about"))) if has("about") and has("target_about") else F.lit(0.0)
    ends = found.withColumn("ending", T.match_text(F.right(T.text_of("text"), F.lit(T.NEAR_BREAK)))).withColumn("opening", T.match_text(F.left(T.text_of("target_text"), F.lit(T.NEAR_BREAK))))
    told = ends.withColumns({"o": overlap_udf()("ending", "opening"), "tail": F.right("ending", F.lit(900)), "start": F.left("opening", F.lit(900))})
    o = told.drop("text", "target_text", "ending", "opening").withColumn("bare", T.titleless("target_headline")).withColumn("meta", about)
    o = o.withColumn("special", F.coalesce(kind.isin("photo_caption", "reference"), F.lit(False))).withColumn("slug_tokens", T.match_tokens(slug)).withColumn("head", T.match_text("target_headline"))
    covered = (F.size("slug_tokens") >= 2) & (F.size(F.array_except("slug_tokens", T.match_tokens("target_headline"))) == 0)
    o = o.withColumn("strong_slug", covered).withColumn("is_article", F.coalesce(kind == "article", F.lit(False)))

    def whole(text: Column, heads: Column, slugs: Column) -> Column:
        plain = F.when(F.col("special"), 0.68 * text + 0.32 * F.col("meta")).when(F.col("bare"), 0.72 * text + 0.28 * F.col("meta")).otherwise(0.58 * text + 0.22 * F.col("meta") + 0.20 * heads)
        return F.least(F.lit(1.0), F.when(F.col("strong_slug"), F.greatest(plain, 0.80 * slugs + 0.20 * text)).otherwise(plain))

    sets = 0.38 * F.col("o.jaccard") + 0.27 * F.col("o.trigram") + 0.15 * F.col("o.min_share")
    one, slack, shared = F.lit(1.0), 1e-4, F.col("o.shared")
    highest = (whole(sets + 0.20, one, one) + slack, sets + 0.20 + slack, F.col("meta") + slack, shared)
    hopeful = F.when(F.col("special"), _good(*highest, SPECIAL, True)).when(F.col("bare"), _good(*highest, TITLELESS, False)).otherwise(_good(*highest, ARTICLE, False))
    hopeful = hopeful | (F.col("strong_slug") & (shared >= SLUG_SHARED))
    o = o.withColumn("open", F.lit(every) | F.max(hopeful).over(W.partitionBy("article_id")))
    filled = lambda c: F.nullif(c, F.lit(""))  # noqa: E731  (null: not compared)
    o = o.withColumn("heads", ratio(F.when(F.col("open") & F.col("is_article") & ~F.col("bare"), filled(T.match_text("headline"))), filled(F.col("head"))))
    o = o.withColumn("slugs", ratio(F.when(F.col("open") & F.col("strong_slug"), T.match_text(slug)), F.col("head")))
    sure = F.max(whole(sets, F.col("heads"), F.col("slugs"))).over(W.partitionBy("article_id"))
    near = F.lit(every) | (F.col("open") & (whole(sets + 0.20, F.col("heads"), F.col("slugs")) >= F.col("sure") - CLEAR - 2 * slack))
    o = o.withColumn("sure", sure).withColumn("chars", ratio(F.when(near & F.col("o.comparable"), F.col("tail")), F.col("start")))
    o = o.withColumn("text_score", F.least(F.lit(1.0), sets + 0.20 * F.col("chars")))
    rounded = lambda c, name: F.bround(c, 4).alias(name)
    page = [F.col("own_page").cast("long").alias("source_page")] if has("own_page") else []
    return o.select(
        F.col("article_id").alias("source_id"), "target_id", rounded(whole(F.col("text_score"), F.col("heads"), F.col("slugs")), "score"), rounded(F.col("text_score"), "text_score"),
        rounded(F.col("meta"), "meta_score"), F.col("o.shared").alias("shared"), F.col("bare").alias("titleless"), "special", "strong_slug", *page, *(["document_id"] if has("document_id") else []),
    )


def accepted(scored: DataFrame, documents: Column | None = None) -> DataFrame:
    """Document, source_id, target_id, score: sources of a document in the order of their pages and ids take their best target (score, then
    text, then metadata) if it is good enough, clearly ahead of the second, and free. A taken target leaves later sources without one.

    The document is `documents`, else the column document_id; rows without either are one document's and meet in one task.
    """
    optional = {"meta_score": F.lit(0.0), "special": F.lit(False), "strong_slug": F.lit(False), "source_page": F.lit(0)}
    full = scored.withColumns({c: v for c, v in optional.items() if c not in scored.columns})
    key = documents if documents is not None else F.col("document_id") if "document_id" in scored.columns else F.lit(0)

    def run(rows) -> Iterator[tuple]:
        taken: set[int] = set()
        by_source: dict[int, list] = {}
        for r in rows:
            by_source.setdefault(r.source_id, []).append(r)
        for source, targets in by_source.items():
            ranked = sorted(targets, key=lambda r: (-r.score, -r.text_score, -r.meta_score, r.target_id))
            best = ranked[0]
            clear = len(ranked) < 2 or best.score - ranked[1].score >= CLEAR
            limits = SPECIAL if best.special else TITLELESS if best.titleless else ARTICLE
            good = _good(best.score, best.text_score, best.meta_score, best.shared, limits, best.special) or (best.strong_slug and best.shared >= SLUG_SHARED)
            if clear and good and best.target_id not in taken:
                taken.add(best.target_id)
                yield source, best.target_id, best.score

    keyed = full.withColumn("document", key.cast("long")).drop("document_id")
    return per_page(keyed, run, "source_id long, target_id long, score double", key="document", order=("source_page", "source_id", "target_id"))


def pack(rows: list, limits: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """(batch, position) of rows in order: a batch ends before the row that would take it over either limit; a larger row is a batch of its own."""
    most, most_bytes = limits
    batch, n, size = 0, 0, 0
    for k, r in enumerate(rows):
        if n and (n + 1 > most or size + r.size > most_bytes):
            batch, n, size = batch + 1, 0, 0
        n, size = n + 1, size + r.size
        yield batch, k


def batches(rows: DataFrame, key: str, order: str, size: Column, most: int, most_bytes: int) -> DataFrame:
    """Key, order, batch."""
    sized = rows.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), size.cast("long").alias("size"))

    def run(group: list) -> Iterator[tuple]:
        for batch, k in pack(group, (most, most_bytes)):
            yield getattr(group[k], order), batch

    return per_page(sized, run, f"{order} long, batch int", key=key, order=(order,))
