"""Text rules as column expressions. A null text counts as empty everywhere."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions import lexicons as X

DEVANAGARI = r"[\x{0900}-\x{097F}]"
WORD = "[A-Za-z\\x{0900}-\\x{097F}]+"


def text_of(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


#: All characters that count as white space.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.btrim(text_of(c), F.lit(WHITE))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(c: Column | str) -> Column:
    return F.filter(F.split(text_of(c), r"(?U)\s+"), lambda w: w != "")


def first_words(c: Column | str, n: int) -> Column:
    """The first n words: the rest of the text is not split."""
    return F.slice(F.filter(F.split(text_of(c), r"(?U)\s+", n + 2), lambda w: w != ""), 1, n)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def matches_any(c: Column, patterns: list[str]) -> Column:
    return any_of([c.rlike(p) for p in patterns])


def contains_any(c: Column, parts: list[str]) -> Column:
    return any_of([c.contains(p) for p in parts])


def points(test: Column, value: float) -> Column:
    return F.when(test, F.lit(value)).otherwise(F.lit(0.0))


def count_of(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.translate(c, char, ""))


def heading_score(c: Column | str) -> Column:
    """How much a text looks like a headline, 0 to 1."""
    t = strip(c)
    w = words(t)
    n = F.size(w)
    capital = F.size(F.filter(w, lambda x: (F.length(x) > 1) & x.rlike(r"^\p{Lu}")))
    ends = F.right(t, F.lit(1))
    score = (
        points(n <= 10, 0.35) + points((n > 0) & (capital > 0.70 * n), 0.35) + points(~F.lit(X.TERMINAL).contains(ends), 0.20) + points(count_of(t, ",") <= 1, 0.10)
        - points(n > 15, 0.40) - points(ends.isin(".", "।", "॥"), 0.30) - points(F.length(t) > 100, 0.20) - points(count_of(t, ".।") > 1, 0.20) - points(count_of(t, ",") > 2, 0.10)
    )
    return F.when(t == "", F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))))


def caption_score(c: Column | str) -> Column:
    """How much a text looks like a picture caption, 0 to 1."""
    t = strip(c)
    low, n, ends = F.lower(t), F.size(words(t)), F.right(t, F.lit(1))
    prefix = any_of([low.startswith(p) for p in X.CAPTION_PREFIXES] + [t.startswith(p) for p in X.CAPTION_PREFIXES_DEVANAGARI])
    agency = contains_any(low, X.AGENCIES) | contains_any(t, X.AGENCIES_DEVANAGARI)
    score = points(prefix, 0.45) + points(agency, 0.35) + points(n.between(4, 18), 0.15) + points(ends.isin(".", "।", "॥"), 0.05)
    return F.when((t == "") | (n > 25), F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


def jump_score(c: Column | str) -> Column:
    """How much a text looks like a line that sends the reader to another page, 0 to 1."""
    t = text_of(c)
    low = F.lower(t)
    score = points(matches_any(low, X.JUMP_PATTERNS) | matches_any(t, X.JUMP_PATTERNS_DEVANAGARI), 0.60) + points(low.rlike(X.JUMP_PAGE) | t.rlike(X.JUMP_PAGE_DEVANAGARI), 0.30) + points(F.size(words(low)) <= 8, 0.10)
    return F.when(t == "", F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


def language(c: Column | str) -> Column:
    """hi, en or unknown, by letters."""
    t = text_of(c)
    deva, latin = F.regexp_count(t, F.lit(DEVANAGARI)), F.regexp_count(t, F.lit("[A-Za-z]"))
    return F.when(deva > latin, "hi").when(latin > 0, "en").otherwise("unknown")


#: Scripts in order of preference on ties.
SCRIPTS = [("devanagari", "\\x{0900}-\\x{097F}"), ("bengali", "\\x{0980}-\\x{09FF}"), ("gujarati", "\\x{0A80}-\\x{0AFF}"), ("tamil", "\\x{0B80}-\\x{0BFF}"), ("telugu", "\\x{0C00}-\\x{0C7F}"), ("latin", "A-Za-z")]


def dominant_script(c: Column | str) -> Column:
    """The script with most letters, the first on ties; null without any."""
    t = text_of(c)
    counts = [(F.regexp_count(t, F.lit(f"[{r}]")), name) for name, r in SCRIPTS]
    most = F.greatest(*(n for n, _ in counts))
    return F.when(most > 0, F.coalesce(*(F.when(n == most, name) for n, name in counts)))


def sentence_features(c: Column | str) -> Column:
    """Struct: first and last sentence and word, whether it starts in lower case and ends in punctuation."""
    t = strip(c)
    sentences = F.filter(F.split(t, r"(?<=[.!?।॥])\s+"), lambda s: s != "")
    found = F.regexp_extract_all(t, F.lit(f"({WORD})"), 1)
    at = lambda a, i: F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(""))
    return F.struct(
        at(sentences, 1).alias("first_sentence"), at(sentences, -1).alias("last_sentence"), at(found, 1).alias("first_word"), at(found, -1).alias("last_word"),
        t.rlike(r"^\p{Ll}").alias("starts_with_lowercase"), (F.lit(".!?:;।॥").contains(F.right(t, F.lit(1))) & (t != "")).alias("ends_with_punctuation"),
    )


PHRASE = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"


def entities(c: Column | str) -> Column:
    """Struct of sorted distinct people, organizations, places (always none) and dates."""
    t = text_of(c)
    phrases = F.regexp_extract_all(t, F.lit(PHRASE), 1)
    first = lambda p: F.split(p, r"\s+")[0]
    dates = F.concat(F.filter(phrases, lambda p: first(p).isin(X.MONTHS)), F.regexp_extract_all(t, F.lit(rf"(\d{{1,2}}\s+(?:{'|'.join(X.MONTHS)})\s+\d{{4}})"), 1))
    people = F.filter(phrases, lambda p: p.rlike(r"\s") & ~first(p).isin(X.MONTHS))
    none = F.array().cast("array<string>")
    named = lambda k: F.when(t.contains(k), F.regexp_extract_all(t, F.lit(f"([A-Z][A-Za-z& ]+{k})"), 1)).otherwise(none)
    organizations = F.flatten(F.array(*(named(k) for k in X.ORGANISATIONS)))
    tidy = lambda a: F.array_sort(F.array_distinct(a))
    return F.struct(tidy(people).alias("people"), tidy(organizations).alias("organizations"), none.alias("places"), tidy(dates).alias("dates"))


def sentiment(c: Column | str) -> Column:
    w = F.regexp_extract_all(F.lower(text_of(c)), F.lit("([a-z']+)"), 1)
    pos, neg = F.size(F.filter(w, lambda x: x.isin(X.POSITIVE))), F.size(F.filter(w, lambda x: x.isin(X.NEGATIVE)))
    return F.when((pos < 2) & (neg < 2), "neutral").when((pos >= 1.5 * neg) & (pos >= 2), "positive").when((neg >= 1.5 * pos) & (neg >= 2), "negative").otherwise("neutral")


def match_text(c: Column | str) -> Column:
    """Lower case, letters, digits and _ only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text_of(c)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def match_tokens(c: Column | str) -> Column:
    """Words of three letters and more that are not stop words, repeats included."""
    return F.filter(F.split(match_text(c), " "), lambda w: (F.length(w) >= 3) & ~w.isin(X.STOP_WORDS))


def trigrams(tokens: Column) -> Column:
    """Distinct runs of three tokens, joined by spaces."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - 2), lambda i: F.array_join(F.slice(tokens, i, 3), " "))
    return F.when(F.size(tokens) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def share(a: Column, b: Column, base) -> Column:
    """Shared distinct items over base(of both), 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / base(a, b)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return share(a, b, lambda x, y: F.size(F.array_union(x, y)))


def min_share(a: Column, b: Column) -> Column:
    return share(F.array_distinct(a), F.array_distinct(b), lambda x, y: F.least(F.size(x), F.size(y)))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one (an empty group is no match)."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def jump_page(*candidates: Column) -> Column:
    """The page that a text sends to: for each candidate in turn, the phrase pattern, then the bare page."""

    def page(c: Column) -> Column:  # a phrase ends in a bare page, so it is sought only where there is one; what a match may begin with saves trying it elsewhere
        phrase = first_match(text_of(c), f"(?iu)(?=[mcrfts]){X.TARGET_PHRASE}")
        return bind(first_match(text_of(c), f"(?iu)(?=p){X.TARGET_PAGE}"), lambda bare: F.when(bare.isNotNull(), F.coalesce(phrase, bare)))

    return F.coalesce(*(page(c) for c in candidates)).try_cast("int")


def jump_slug(marker: Column | str) -> Column:
    slug = first_match(text_of(marker), f"(?iu){X.JUMP_SLUG}")
    return F.nullif(F.regexp_replace(slug, r"^[ \-–—:,.]+|[ \-–—:,.]+$", ""), F.lit(""))


def continuation(c: Column | str) -> Column:
    """Struct: is_continued, marker, next_page of an article's text."""
    t = text_of(c)
    lines = F.split(F.regexp_replace(t, r"\n$", ""), "\n")
    tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), 3), "\n")
    page = jump_page(t)
    marker = F.when(page.isNotNull(), F.nullif(strip(F.regexp_extract(t, f"(?iu){X.TARGET_MARKER}", 0)), F.lit("")))
    return F.struct((page.isNotNull() | (jump_score(tail) >= 0.5)).alias("is_continued"), marker.alias("marker"), page.alias("next_page"))


def lines_of(c: Column | str) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text_of(c), r"\n"), strip), lambda x: x != "")


def author(c: Column | str) -> Column:
    """Byline or agency in the first three and last two lines: e-mail, then byline, then agency."""
    lines = lines_of(c)
    near = F.concat(F.slice(lines, 1, 3), F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), 2))
    first = lambda f: F.try_element_at(F.filter(F.transform(near, f), lambda x: x.isNotNull()), F.lit(1))
    mail = first(lambda x: F.when(x.rlike(X.BYLINE_EMAIL), F.concat(F.regexp_extract(x, X.BYLINE_EMAIL, 1), F.lit("@"), F.regexp_extract(x, X.BYLINE_EMAIL, 2))))
    trim = lambda x: F.nullif(F.regexp_replace(x, r"^[ .]+|[ .]+$", ""), F.lit(""))
    named = first(lambda x: F.coalesce(trim(first_match(x, f"(?iu){X.BYLINE}")), trim(first_match(x, X.BYLINE_ROLE))))
    agency = first(lambda x: F.array_min(F.array_intersect(F.regexp_extract_all(F.upper(x), F.lit("([A-Z]+)"), 1), F.array(*(F.lit(a.upper()) for a in X.AGENCIES)))))
    return F.coalesce(mail, named, agency)


def dateline(c: Column | str) -> Column:
    """Struct: location and date of the first of the first six lines that opens like a dateline."""

    def one(x: Column) -> Column:
        place = F.trim(F.regexp_extract(x, X.DATELINE, 1))
        trusted = F.upper(place).isin(X.GAZETTEER) | (F.size(words(place)) <= 3)
        return F.when((place != "") & trusted, F.struct(place.alias("location"), F.nullif(F.trim(F.regexp_extract(x, X.DATELINE, 2)), F.lit("")).alias("date")))

    return F.try_element_at(F.filter(F.transform(F.slice(lines_of(c), 1, 6), one), lambda x: x.isNotNull()), F.lit(1))


def content_type(c: Column | str, caption: Column, has_figure: Column) -> Column:
    t = strip(c)
    n = F.length(t)
    digits = F.regexp_count(t, F.lit(r"\p{Nd}"))
    return (
        F.when((caption >= 0.55) & has_figure, "photo_caption").when((n < 40) & ((n == 0) | (digits > n * 0.4)), "reference")
        .when(matches_any(t, X.ADVERTISEMENT), "advertisement").when(n < 15, "other").otherwise("article")
    )


def titleless(headline: Column | str) -> Column:
    plain = F.array_join(words(F.lower(text_of(headline))), " ")
    return (plain == "") | plain.isin(X.TITLELESS)


def target_eligible(kind: Column, text: Column, headline: Column) -> Column:
    """A record may be where a story goes on."""
    plain = F.array_join(words(F.lower(text_of(headline))), " ")
    return (F.lower(strip(kind)) == "article") & (F.length(strip(text)) >= 120) & ~plain.isin(X.GENERIC_HEADLINES)


def source_eligible(kind: Column, text: Column, page: Column) -> Column:
    """A record may be where a story breaks off."""
    k = F.lower(strip(kind))
    return ((k == "article") & (F.length(strip(text)) >= 60)) | (k.isin("photo_caption", "reference") & page.isNotNull())


#: Fixed value: characters of a text on its side of the break that its scores go by.
NEAR_BREAK = 1800


def text_overlap(source: Column, target: Column) -> Column:
    """Struct: parts of the text score of two texts (the end of one, the beginning of the other) but for the characters, shared tokens, whether both have any."""
    tokens = F.struct(match_tokens(F.right(text_of(source), F.lit(NEAR_BREAK))).alias("a"), match_tokens(F.left(text_of(target), F.lit(NEAR_BREAK))).alias("b"))
    sets = bind(tokens, lambda t: F.struct(F.array_distinct(t["a"]).alias("x"), F.array_distinct(t["b"]).alias("y"), trigrams(t["a"]).alias("g"), trigrams(t["b"]).alias("h")))
    return bind(sets, _overlap)


def _overlap(sets: Column) -> Column:
    x, y = sets["x"], sets["y"]
    shared = F.size(F.array_intersect(x, y))
    jac, tri, least = jaccard(x, y), min_share(sets["g"], sets["h"]), min_share(x, y)
    empty = (F.size(x) == 0) | (F.size(y) == 0)
    zero = F.lit(0.0)
    return F.struct(F.when(empty, zero).otherwise(jac).alias("jaccard"), F.when(empty, zero).otherwise(tri).alias("trigram"), F.when(empty, zero).otherwise(least).alias("min_share"), shared.alias("shared"), (~empty).alias("comparable"))


def readability(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.6, "medium").otherwise("low")


def uuid5(namespace: str, value: Column) -> Column:
    """UUIDv5 of the archive's name for a value, in the URL namespace."""
    name = F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(F.concat(F.lit(f"newspaper-archive:{namespace}:"), value), "UTF-8"))
    h = F.sha1(name)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def iso_date(c: Column) -> Column:
    return F.try_to_date(F.substring(strip(c), 1, 10), "yyyy-MM-dd")


def unique_date(c: Column | str) -> Column:
    """The one date that a text names in any of three notations; null if none or several."""
    t = text_of(c)
    month = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in X.MONTHS) + r")"
    parse = lambda pattern, fmt, order: F.transform(F.regexp_extract_all(t, F.lit(f"(?i)({pattern})"), 1), lambda x: order(x, pattern, fmt))
    named = lambda m: F.initcap(F.substring(F.lower(m), 1, 3))
    month_first = rf"{month}\.?\s+(\d{{1,2}}),?\s+(\d{{4}})"
    day_first = rf"(\d{{1,2}})\s+{month}\.?,?\s+(\d{{4}})"
    numeric = r"(\d{1,2})/(\d{1,2})/(\d{4})"
    get = lambda x, p, k: F.regexp_extract(x, f"(?i){p}", k)
    of = lambda d, m, y: F.try_to_date(F.concat_ws(" ", d, m, y), "d MMM yyyy")
    found = F.concat(
        parse(month_first, "", lambda x, p, _: of(get(x, p, 2), named(get(x, p, 1)), get(x, p, 3))),
        parse(day_first, "", lambda x, p, _: of(get(x, p, 1), named(get(x, p, 2)), get(x, p, 3))),
        parse(numeric, "", lambda x, p, _: F.try_to_date(x, "d/M/yyyy")),
    )
    dates = F.array_distinct(F.filter(found, lambda d: d.isNotNull()))
    return F.when(F.size(dates) == 1, F.get(dates, F.lit(0)))


def image_url(path: Column | str) -> Column:
    p = F.regexp_replace(text_of(path), r"\\", "/")
    at = F.locate("/output/", p)
    return F.when(p == "", F.lit(None).cast("string")).when(at > 0, F.substr(p, at)).when(p.startswith("output/"), F.concat(F.lit("/"), p))


def safe_int(c: Column) -> Column:
    return F.when(strip(c).rlike(r"^[+-]?\d+$"), strip(c).try_cast("int"))


def paragraphs(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(text_of(c), r"\n\s*\n"), strip), lambda x: x != "")


def natural_key(article_id: Column) -> Column:
    """Struct that sorts article_N by N before all other ids."""
    n = F.regexp_extract(article_id, r"^article_(\d+)$", 1)
    return F.struct(F.when(n != "", 0).otherwise(1).alias("kind"), n.try_cast("bigint").alias("number"), article_id.alias("id"))
