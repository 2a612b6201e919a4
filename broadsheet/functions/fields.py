"""Fields of article records as column expressions: aliases, dates, images, slugs, pagination, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions import lexicons as X
from broadsheet.functions import text as T


def first_value(*columns: Column | str, default: str | None = None) -> Column:
    """the first that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.nullif(T.strip(c), F.lit("")) for c in columns), F.lit(default))


MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in X.MONTHS) + ")"


def _date(month: Column, day: Column, year: Column) -> Column:
    return F.try_to_date(F.concat_ws(" ", day, F.initcap(F.substring(F.lower(month), 1, 3)), year), "d MMM yyyy")


def article_date(stated: Column | str, text: Column | str, year: Column) -> Column:
    """an ISO date; else "Month d, yyyy" anywhere in what is stated; else just "Month d" with the paper's year; else a dateline in the first 1000
    characters of the text, with its own year or the paper's."""
    s, t = T.strip(stated), F.left(T.text_of(text), F.lit(1000))
    full, short = rf"(?i){MONTH}\.?\s+(\d{{1,2}}),?\s+(\d{{4}})", rf"(?i)^{MONTH}\.?\s+(\d{{1,2}})$"
    line = rf"(?i),\s*{MONTH}\.?\s+(\d{{1,2}})(?:,?\s*(\d{{4}}))?\s*[:—-]"
    get = lambda c, p, k: F.regexp_extract(c, p, k)
    y = year.cast("string")
    return F.coalesce(
        T.iso_date(s), F.when(s.rlike(full), _date(get(s, full, 1), get(s, full, 2), get(s, full, 3))), F.when(s.rlike(short), _date(get(s, short, 1), get(s, short, 2), y)),
        F.when(t.rlike(line), _date(get(t, line, 1), get(t, line, 2), F.coalesce(F.nullif(get(t, line, 3), F.lit("")), y))),
    )


IMAGE = "image_id: STRING, caption: STRING, confidence: STRING"


def image_items(json: Column | str) -> Column:
    """F32: array of images from a list, an object with items, or one object; confidence a number or null; nothing else gives none."""
    t = T.strip(json)
    one = f"STRUCT<{IMAGE}>"
    rows = F.when(t.startswith("["), F.from_json(t, f"ARRAY<{one}>"))
    held = F.when(t.startswith("{"), F.from_json(t, f"items ARRAY<{one}>")["items"])
    single = F.when(t.startswith("{"), F.array(F.from_json(t, IMAGE.replace(":", ""))))
    found = F.coalesce(rows, held, single, F.array().cast(f"array<{one}>"))
    kept = F.filter(found, lambda x: x["image_id"].isNotNull() | x["caption"].isNotNull())
    return F.transform(kept, lambda x: F.struct(x["image_id"].alias("image_id"), x["caption"].alias("caption"), x["confidence"].try_cast("double").alias("confidence")))


def slug(c: Column | str) -> Column:
    """letters and digits in lower case, joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(T.text_of(c)), r"[^a-z0-9]+", "_"), "^_+|_+$", "")


def padded(x1: Column, y1: Column, x2: Column, y2: Column, by: float = 0.02) -> Column:
    """a box of page fractions, widened and clamped to the page."""
    lo, hi = lambda v: F.greatest(v - by, F.lit(0.0)), lambda v: F.least(v + by, F.lit(1.0))
    return F.struct(lo(x1).alias("x1"), lo(y1).alias("y1"), hi(x2).alias("x2"), hi(y2).alias("y2"))


def page_links(current: Column, last: Column) -> Column:
    """Page numbers to show: first, last and those beside the current one; 0 stands for what is left out."""
    shown = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda p: (p == 1) | (p == last) | (F.abs(p - current) <= 1))
    return F.flatten(F.transform(shown, lambda p, i: F.when(F.coalesce(p - F.get(shown, i - 1) > 1, F.lit(False)), F.array(F.lit(0), p)).otherwise(F.array(p))))


def tags(topics: Column, keywords: Column) -> Column:
    """The first three of topics, then keywords, that are not blank."""
    return F.slice(F.filter(F.concat(topics, keywords), lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), 1, 3)


def highlighted(c: Column, word: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """the word marked wherever it stands, in any case."""
    return F.regexp_replace(c, f"(?iu)({_quoted(word)})", f"{before}$1{after}") if word else c


def _quoted(word: str) -> str:
    return r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


# F40, what a model's failure is called.
FAILURES = {401: "The AI key is invalid.", 403: "The AI key has no permission.", 429: "The AI quota is used up.", 500: "The AI service failed.", 503: "The AI service is overloaded."}


def failure(status: Column, retry_after: Column) -> Column:
    """what to tell of a failed call, and how long to wait if that is known."""
    said = F.coalesce(*(F.when(status == k, v) for k, v in FAILURES.items()), F.lit("The AI request failed."))
    return F.concat(said, F.when(retry_after.isNotNull(), F.concat(F.lit(" Try again in "), F.ceil(retry_after).cast("string"), F.lit(" s."))).otherwise(""))
