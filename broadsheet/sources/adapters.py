"""Boundaries to what needs pixels, neural weights or a paid model: typed interfaces that recorded rows can stand in for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name: (input columns, output schema).
CONTRACTS = {
    "layout": ("page_id, image", "page_id long, block_id int, cls string, x1 int, y1 int, x2 int, y2 int, confidence double"),
    "ocr": ("page_id, block_id, image", "page_id long, block_id int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"),
    "separators": ("page_id, block_id, image", "page_id long, block_id int, has_rule_above boolean, has_rule_below boolean, has_bar_left boolean, has_bar_right boolean"),
    "grouping": ("page_id, blocks", "page_id long, article_id int, block_id int, role string"),
    "extraction": ("page_id, article_id, image", "page_id long, article_id int, headline string, article_text string, content_type string, category string, sentiment string"),
    "newspaper": ("document_id, image", "document_id string, newspaper_name string, edition string, publish_date string, language string"),
    "embedding": ("id, text", "id long, embedding array<float>"),
}


@dataclass
class Adapters:
    """Recorded answers by contract; a contract without a recording raises when it is asked."""

    recorded: dict[str, DataFrame] = field(default_factory=dict)

    def ask(self, contract: str, rows: DataFrame, key: list[str]) -> DataFrame:
        if contract not in CONTRACTS:
            raise KeyError(contract)
        if contract not in self.recorded:
            raise NotImplementedError(f"{contract} needs a model or images: record rows of {CONTRACTS[contract][1]}")
        return self.recorded[contract].join(rows.select(*key).distinct(), key, "left_semi")


def cache_key(text: Column) -> Column:
    """what an embedding is cached by."""
    return F.sha2(text, 256)


def ctc_decode(indices: Column, blank: int = 0) -> Column:
    """Repeats collapse, blanks go."""
    return F.filter(indices, lambda x, i: (x != blank) & (F.coalesce(F.get(indices, i - 1), F.lit(-1)) != x))


def ink_bands(profile: Column, least: float = 0.03, bridge: int = 3) -> Column:
    """Array of (first, last) rows of ink in a page's row profile; gaps of up to `bridge` rows are bridged."""
    rows = F.filter(F.transform(profile, lambda v, i: F.when(v >= least, i)), lambda i: i.isNotNull())
    starts = F.filter(rows, lambda r, k: F.coalesce(r - F.get(rows, k - 1) > bridge + 1, F.lit(True)))
    ends = F.filter(rows, lambda r, k: F.coalesce(F.get(rows, k + 1) - r > bridge + 1, F.lit(True)))
    return F.arrays_zip(starts.alias("first"), ends.alias("last"))


def strip_size(widths: Column, heights: Column, most: int = 1000, gap: int = 20, padding: int = 20) -> Column:
    """Struct of the canvas on which images of one article stand side by side, at a common height."""
    h = F.least(F.array_max(heights), F.lit(most))
    each = F.zip_with(widths, heights, lambda w, x: F.greatest(F.bround(w * h / x), F.lit(1)))
    width = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) + gap * (F.size(widths) - 1) + 2 * padding
    return F.struct(width.cast("int").alias("width"), (h + 2 * padding).cast("int").alias("height"))
