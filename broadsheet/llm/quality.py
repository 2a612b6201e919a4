"""Quality rules: fixed limits on a text, then robust multivariate outliers within each language and source.

Statistics of whole texts, and the base rules on them, are plain expressions. What passes is turned into a vector of transformed statistics
(fixed-point, so that sums don't depend on their order). For each (lang, source) a minimum-covariance-determinant estimate follows from several starts:
medians with absolute deviations, all rows, and scatters of hyperbolic tangents and of spatial signs. Concentration steps take each to the centre and scatter
of the nearest COVER of the rows; after TRIAL_STEPS of them the start of least determinant goes on until no determinant falls any more. Each step is
one aggregation by (lang, source, start, distance bin), whose result gives both the quantile and the sums below it, so no group is ever collected; the last bin
counts whole. The scatter is made consistent with a normal distribution of all rows, and the sampling scatter of the statistics themselves is added to it (most
texts have no symbols and repeat nothing, so that the rows alone would have none). Rows beyond the chi-square quantile of CLEAN, by Mahalanobis distance, are rejected.

Null texts have no words and fail the base rules. Texts of any length are judged whole. Null lang and source are groups of their own. Groups of fewer than
LEAST_ROWS rows that pass the base rules are judged by the estimate of all such rows of their language, however few these are. Repeated rows count as often as
they occur; ties in distance fall into one bin. An empty table gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.llm.chat import bind
from broadsheet.storage import materialise

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20

SCALE = 10_000
COVER = 0.75
#: Steps of every start; steps that the best one takes at most.
TRIAL_STEPS, MOST_STEPS = 2, 20
#: A determinant that falls by less than this share has converged.
CONVERGED = 1e-6
LEAST_ROWS = 20
#: The share of a normal distribution's rows that would be kept.
CLEAN = 0.999999
#: Distance bins: this many to a doubling.
BINS_PER_OCTAVE = 16


def chi_square(x: float, k: int) -> float:
    """Share of a chi-square distribution of k degrees below x (the series of the incomplete gamma function)."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 1000):
        term *= z / (a + i)
        total += term
    return total * z**a * math.exp(-z) / math.gamma(a)


def chi_square_quantile(share: float, k: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < share else (low, middle)
    return low


def consistency(p: int, cover: float) -> float:
    """What the scatter of the nearest share of normal rows has to be multiplied by to be that of all of them."""
    return cover / chi_square(chi_square_quantile(cover, p), p + 2)


def statistics(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of every whole text; whole: and row, all columns."""
    more = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if whole else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE}]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("repeated"))).alias("w"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        *more,
    )
    out = rows.select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("w.repeated").alias("n_repeat_words"), *(["row"] if whole else []))
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more, the first occurrence included."""

    def covered(at: Column) -> Column:  # sorted first positions of such windows
        step = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def places(keyed: Column) -> Column:
        key = lambda i: F.get(keyed, i)["h"]
        twice = F.filter(keyed, lambda k, i: F.coalesce(key(i - 1) == k["h"], F.lit(False)) | F.coalesce(key(i + 1) == k["h"], F.lit(False)))
        return bind(F.sort_array(F.transform(twice, lambda k: k["i"])), covered)

    def windows(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(keyed, places))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(bind(hashes(words), windows)).cast("long")


#: The vector: name, expression, standard deviation that the statistic has by itself. Counts go by their square roots, which gives a count of any
#: size a deviation of one (repeated words count in windows found twice); word counts and mean word lengths by logarithms, with the deviations that they have in the shortest texts
#: judged, where a word's length deviates by half of the mean.
def features() -> list[tuple[str, Column, float]]:
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    root = lambda count: 2 * F.sqrt(count + 0.375)
    shortest = LEAST_WORDS**-0.5
    return [
        ("x0", F.log(n), shortest),
        ("x1", F.log(chars / n), 0.5 * shortest),
        ("x2", root(F.col("n_symbols")), 1.0),
        ("x3", root(F.col("n_repeat_words") / (2 * WINDOW)), 1.0),
        ("x4", root(F.col("n_dup_lines")), 1.0),
    ]


def cutoff() -> float:
    return math.sqrt(chi_square_quantile(CLEAN, len(features())))


def vectors(stats: DataFrame) -> DataFrame:
    """Fixed-point vectors of the rows that pass the base rules."""
    return stats.filter(~F.col("base_failed")).select("*", *(F.round(x * SCALE).cast("long").alias(name) for name, x, _ in features()))


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance of x from the centre m; w is the inverse of the scatter's Cholesky factor."""
    r = [F.col(f"x{i}") / SCALE - F.col(f"m{i}") for i in range(p)]
    return _sum(y * y for y in (_sum(F.col(f"w{i}_{j}") * r[j] for j in range(i + 1)) for i in range(p)))


KEY = ["lang", "source", "pooled"]


def _names(p: int) -> list[str]:
    return [*(f"m{i}" for i in range(p)), *(f"{c}{i}_{j}" for c in "lw" for i, j in _pairs(p))]


def _factor(moments: DataFrame, floors: list[float], scale: float) -> DataFrame:
    """Adds l, the Cholesky factor of scale * covariance + floors, w, its inverse, and the determinant; moments: columns m (centre), c (covariances)."""
    out, p, l, w = moments, len(floors), lambda i, j: F.col(f"l{i}_{j}"), lambda i, j: F.col(f"w{i}_{j}")  # noqa: E741
    for j in range(p):  # column by column, each entry from those before it
        left = lambda i, j=j: scale * F.col(f"c{i}_{j}") - _sum(l(i, k) * l(j, k) for k in range(j))
        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(left(j) + floors[j] ** 2, F.lit(floors[j] ** 2 / 4))))
        out = out.withColumns({f"l{i}_{j}": left(i) / l(j, j) for i in range(j + 1, p)})
    for i in range(p):
        out = out.withColumns({f"w{i}_{j}": (1.0 if i == j else -_sum(l(i, k) * w(k, j) for k in range(j, i))) / l(i, i) for j in range(i + 1)})
    return out.withColumn("det", reduce(lambda a, b: a * b, (l(i, i) ** 2 for i in range(p))))


def _sums(p: int) -> list[Column]:
    wide = lambda i: F.col(f"x{i}").cast("decimal(18,0)")  # noqa: E731  exact sums, whatever their order
    return [F.count(F.lit(1)).alias("n"), *(F.sum(wide(i)).alias(f"s{i}") for i in range(p)), *(F.sum(wide(i) * wide(j)).alias(f"q{i}_{j}") for i, j in _pairs(p))]


def _moments(sums: DataFrame, p: int) -> DataFrame:
    """Centre m and covariances c from counts, sums and sums of products."""
    n = F.col("n").cast("double")
    centred = sums.withColumns({f"m{i}": F.col(f"s{i}") / n / SCALE for i in range(p)})
    return centred.withColumns({f"c{i}_{j}": F.col(f"q{i}_{j}") / n / SCALE / SCALE - F.col(f"m{i}") * F.col(f"m{j}") for i, j in _pairs(p)})


def _nearest(by_bin: DataFrame, p: int) -> DataFrame:
    """Sums over each start's nearest bins, as many as hold COVER of the group's rows."""
    group = W.partitionBy(*KEY, "start")
    ranked = by_bin.withColumn("rows", F.sum("n").over(group)).withColumn("before", F.sum("n").over(group.orderBy("bin")) - F.col("n"))
    inside = ranked.filter(F.col("before") < F.ceil(F.col("rows") * COVER))
    return inside.groupBy(*KEY, "start", "rows").agg(*(F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(p)), *(f"q{i}_{j}" for i, j in _pairs(p)))))


def _with(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """rows joined to the estimates of their groups."""
    keys = [k for k in KEY if k in estimates.columns]
    renamed = estimates.withColumnsRenamed({k: f"of_{k}" for k in keys})
    return rows.join(renamed, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys)), "left").drop(*(f"of_{k}" for k in keys))


def _middles(x: DataFrame, floors: list[float]) -> DataFrame:
    """Medians m, and absolute deviations d from them, of each coordinate on a grid of a tenth of its least deviation."""

    def medians(values: DataFrame, weight: float) -> DataFrame:
        group = W.partitionBy(*KEY, "k")
        seen = values.groupBy(*KEY, "k", "v").agg(F.count(F.lit(1)).alias("n"))
        seen = seen.withColumn("rows", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("v")))
        return seen.filter(2 * F.col("upto") >= F.col("rows")).groupBy(*KEY, "k", "rows").agg((F.min("v") * weight).alias("v"))

    grid = [max(1, round(f * SCALE / 10)) for f in floors]
    long = x.select(*KEY, F.posexplode(F.array(*(F.round(F.col(f"x{i}") / g).cast("long") for i, g in enumerate(grid)))).alias("k", "v"))
    wide = lambda d, name: d.groupBy(*KEY, "rows").agg(*(F.max(F.when(F.col("k") == i, F.col("v") * g / SCALE)).alias(f"{name}{i}") for i, g in enumerate(grid)))
    at = materialise(wide(medians(long, 1.0), "m"), "mcd")
    off = _with(x, at).select(*KEY, F.posexplode(F.array(*(F.round(F.abs(F.col(f"x{i}") / g - F.col(f"m{i}") * SCALE / g)).cast("long") for i, g in enumerate(grid)))).alias("k", "v"))
    spread = wide(medians(off, 1.4826), "d").drop("rows")
    return materialise(_with(at, spread.withColumns({f"d{i}": F.greatest(f"d{i}", F.lit(f)) for i, f in enumerate(floors)})), "mcd")


def _starts(x: DataFrame, floors: list[float]) -> DataFrame:
    """The first estimates of each group: 0 medians and deviations, 1 all rows, 2 hyperbolic tangents, 3 spatial signs of the deviations."""
    p = len(floors)
    middles = _middles(x, floors)
    z = [(F.col(f"x{i}") / SCALE - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(p)]
    length = F.sqrt(reduce(lambda a, b: a + b, (v * v for v in z)))
    point = lambda start, values: F.struct(F.lit(start).alias("start"), *(F.round(v).cast("long").alias(f"x{i}") for i, v in enumerate(values)))
    sign = math.sqrt(p) * SCALE / F.greatest(length, F.lit(1e-9))
    points = F.array(point(1, [F.col(f"x{i}") for i in range(p)]), point(2, [F.tanh(v) * SCALE for v in z]), point(3, [v * sign for v in z]))
    moved = _with(x, middles).select(*KEY, F.explode(points).alias("v")).select(*KEY, "v.*")
    found = _with(_moments(moved.groupBy(*KEY, "start").agg(*_sums(p)), p).drop(*(f"s{i}" for i in range(p))).withColumnsRenamed({f"m{i}": f"a{i}" for i in range(p)}), middles)
    raw = F.col("start") == 1
    shaped = found.withColumns({f"c{i}_{j}": F.when(raw, F.col(f"c{i}_{j}")).otherwise(F.col(f"c{i}_{j}") * F.col(f"d{i}") * F.col(f"d{j}")) for i, j in _pairs(p)})
    shaped = shaped.withColumns({f"m{i}": F.when(raw, F.col(f"a{i}")).otherwise(F.col(f"m{i}")) for i in range(p)})
    diagonal = middles.withColumns({"start": F.lit(0), **{f"c{i}_{j}": F.col(f"d{i}") ** 2 if i == j else F.lit(0.0) for i, j in _pairs(p)}})
    columns = [*KEY, "start", "rows", *(f"m{i}" for i in range(p)), *(f"c{i}_{j}" for i, j in _pairs(p))]
    return _factor(diagonal.select(*columns).unionByName(shaped.select(*columns)), floors, 1.0).select(*KEY, "start", "rows", "det", *_names(p))


def _step(x: DataFrame, found: DataFrame, floors: list[float]) -> DataFrame:
    """One concentration step of every estimate."""
    p = len(floors)
    bin_ = F.floor(F.log2(_distance(p) + 1e-6) * BINS_PER_OCTAVE / 2).cast("int")
    by_bin = _with(x, found.drop("rows", "det")).withColumn("bin", bin_).groupBy(*KEY, "start", "bin").agg(*_sums(p))
    return _factor(_moments(_nearest(by_bin, p), p), floors, consistency(p, COVER)).select(*KEY, "start", "rows", "det", *_names(p))


def estimates(x: DataFrame) -> DataFrame:
    """Centre m, Cholesky factor l and determinant of the scatter of each (lang, source, pooled); pooled is false if x doesn't have it."""
    x = x if "pooled" in x.columns else x.withColumn("pooled", F.lit(False))
    floors = [f for _, _, f in features()]
    found = materialise(_starts(x, floors), "mcd")
    for _ in range(TRIAL_STEPS):
        found = materialise(_step(x, found, floors), "mcd")
    rest = [c for c in found.columns if c not in KEY]
    found = materialise(found.groupBy(*KEY).agg(F.min_by(F.struct(*rest), F.struct("det", "start")).alias("best")).select(*KEY, "best.*"), "mcd")
    for _ in range(MOST_STEPS):
        after = _step(x, found, floors).withColumnsRenamed({c: f"new_{c}" for c in rest})
        falls = F.coalesce(F.col("new_det") < F.col("det") * (1 - CONVERGED), F.lit(False))
        found = materialise(_with(found, after).withColumn("falls", falls).select(*KEY, *(F.when(F.col("falls"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in rest), "falls"), "mcd")
        if not found.agg(F.max("falls")).first()[0]:
            break
        found = found.drop("falls")
    return found.select(*KEY, *rest)


def references(x: DataFrame) -> DataFrame:
    """What each (lang, source) is judged by: its own estimate, or that of all rows of its language if it has fewer than LEAST_ROWS rows."""
    narrow = x.select("lang", "source", *(name for name, _, _ in features()))
    both = narrow.withColumn("pooled", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("source", F.when(~F.col("pooled"), F.col("source")))
    found = estimates(both)
    own, pooled = found.filter(~F.col("pooled")).drop("pooled"), found.filter("pooled").drop("pooled", "source", "rows")
    few = F.col("rows") < LEAST_ROWS
    small = _with(own.filter(few).select("lang", "source", "rows"), pooled)
    return materialise(own.filter(~few).unionByName(small.select(*own.columns)), "mcd")


def _judged(stats: DataFrame, found: DataFrame) -> DataFrame:
    """stats with distance (null where the base rules decide) and kept."""
    p = len(features())
    base = F.col("base_failed")
    x = stats.withColumns({name: F.when(~base, F.round(value * SCALE).cast("long")) for name, value, _ in features()})
    out = _with(x, found.select("lang", "source", *_names(p))).withColumn("distance", F.when(~base, F.sqrt(_distance(p))))
    # One sum, not two conditions: Spark would push the first below the join and work the statistics out for it once more.
    score = F.coalesce("distance", F.lit(0.0)) + F.when(base, 2 * cutoff()).otherwise(0.0)
    return out.select(*stats.columns, "distance", (score <= cutoff()).alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """The statistics of each document, its robust distance, and whether it is kept."""
    stats = materialise(statistics(docs), "quality")
    return _judged(stats, references(vectors(stats)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns as they were. Texts stay where they are: the last pass works their statistics out again."""
    found = references(vectors(materialise(statistics(docs), "quality")))
    return _judged(statistics(docs, whole=True), found).filter("kept").select("row.*")
