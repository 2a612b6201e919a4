"""Full-text search: an inverted index with weights, and queries in web-search notation.

Tokens are runs of letters and digits in lower case, less stop words, with English endings cut off by a few rules; title, summary and text weigh 1, 0.4
and 0.2. A query is words (all needed), "quoted phrases", OR and -exclusions. Ranks sum, over the query's words, weight by occurrence damped by a logarithm:
an approximation, since no engine at hand has the stemmer and the cover density of the original.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import lexicons as X
from broadsheet.functions import text as T

WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def stem(token: Column) -> Column:
    """Without the commonest English endings, where three letters stay."""
    return F.regexp_replace(F.regexp_replace(token, r"^(.{3,}?)(?:'s|ies|es|s)$", "$1"), r"^(.{3,}?)(?:ing|ed)$", "$1")


def tokens(c: Column | str) -> Column:
    words = F.filter(F.split(F.lower(T.text_of(c)), r"[^\p{L}\p{N}']+"), lambda w: (w != "") & ~w.isin(X.STOP_WORDS))
    return F.transform(words, stem)


def index(articles: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """key, token, weight, positions. fields: column to weight letter."""
    parts = [articles.select(key, F.lit(w).alias("weight"), F.posexplode(tokens(c)).alias("pos", "token")) for c, w in fields.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(key, "token", "weight").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def parse(query: str) -> tuple[list[list[str]], list[str]]:
    """Alternatives (each a list of words and phrases that must occur), and what must not."""
    wanted, banned = [[]], []
    for minus, phrase, word in re.findall(r'(-?)"([^"]*)"|(\S+)', query):
        text = phrase or word
        if not phrase and word.upper() == "OR":
            wanted.append([])
        elif minus or (not phrase and word.startswith("-")):
            banned.append(text.lstrip("-"))
        else:
            wanted[-1].append(text)
    return [w for w in wanted if w], banned


def search(articles: DataFrame, fields: dict[str, str], query: str) -> DataFrame:
    """the articles that match, with rank. No index needed: one pass over the texts, each tokenised once."""
    wanted, banned = parse(query)
    out = articles
    for c in fields:
        out = out.withColumn(f"t_{c}", F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" ")))
    has = lambda text: reduce(lambda a, b: a | b, (F.col(f"t_{c}").contains(F.concat(F.lit(" "), F.array_join(tokens(F.lit(text)), " "), F.lit(" "))) for c in fields))
    hit = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, map(has, terms)) for terms in wanted)) if wanted else F.lit(False)
    for b in banned:
        hit = hit & ~has(b)
    found = out.filter(hit)
    words = sorted({w for terms in wanted for x in terms for w in x.split()})
    times = lambda c, w: F.size(F.filter(F.split(f"t_{c}", " "), lambda x: x == F.element_at(tokens(F.lit(w)), 1)))
    kept = [w for w in words if w.lower() not in X.STOP_WORDS]
    rank = reduce(lambda a, b: a + b, (WEIGHTS[weight] * F.log1p(times(c, w)) for c, weight in fields.items() for w in kept), F.lit(0.0))
    return found.withColumn("rank", F.round(rank, 6)).drop(*(f"t_{c}" for c in fields))
