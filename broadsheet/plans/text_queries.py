"""Queries over the text rules (heading, caption and jump scores, entities, sentiment, keywords, matching) on articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.functions import lexicons as X
from broadsheet.functions import text as T
from broadsheet.plans.registry import has, query, rlike, strings
from broadsheet.sources import fixtures
from broadsheet.storage import tables

STRIP = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
LAST = "right(t, 1)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "documents")[0].select("doc_id", "text", "lang", "source", "n_chars")


def _count(column: str, chars: str) -> str:
    return f"(length({column}) - length(translate({column}, '{chars}', '')))"


BASE = rf"""base AS (SELECT doc_id, lang, source, text, {STRIP} AS t FROM documents),
w AS (SELECT *, lower(t) AS low, CASE WHEN t = '' THEN [] ELSE regexp_split_to_array(t, '\s+') END AS ws FROM base)"""


@query(rf"""WITH {BASE} SELECT doc_id, round(CASE WHEN t = '' THEN 0.0 ELSE greatest(0.0, least(1.0,
  CASE WHEN len(ws) <= 10 THEN 0.35 ELSE 0.0 END::DOUBLE
  + CASE WHEN len([x FOR x IN ws IF length(x) > 1 AND regexp_matches(x, '^\p{{Lu}}')]) > 0.70 * len(ws) THEN 0.35 ELSE 0 END
  + CASE WHEN contains('{X.TERMINAL}', {LAST}) THEN 0 ELSE 0.20 END + CASE WHEN {_count("t", ",")} <= 1 THEN 0.10 ELSE 0 END
  - CASE WHEN len(ws) > 15 THEN 0.40 ELSE 0 END - CASE WHEN {LAST} IN ('.', '।', '॥') THEN 0.30 ELSE 0 END - CASE WHEN length(t) > 100 THEN 0.20 ELSE 0 END
  - CASE WHEN {_count("t", ".।")} > 1 THEN 0.20 ELSE 0 END - CASE WHEN {_count("t", ",")} > 2 THEN 0.10 ELSE 0 END)) END::DOUBLE, 4) AS score
FROM (SELECT doc_id, t, ws FROM w UNION ALL SELECT -1 - doc_id, t, CASE WHEN t = '' THEN [] ELSE regexp_split_to_array(t, '\s+') END
  FROM (SELECT doc_id, regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '^\s+|\s+$', '', 'g') AS t FROM documents))""")
def f23_heading_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, and their first lines under -1 - doc_id."""
    d = docs(spark, sf_dir)
    both = d.select("doc_id", "text").union(d.select(-1 - F.col("doc_id"), F.split_part("text", F.lit("\n"), F.lit(1))))
    return both.select("doc_id", F.round(T.heading_score("text"), 4).alias("score"))


FIRST_LINES = r"""f AS (SELECT doc_id, regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '^\s+|\s+$', '', 'g') AS t FROM documents),
g AS (SELECT *, lower(t) AS low, CASE WHEN t = '' THEN [] ELSE regexp_split_to_array(t, '\s+') END AS ws FROM f)"""


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"))


CAPTION = (
    f"""CASE WHEN t = '' OR len(ws) > 25 THEN 0.0 ELSE least(1.0, CASE WHEN {" OR ".join(f"starts_with(low, '{p}')" for p in X.CAPTION_PREFIXES)} OR {" OR ".join(f"starts_with(t, '{p}')" for p in X.CAPTION_PREFIXES_DEVANAGARI)} THEN 0.45 ELSE 0 END
  + CASE WHEN {has("low", X.AGENCIES)} OR {has("t", X.AGENCIES_DEVANAGARI)} THEN 0.35 ELSE 0 END + CASE WHEN len(ws) BETWEEN 4 AND 18 THEN 0.15 ELSE 0 END
  + CASE WHEN right(t, 1) IN ('.', '।', '॥') THEN 0.05 ELSE 0 END) END"""
)


@query(f"WITH {FIRST_LINES} SELECT doc_id, round(({CAPTION})::DOUBLE, 4) AS score FROM g")
def f24_caption_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_lines(spark, sf_dir).select("doc_id", F.round(T.caption_score("line"), 4).alias("score"))


JUMPS = "j AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'Continued on Page ' || (doc_id % 9 + 1) ELSE '' END AS text FROM documents)"


def with_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, every fourth with a line that sends to another page."""
    d = docs(spark, sf_dir)
    jump = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\nContinued on Page "), (F.col("doc_id") % 9 + 1).cast("string"))).otherwise("")
    return d.select("doc_id", F.concat(T.text_of("text"), jump).alias("text"))


JUMP = f"""CASE WHEN t = '' THEN 0.0 ELSE least(1.0, CASE WHEN {rlike("lower(t)", X.JUMP_PATTERNS)} OR {rlike("t", X.JUMP_PATTERNS_DEVANAGARI)} THEN 0.60 ELSE 0 END
  + CASE WHEN regexp_matches(lower(t), '{X.JUMP_PAGE}') OR regexp_matches(t, '{X.JUMP_PAGE_DEVANAGARI}') THEN 0.30 ELSE 0 END
  + CASE WHEN len([x FOR x IN regexp_split_to_array(lower(t), '\\s+') IF x <> '']) <= 8 THEN 0.10 ELSE 0 END) END"""


@query(f"WITH {JUMPS}, last AS (SELECT doc_id, list_extract(string_split(text, chr(10)), -1) AS t FROM j) SELECT doc_id, round(({JUMP})::DOUBLE, 4) AS score FROM last")
def f25_jump_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = with_jumps(spark, sf_dir).select("doc_id", F.element_at(F.split("text", "\n"), -1).alias("line"))
    return last.select("doc_id", F.round(T.jump_score("line"), 4).alias("score"))


PHRASE_I, PAGE_I = X.TARGET_PHRASE, X.TARGET_PAGE


@query(
    f"WITH {JUMPS}, p AS (SELECT doc_id, text, coalesce(nullif(regexp_extract(text, '(?i){PHRASE_I}', 1), ''), nullif(regexp_extract(text, '(?i){PAGE_I}', 1), ''))::INT AS page FROM j) "
    f"SELECT doc_id, page AS next_page, CASE WHEN page IS NOT NULL THEN trim(regexp_extract(text, '(?i){X.TARGET_MARKER}', 0)) END AS marker FROM p"
)
def f13_jump_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_jumps(spark, sf_dir).select("doc_id", T.continuation("text").alias("c")).select("doc_id", "c.next_page", "c.marker")


@query(
    f"WITH {JUMPS}, p AS (SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?i){PHRASE_I}', 1), ''), nullif(regexp_extract(text, '(?i){PAGE_I}', 1), '')) IS NOT NULL AS jumps, array_to_string(list_slice(string_split(regexp_replace(text, '\\n$', ''), chr(10)), -3, -1), chr(10)) AS t FROM j) "
    f"SELECT doc_id, (jumps OR ({JUMP}) >= 0.5) AS is_continued FROM p"
)
def f15_is_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_jumps(spark, sf_dir).select("doc_id", T.continuation("text")["is_continued"].alias("is_continued"))


@query(f"""WITH m AS (SELECT doc_id, '► ' || split_part(coalesce(text, ''), ' ', 2) || ' story, P ' || (doc_id % 30) AS marker FROM documents)
SELECT doc_id, marker, nullif(trim(regexp_extract(marker, '(?i){X.JUMP_SLUG}', 1), ' -–—:,.'), '') AS slug FROM m""")
def f14_jump_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.split_part(T.text_of("text"), F.lit(" "), F.lit(2))
    marked = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("► "), word, F.lit(" story, P "), (F.col("doc_id") % 30).cast("string")).alias("marker"))
    return marked.select("doc_id", "marker", T.jump_slug("marker").alias("slug"))


@query(r"""WITH c AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\x{0900}-\x{097F}]', '', 'g')) AS d, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS l FROM documents)
SELECT doc_id, CASE WHEN d > l THEN 'hi' WHEN l > 0 THEN 'en' ELSE 'unknown' END AS language FROM c""")
def f20_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.language("text").alias("language"))


@query(r"""SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) > 0 THEN 'latin' END AS script FROM documents""")
def f21_dominant_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus is in Latin script; tests have the others."""
    return docs(spark, sf_dir).select("doc_id", T.dominant_script("text").alias("script"))


@query(rf"""WITH b AS (SELECT doc_id, {STRIP} AS t FROM documents),
s AS (SELECT *, [x FOR x IN string_split(regexp_replace(t, '([.!?।॥])\s+', '\1' || chr(1), 'g'), chr(1)) IF x <> ''] AS ss, regexp_extract_all(t, '[A-Za-z\x{{0900}}-\x{{097F}}]+') AS ws FROM b)
SELECT doc_id, coalesce(ss[1], '') AS first_sentence, coalesce(ss[-1], '') AS last_sentence, coalesce(ws[1], '') AS first_word, coalesce(ws[-1], '') AS last_word,
  regexp_matches(t, '^\p{{Ll}}') AS starts_with_lowercase, t <> '' AND contains('.!?:;।॥', right(t, 1)) AS ends_with_punctuation FROM s""")
def f19_sentence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.sentence_features("text").alias("f")).select("doc_id", "f.*")


@query(rf"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*') AS ps FROM documents),
q AS (SELECT doc_id, [x FOR x IN ps IF regexp_matches(x, '\s') AND regexp_split_to_array(x, '\s+')[1] NOT IN {strings(X.MONTHS)}] AS people,
  list_concat([x FOR x IN ps IF regexp_split_to_array(x, '\s+')[1] IN {strings(X.MONTHS)}], regexp_extract_all(text, '\d{{1,2}}\s+(?:{"|".join(X.MONTHS)})\s+\d{{4}}')) AS dates,
  flatten([{", ".join(f"regexp_extract_all(text, '[A-Z][A-Za-z& ]+{k}')" for k in X.ORGANISATIONS)}]) AS organizations FROM p)
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(people)), '|'), '') AS people, coalesce(array_to_string(list_sort(list_distinct(dates)), '|'), '') AS dates,
  coalesce(array_to_string(list_sort(list_distinct(organizations)), '|'), '') AS organizations FROM q""")
def f22_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = docs(spark, sf_dir).select("doc_id", T.entities("text").alias("e"))
    return e.select("doc_id", F.array_join("e.people", "|").alias("people"), F.array_join("e.dates", "|").alias("dates"), F.array_join("e.organizations", "|").alias("organizations"))


@query(rf"""WITH m AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'win victory growth' WHEN 1 THEN 'fire death riot loss' WHEN 2 THEN 'win fire' WHEN 3 THEN 'win win fire fire' ELSE '' END AS tail FROM documents),
s AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '') || ' ' || tail), '[a-z'']+') AS ws FROM m),
c AS (SELECT doc_id, len([x FOR x IN ws IF x IN {strings(X.POSITIVE)}]) AS p, len([x FOR x IN ws IF x IN {strings(X.NEGATIVE)}]) AS n FROM s)
SELECT doc_id, CASE WHEN p < 2 AND n < 2 THEN 'neutral' WHEN p >= 1.5 * n AND p >= 2 THEN 'positive' WHEN n >= 1.5 * p AND n >= 2 THEN 'negative' ELSE 'neutral' END AS sentiment FROM c""")
def f27_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus has no such words: some are added."""
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, "win victory growth").when(k == 1, "fire death riot loss").when(k == 2, "win fire").when(k == 3, "win win fire fire").otherwise("")
    return docs(spark, sf_dir).select("doc_id", T.sentiment(F.concat(T.text_of("text"), F.lit(" "), tail)).alias("sentiment"))


def keyword_ranks(articles: DataFrame, key: str, text: str, most: int = 10) -> DataFrame:
    """key, rank, keyword: capitalised phrases by count, then words of four letters found twice; the first of equal spellings stays.

    Words are counted in one aggregation over (key, phrase); ties go to what comes first in the text."""
    t = T.text_of(text)
    cut = lambda pattern: F.posexplode(F.regexp_extract_all(t, F.lit(pattern), 1)).alias("at", "keyword")
    phrases = articles.select(key, F.lit(0).alias("kind"), cut(T.PHRASE))
    words = articles.select(key, F.lit(1).alias("kind"), cut("([A-Za-z]{4,})")).withColumn("keyword", F.lower("keyword")).filter(~F.col("keyword").isin(X.STOP_WORDS))
    counted = phrases.unionByName(words).groupBy(key, "kind", "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).filter("kind = 0 OR n >= 2")
    order = [F.col("kind"), F.desc("n"), F.col("at")]
    once = counted.withColumn("k", F.row_number().over(W.partitionBy(key, F.lower("keyword")).orderBy(*order))).filter("k = 1")
    return once.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= most).select(key, "rank", "keyword")


@query(rf"""WITH p AS (SELECT doc_id, 0 AS kind, i AS pos, x AS keyword FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*') AS xs FROM documents) d, unnest(xs) WITH ORDINALITY AS u (x, i)),
q AS (SELECT doc_id, 1 AS kind, i AS pos, lower(x) AS keyword FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{{4,}}') AS xs FROM documents) d, unnest(xs) WITH ORDINALITY AS u (x, i) WHERE lower(x) NOT IN {strings(X.STOP_WORDS)}),
c AS (SELECT doc_id, kind, keyword, count(*) AS n, min(pos) AS pos FROM (SELECT * FROM p UNION ALL SELECT * FROM q) GROUP BY ALL HAVING kind = 0 OR count(*) >= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(keyword) ORDER BY kind, n DESC, pos) AS k FROM c),
r AS (SELECT doc_id, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY kind, n DESC, pos) AS rank FROM o WHERE k = 1)
SELECT doc_id, rank::INT AS rank, keyword FROM r WHERE rank <= 10""")
def t05_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_ranks(docs(spark, sf_dir), "doc_id", "text")


@query(rf"""WITH t AS (SELECT doc_id, unnest([x FOR x IN string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')
  IF length(x) >= 3 AND x NOT IN {strings(X.STOP_WORDS)}]) AS token FROM documents)
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY token""")
def f10_match_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 and F09, too: match tokens of the whole corpus with their counts."""
    t = docs(spark, sf_dir).select("doc_id", F.explode(T.match_tokens("text")).alias("token"))
    return t.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


TOKENS = rf"""n AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(right(coalesce(text, ''), 1800)), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS a,
  trim(regexp_replace(regexp_replace(lower(left(coalesce(text, ''), 1800)), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM documents),
k AS (SELECT doc_id, source, [x FOR x IN string_split(a, ' ') IF length(x) >= 3 AND x NOT IN {strings(X.STOP_WORDS)}] AS a, [x FOR x IN string_split(b, ' ') IF length(x) >= 3 AND x NOT IN {strings(X.STOP_WORDS)}] AS b FROM n)"""


@query(rf"""WITH {TOKENS}, s AS (SELECT x.doc_id AS source_id, y.doc_id AS target_id, x.a, y.b FROM k x JOIN k y ON y.doc_id = x.doc_id + 1 + x.doc_id % 7),
g AS (SELECT *, list_distinct(a) AS da, list_distinct(b) AS db,
  list_distinct([a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] FOR i IN range(1, len(a) - 1)]) AS ta, list_distinct([b[i] || ' ' || b[i + 1] || ' ' || b[i + 2] FOR i IN range(1, len(b) - 1)]) AS tb FROM s),
m AS (SELECT source_id, target_id, len(da) AS na, len(db) AS nb, len(list_intersect(da, db)) AS shared, len(ta) AS nta, len(tb) AS ntb, len(list_intersect(ta, tb)) AS tshared FROM g)
SELECT source_id, target_id, shared::INT AS shared, round(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE shared / (na + nb - shared)::DOUBLE END, 6) AS jaccard, round(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE shared / least(na, nb)::DOUBLE END, 6) AS min_share,
  round(CASE WHEN nta = 0 OR ntb = 0 OR na = 0 OR nb = 0 THEN 0 ELSE tshared / least(nta, ntb)::DOUBLE END, 6) AS trigram FROM m""")
def a13_text_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, too: token and trigram overlap of linked pairs."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    pairs = d.withColumn("target_id", F.col("doc_id") + 1 + F.col("doc_id") % 7).join(d.select(F.col("doc_id").alias("target_id"), F.col("text").alias("target")), "target_id")
    o = pairs.select(F.col("doc_id").alias("source_id"), "target_id", T.text_overlap(F.col("text"), F.col("target")).alias("o"))
    return o.select("source_id", "target_id", "o.shared", *(F.round(f"o.{c}", 6).alias(c) for c in ("jaccard", "min_share", "trigram")))


AD = rlike("t", X.ADVERTISEMENT)


@query(rf"""WITH {BASE}, c AS (SELECT doc_id, t, ({CAPTION}) AS caption, length(t) AS n, length(regexp_replace(t, '[^\p{{Nd}}]', '', 'g')) AS digits FROM w)
SELECT doc_id, CASE WHEN caption >= 0.55 AND doc_id % 2 = 0 THEN 'photo_caption' WHEN n < 40 AND (n = 0 OR digits > n * 0.4) THEN 'reference' WHEN {AD} THEN 'advertisement' WHEN n < 15 THEN 'other' ELSE 'article' END AS content_type FROM c""")
def p16_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.content_type(F.col("text"), T.caption_score("text"), F.col("doc_id") % 2 == 0).alias("content_type"))


@query(r"""WITH h AS (SELECT doc_id, array_to_string([x FOR x IN regexp_split_to_array(lower(split_part(coalesce(text, ''), chr(10), 1)), '\s+') IF x <> ''], ' ') AS h, CASE WHEN doc_id % 11 = 0 THEN 'Continued' WHEN doc_id % 13 = 0 THEN ' More  on Page ' ELSE NULL END AS o, text FROM documents),
e AS (SELECT doc_id, coalesce(array_to_string([x FOR x IN regexp_split_to_array(lower(o), '\s+') IF x <> ''], ' '), h) AS h, text FROM h)
SELECT doc_id, h = '' OR h IN ('untitled', 'untitled article', 'continued', 'more on page', 'report on page', 'continued from page') AS titleless,
  length(trim(coalesce(text, ''))) >= 120 AND h NOT IN ('windows', 'photo', 'photograph', 'picture', 'file photo', 'pti photo', 'more on page', 'report on page', 'continued') AS target_ok FROM e""")
def p17_p18_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titleless headlines, and whether a story can go on here."""
    k = F.col("doc_id")
    head = F.when(k % 11 == 0, "Continued").when(k % 13 == 0, " More  on Page ").otherwise(F.split_part("text", F.lit("\n"), F.lit(1)))
    return docs(spark, sf_dir).select("doc_id", T.titleless(head).alias("titleless"), T.target_eligible(F.lit("article"), F.col("text"), head).alias("target_ok"))


BY = r"""a AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'By Asha Rao' || chr(10) WHEN 1 THEN 'Ravi Kumar Correspondent' || chr(10) WHEN 2 THEN 'anil.das @ paper.com' || chr(10) WHEN 3 THEN 'NEW DELHI, Aug 12: ' WHEN 4 THEN 'Lead' || chr(10) || 'Some Very Long Place Name: ' ELSE '' END || coalesce(text, '') AS t FROM documents)"""


def with_bylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus has no bylines or datelines: some are put in front."""
    k = F.col("doc_id") % 6
    head = (
        F.when(k == 0, "By Asha Rao\n").when(k == 1, "Ravi Kumar Correspondent\n").when(k == 2, "anil.das @ paper.com\n").when(k == 3, "NEW DELHI, Aug 12: ").when(k == 4, "Lead\nSome Very Long Place Name: ").otherwise("")
    )
    return docs(spark, sf_dir).select("doc_id", F.concat(head, T.text_of("text")).alias("text"))


LINES = r"l AS (SELECT doc_id, [x FOR x IN [regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN string_split(t, chr(10))] IF x <> ''] AS ls FROM a)"


@query(rf"""WITH {BY}, {LINES}, n AS (SELECT doc_id, i, x FROM (SELECT doc_id, list_concat(ls[1:3], CASE WHEN len(ls) > 1 THEN ls[-2:] ELSE ls END) AS near FROM l), unnest(near) WITH ORDINALITY AS u (x, i)),
m AS (SELECT doc_id, i, CASE WHEN regexp_matches(x, '{X.BYLINE_EMAIL}') THEN regexp_extract(x, '{X.BYLINE_EMAIL}', 1) || '@' || regexp_extract(x, '{X.BYLINE_EMAIL}', 2) END AS mail,
  coalesce(nullif(trim(regexp_extract(x, '(?i){X.BYLINE.replace("'", "''")}', 1), ' .'), ''), nullif(trim(regexp_extract(x, '{X.BYLINE_ROLE}', 1), ' .'), '')) AS line,
  list_min([y FOR y IN regexp_extract_all(upper(x), '[A-Z]+') IF y IN {strings([a.upper() for a in X.AGENCIES])}]) AS agency FROM n),
f AS (SELECT doc_id, arg_min(mail, i) FILTER (mail IS NOT NULL) AS mail, arg_min(line, i) FILTER (line IS NOT NULL) AS line, arg_min(agency, i) FILTER (agency IS NOT NULL) AS agency FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(mail, line, agency) AS author FROM documents d LEFT JOIN f USING (doc_id)""")
def f16_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bylines(spark, sf_dir).select("doc_id", T.author("text").alias("author"))


@query(rf"""WITH {BY}, {LINES}, n AS (SELECT doc_id, i, trim(regexp_extract(x, '{X.DATELINE}', 1)) AS place, trim(regexp_extract(x, '{X.DATELINE}', 2)) AS date FROM (SELECT doc_id, ls[1:6] AS near FROM l), unnest(near) WITH ORDINALITY AS u (x, i)),
f AS (SELECT doc_id, arg_min(place, i) AS location, arg_min(coalesce(nullif(date, ''), '-'), i) AS date FROM n WHERE place <> '' AND (upper(place) IN {strings(X.GAZETTEER)} OR len(regexp_split_to_array(place, '\s+')) <= 3) GROUP BY doc_id)
SELECT d.doc_id, location, nullif(date, '-') AS date FROM documents d LEFT JOIN f USING (doc_id)""")
def f17_dateline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bylines(spark, sf_dir).select("doc_id", T.dateline("text").alias("d")).select("doc_id", "d.location", "d.date")


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 8500 THEN 'high' WHEN c_acctbal >= 6000 THEN 'medium' ELSE 'low' END AS readability, length(c_name) < 20 AS missing_text FROM customer""")
def p15_quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = tables(spark, sf_dir, "customer")
    return c.select("c_custkey", T.readability(F.col("c_acctbal") / 10_000).alias("readability"), (F.length("c_name") < 20).alias("missing_text"))


@query(f"WITH {fixtures.ARTICLES_SQL} SELECT article_id, strftime(publish_date, '%Y-%m-%d') AS text, publish_date AS date FROM articles")
def f03_iso_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixtures.articles(spark, sf_dir).select("article_id", F.date_format("publish_date", "yyyy-MM-dd").alias("text"))
    return a.select("article_id", "text", T.iso_date(F.concat("text", F.lit("T00:00"))).alias("date"))


@query(rf"""WITH {fixtures.ARTICLES_SQL} SELECT article_id, CASE article_id % 4 WHEN 0 THEN publish_date WHEN 1 THEN publish_date WHEN 2 THEN publish_date END AS date FROM articles""")
def f05_unique_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date in each of three notations, and two dates at once."""
    d, k = F.col("publish_date"), F.col("article_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("Issue of "), F.date_format(d, "MMMM d, yyyy"))).when(k == 1, F.concat(F.date_format(d, "d MMM yyyy"), F.lit(" Delhi"))).when(k == 2, F.date_format(d, "d/M/yyyy"))
        .otherwise(F.concat(F.date_format(d, "d MMMM yyyy"), F.lit(" and "), F.date_format(F.date_add(d, 1), "d MMMM yyyy")))
    )
    return fixtures.articles(spark, sf_dir).select("article_id", T.unique_date(text).alias("date"))


@query(rf"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/output/p/' || page_id || '.png' WHEN page_id % 3 = 1 THEN '/output/' || page_id || '.png' END AS image_url FROM pages""")
def f07_image_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = tables(spark, sf_dir, "pages")
    k, n = F.col("page_id"), F.concat(F.col("page_id").cast("string"), F.lit(".png"))
    path = F.when(k % 3 == 0, F.concat(F.lit("C:\\x\\output\\p\\"), n)).when(k % 3 == 1, F.concat(F.lit("output/"), n)).otherwise(F.concat(F.lit("/tmp/"), n))
    return p.select("page_id", T.image_url(path).alias("image_url"))


HEXBYTES = "from_hex('6ba7b8119dad11d180b400c04fd430c8')"


@query(
    f"""WITH h AS (SELECT doc_id, sha1({HEXBYTES} || encode('newspaper-archive:document:doc_' || lpad(doc_id::VARCHAR, 6, '0'))) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE WHEN h[17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17] IN ('1', '5', '9', 'd') THEN '9' WHEN h[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS id FROM h"""
)
def f08_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.uuid5("document", F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))).alias("id"))


@query(r"""WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN event_id || '.0' WHEN 2 THEN '-' || event_id ELSE 'n/a' END AS v FROM events)
SELECT event_id, CASE WHEN regexp_matches(trim(v), '^[+-]?\d+$') THEN trim(v)::INT END AS n FROM v""")
def f34_safe_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = tables(spark, sf_dir, "events")
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 4
    v = F.when(k == 0, F.concat(F.lit(" "), i, F.lit(" "))).when(k == 1, F.concat(i, F.lit(".0"))).when(k == 2, F.concat(F.lit("-"), i)).otherwise("n/a")
    return e.select("event_id", T.safe_int(v).alias("n"))


@query(r"""WITH n AS (SELECT doc_id, lang, lower(regexp_replace(trim(coalesce(text, '')), '\s+', ' ', 'g')) AS t FROM documents)
SELECT a.doc_id FROM n a WHERE a.t <> '' AND NOT EXISTS (SELECT 1 FROM n b WHERE b.lang = a.lang AND b.doc_id <> a.doc_id AND left(b.t, 30) = left(a.t, 30) AND (length(b.t) > length(a.t) OR (length(b.t) = length(a.t) AND b.doc_id < a.doc_id)))""")
def d03_prefix_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of texts in a language that begin alike (30 characters), the longest stays: one aggregation instead of a self-join."""
    plain = F.lower(F.regexp_replace(F.trim(T.text_of("text")), r"\s+", " "))
    n = docs(spark, sf_dir).select("doc_id", "lang", F.length(plain).alias("n"), F.left(plain, F.lit(30)).alias("head")).filter("n > 0")
    return n.groupBy("lang", "head").agg(F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("doc_id")).select("doc_id")


@query(r"""SELECT doc_id, len([x FOR x IN [regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN regexp_split_to_array(coalesce(text, ''), '\n\s*\n')] IF x <> ''])::INT AS n_paragraphs FROM documents""")
def f39_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.size(T.paragraphs("text")).alias("n_paragraphs"))


@query(f"""SELECT o_orderkey, 'article_' || o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS rank FROM orders""")
def t03_natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_9 before article_10."""
    (o,) = tables(spark, sf_dir, "orders")
    name = F.concat(F.lit("article_"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", "o_custkey", name.alias("id")).withColumn("rank", F.row_number().over(W.partitionBy("o_custkey").orderBy(T.natural_key(F.col("id"))))).drop("o_custkey")
