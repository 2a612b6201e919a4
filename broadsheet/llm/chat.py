"""Chat formatting with Spark expressions only.

Template: each run of adjacent turns of one role becomes ``<|start|>role<|text|>first<|next|>second<|end|>\\n``. Control strings inside
roles and texts get a backslash after their first character (one more if some are there), so they can be told from real ones and come back
unchanged. The loss mask lies over the texts of assistant turns, not over control strings.

Rows go by turn; equal turns by role, then text; a null turn first. Null roles and texts count as empty; repeated rows are repeated turns.
A null conv_id is a conversation of its own. Other columns don't matter, whatever their names. An empty table gives an empty result. Turns may be of any length
and are kept whole, but a conversation is one row, so it has to fit in what a string can hold (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's own control strings all begin with "<|"; the others are those of common templates.
START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>\n"
CONTROL = r"(?=\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*){CONTROL}", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)\\{CONTROL}", "$1")


def bind(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collect_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: an array of (role, text) in order."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def merge_turns(turns: Column) -> Column:
    """Array of (role, first, texts): adjacent turns of one role together, first being the number of the first of them."""

    def merge(turns: Column) -> Column:
        begins = F.transform(turns, lambda t, i: F.when((i == 0) | (F.get(turns, i - 1)["role"] != t["role"]), i))

        def runs(begin: Column) -> Column:
            def one(a: Column, k: Column) -> Column:
                end = F.coalesce(F.get(begin, k + 1), F.size(turns))
                return F.struct(F.get(turns, a)["role"].alias("role"), a.alias("first"), F.transform(F.slice(turns, a + 1, end - a), lambda t: t["text"]).alias("texts"))

            return F.transform(begin, one)

        return bind(F.filter(begins, lambda i: i.isNotNull()), runs)

    return bind(turns, merge)


def format_turns(collected: DataFrame) -> DataFrame:
    """conv_id, merged (role, first, texts), formatted, mask.

    mask: the stretches of formatted that are trained on, as (text, start, length) in code points; texts are what NEXT or END ends, counted from 0, and
    start counts from where the last of these ended, so that reading a stretch doesn't search the whole text.
    """
    merged = collected.select("conv_id", merge_turns(F.col("turns")).alias("merged"))
    written = F.transform("merged", lambda m: F.struct((m["role"] == TRAINED).alias("trained"), m["first"].alias("first"), F.concat(F.lit(START), escape(m["role"]), F.lit(TEXT)).alias("head"), F.transform(m["texts"], escape).alias("texts")))

    def spans(w: Column) -> Column:
        start = lambda j: F.when(j == 0, F.length(w["head"])).otherwise(0)
        return F.transform(w["texts"], lambda t, j: F.struct((w["first"] + j).alias("text"), start(j).alias("start"), F.length(t).alias("length")))

    def output(runs: Column) -> Column:
        text = F.transform(runs, lambda w: F.concat(w["head"], F.array_join(w["texts"], NEXT), F.lit(END)))
        return F.struct(F.array_join(text, "").alias("formatted"), F.flatten(F.transform(F.filter(runs, lambda w: w["trained"]), spans)).alias("mask"))

    return merged.withColumn("out", bind(written, output)).select("conv_id", "merged", "out.formatted", "out.mask")


def parse(formatted: Column) -> Column:
    """The array of (role, text) that a formatted text was made from."""

    def run(block: Column) -> Column:
        def texts(parts: Column) -> Column:
            role = unescape(F.substring(F.get(parts, F.lit(0)), F.lit(len(START) + 1), F.length(F.get(parts, F.lit(0)))))
            return F.transform(F.split(F.get(parts, F.lit(1)), r"\Q" + NEXT + r"\E", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

        return bind(F.split(block, r"\Q" + TEXT + r"\E", -1), texts)

    blocks = F.split(formatted, r"\Q" + END + r"\E", -1)
    return F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), run))


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped, one after the other."""
    texts = F.split(formatted, rf"\Q{NEXT}\E|\Q{END}\E", -1)
    return bind(texts, lambda x: F.array_join(F.transform(mask, lambda s: unescape(F.substring(F.get(x, s["text"]), s["start"] + 1, s["length"]))), ""))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted texts and the mask."""
    back = formatted.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        bind(parse(F.col("formatted")), lambda turns: F.struct(F.size(turns).cast("long").alias("n"), F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("sha"))).alias("turns"),
        masked(F.col("formatted"), F.col("mask")).alias("loss"),
    )
    return back.select("conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
