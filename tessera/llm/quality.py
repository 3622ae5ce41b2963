"""Quality rules: a threshold table compiled into one projection of native functions.

The projection reads each whole text once and derives counts and ratios of length, symbols,
stop words and lines; a document is kept if it passes the base test and every rule. There is no
shuffle and no user function: windows that repeat are found inside the row, by hashing each
five-word window, comparing distinct and total numbers, and sorting (hash, position) pairs only
where they differ.

Defined results: null or empty text has zero counts, fails the base test and is not kept; null
ids and repeated rows pass through one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, words


class Rule(NamedTuple):
    """Keep if low <= metric <= high, for documents of at least `from_words` words."""

    metric: str
    low: float
    high: float
    from_words: int = 0


#: Production thresholds.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", 0.0, 0.05),
    Rule("stop_ratio", 0.05, 0.9, 50),
    Rule("dup_line_ratio", 0.0, 0.5),
    Rule("words_per_line", 2.0, 1e9, 50),
)
#: Frequent function words of English, German, French and Spanish. A table's `lang` column, where
#: it has one, says which texts they are for: the lower bound of stop_ratio holds for these and for null.
LANGUAGES = ("en", "de", "fr", "es")
STOP_WORDS = (
    "the of and to in is that it for on with as was be by at this from are or an not have "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les en du un une que est pour qui dans par pas au sur avec "
    "el y a los del se las por para con no su al lo es como"
).split()
WINDOW = 5


def _repeat_words(tokens: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in the text."""

    def windows(ws):
        return F.transform(F.sequence(F.lit(0), F.size(ws) - WINDOW), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))

    def covered(at):
        # Positions in order: each window adds its own words, less what the next one covers.
        steps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at)), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x) + WINDOW

    def repeated(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: covered(F.array_sort(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))))

    def count(hashes):
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(repeated(hashes))

    return F.when(F.size(tokens) < WINDOW, F.lit(0)).otherwise(let(tokens, lambda ws: let(windows(ws), count))).cast("long")


def measures(docs: DataFrame, stop_words=STOP_WORDS, languages=LANGUAGES) -> DataFrame:
    """The rows (d) with the counts that the rules are made of, and whether the stop words cover the language."""
    covered = F.coalesce(F.col("d.lang").cast("string").isin(list(languages)), F.lit(True)) if "lang" in docs.columns else F.lit(True)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), words(F.col("text")).alias("tokens"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    text = F.coalesce(F.col("d.text"), F.lit(""))
    return base.select(
        "d",
        F.size("tokens").cast("long").alias("n_words"),
        F.char_length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("tokens")).alias("n_repeat_words"),
        F.size(F.filter("tokens", lambda w: F.lower(w).isin(stop_words))).cast("long").alias("n_stop_words"),
        covered.alias("covered"),
    )


METRICS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "words_per_line": ("n_words", "n_lines"),
}


def verdict(rules=RULES) -> Column:
    """The table as one boolean expression over the counts; a ratio over nothing is 0."""
    passed = F.lit(True)
    for rule in rules:
        over, under = METRICS[rule.metric]
        ratio = F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under)), F.lit(0.0))
        low = ratio >= rule.low
        if over == "n_stop_words":
            low = low | ~F.col("covered")
        passed = passed & ((F.col("n_words") < rule.from_words) | (low & (ratio <= rule.high)))
    return passed


def _judged(docs: DataFrame, rules, **words_of) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, **words_of).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality(docs: DataFrame, rules=RULES, **words_of) -> DataFrame:
    """One row per document with its counts, base_failed and kept. `words_of`: stop_words and languages."""
    return _judged(docs, rules, **words_of).select("d.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


def keep_quality(docs: DataFrame, rules=RULES, **words_of) -> DataFrame:
    """The documents that pass, with all their columns."""
    return _judged(docs, rules, **words_of).filter("kept").select("d.*")
