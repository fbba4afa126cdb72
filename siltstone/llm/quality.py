"""Quality rules: a threshold table compiled into one projection, without user functions.

``RULES`` is data: a feature, a lower and an upper bound, and the word count from which the rule applies. ``verdict``
turns the table into one boolean expression over the features, so Spark evaluates all rules where it reads the
text and nothing is shuffled. The base figures are expressions too. Repeated words are found by hashing every
8-word window; only a text in which a hash repeats pays for the sort that locates the repeats.

Defined cases: null and empty texts have no words and no symbols, and fail the base rule; every ratio with a zero
denominator is 0; a very long text is judged whole; repeated rows each get a result; an empty table gives no rows.
Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Common function words of the languages served.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "der", "die", "und", "das", "von", "den", "ist", "nicht", "le", "la", "les", "des", "et", "que", "est", "en", "de", "el", "los", "las", "y", "un", "une", "una")

#: Fixed values: (feature, least, most, words from which the rule applies). The text is kept if every rule holds.
RULES = (
    ("mean_word_length", 1.5, 25.0, 20),
    ("symbol_ratio", None, 0.1, 20),
    ("dup_line_ratio", None, 0.35, 20),
    ("stop_word_ratio", 0.03, None, 50),
    ("long_word_ratio", None, 0.4, 20),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def window_hashes(words: Column) -> Column:
    """Hashes of every 8 consecutive words, by doubling: pairs, then pairs of pairs, then those again."""

    def double(a: Column, step: int) -> Column:
        return let(a, lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - step), F.slice(x, F.lit(step + 1), F.size(x) - step), lambda p, q: F.xxhash64(p, q)))

    return double(double(double(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that are found twice or more in the text."""

    def located(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(p: Column) -> Column:
            last = F.size(p)
            twin = lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | ((i < last - 1) & (F.get(p, i + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(F.filter(p, twin), lambda x: x["i"]))

        def covered(s: Column) -> Column:
            return F.aggregate(
                s,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
                lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["to"], i)).alias("n"), (i + WINDOW).alias("to")),
            )["n"]

        return let(let(pairs, marked), covered)

    hashes = window_hashes(words)
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), located(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= WINDOW, found).otherwise(F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """Base figures and what the ratios need."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("text"))
    stops = F.array(*(F.lit(w) for w in STOP_WORDS))

    def figures(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.array_contains(stops, F.lower(x)))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: F.length(x) > 30)).cast("long").alias("n_long_words"),
        )

    return base.select(
        "doc_id",
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("n_lines"),
        let(words_of(F.col("text")), figures).alias("w"),
    ).select("doc_id", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "w.*")


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


FEATURES = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "long_word_ratio": ("n_long_words", "n_words"),
}


def verdict(rules=RULES) -> Column:
    """All rules of the table as one expression."""
    out = F.lit(True)
    for feature, least, most, from_words in rules:
        holds = F.lit(True)
        if least is not None:
            holds = holds & (ratio(*FEATURES[feature]) >= least)
        if most is not None:
            holds = holds & (ratio(*FEATURES[feature]) <= most)
        out = out & ((F.col("n_words") < from_words) | holds)
    return out


def verdict_sql(rules=RULES) -> str:
    """The same as SQL, over columns named like the features' parts."""
    tests = []
    for feature, least, most, from_words in rules:
        a, b = FEATURES[feature]
        value = f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"
        holds = [f"{value} >= {least}"] * (least is not None) + [f"{value} <= {most}"] * (most is not None)
        tests.append(f"(n_words < {from_words} OR ({' AND '.join(holds)}))")
    return " AND ".join(tests)


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
