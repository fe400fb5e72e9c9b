"""Line-first cleaning in DataFrame functions only.

Each line with a word is judged on its own: too many symbols, menu separators, boilerplate phrases, shouting, one word
over and over, an earlier line said again, or a few words without an end mark. Failed lines go; a document goes if less
than KEPT_SHARE of its word characters is left, or if it fails the base rules.

A text without words, empty or null, has counts of 0 and is not kept. Every input row gives a row, repeated ones too; no rows
give no rows. Of equal lines the first stays. A very long text is an array of its lines in one row, and is judged whole.
No step moves rows between tasks.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._jobs import texts

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
KEPT_SHARE = 0.5

WORDS = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"#*$%&|<>"

#: Line rules. Shares are of the line's visible characters.
SYMBOL_SHARE = 0.08
MIN_OPEN_WORDS = 4
END_MARK = r"""[.!?:;,…。！？]["'”’»)\]]*[\x20\x09-\x0D]*\z"""
MARKS = "|»›•>"
MENU = rf"(?:[{MARKS}][^\n]*){{3}}"
PHRASES = (
    "cookie policy|we use cookies|accept (?:all )?cookies|privacy policy|terms (?:of use|of service|and conditions)"
    "|all rights reserved|enable javascript|subscribe to our|sign up for our newsletter|skip to (?:main )?content"
    "|click here to|share (?:this )?on (?:facebook|twitter)|lorem ipsum"
)
BOILERPLATE = rf"(?i)\b(?:{PHRASES})\b"
SHOUTING = r"^(?:[^\p{L}]*\p{Lu}){8}[^\p{Ll}]*\z"
STUCK_WORDS = 6
STUCK_SHARE = 3


def visible(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANKS, ""))


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def any_of(text: Column, parts: list[str]) -> Column:
    return functools.reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


def occasions(text: Column) -> Column:
    """Which rules a text gives any occasion for, by searches for plain strings: lines are held against these only."""
    phrases = [p.split("(?:")[0] for p in re.split(r"\|(?![^(]*\))", PHRASES)]
    return F.struct(any_of(text, list(SYMBOLS)).alias("symbols"), any_of(text, list(MARKS)).alias("marks"), any_of(F.lower(text), phrases).alias("phrases"))


def passes(line: Column, words: Column, seen: Column) -> Column:
    """Whether a line that holds words stays; what costs least is asked first."""
    n = F.size(words)
    open_ended = (n < MIN_OPEN_WORDS) & ~line.rlike(END_MARK)
    stuck = (n >= STUCK_WORDS) & (STUCK_SHARE * F.size(F.array_distinct(words)) <= n)
    noisy = seen["symbols"] & line.rlike(f"[{SYMBOLS}]") & (symbols(line) > SYMBOL_SHARE * visible(line))
    return ~(open_ended | stuck | noisy | line.rlike(SHOUTING) | (seen["marks"] & line.rlike(MENU)) | (seen["phrases"] & line.rlike(BOILERPLATE)))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that stand twice or more in a text. Hashes tell whether there are any; then equal windows
    are neighbours once sorted by hash and text. Each of their places covers three words."""
    n = F.size(words)
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, n - 2)

    def places(hashes: Column) -> Column:
        whole = F.arrays_zip(*[F.slice(words, k, n - 2).alias(f"w{k}") for k in (1, 2, 3)])
        return let(F.sort_array(F.arrays_zip(hashes.alias("h"), whole.alias("w"), F.sequence(F.lit(0), n - 3).alias("i"))), neighbours)

    def neighbours(x: Column) -> Column:
        same = lambda a, b: (a["h"] == b["h"]) & (a["w"] == b["w"])
        own = F.filter(x, lambda y, i: F.coalesce(same(y, F.get(x, i + 1)), F.lit(False)) | F.coalesce((i > 0) & same(y, F.get(x, i - 1)), F.lit(False)))
        return F.transform(own, lambda y: y["i"])

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.array(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)))))

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(places(h), covered)).otherwise(0))
    return F.when(n >= 4, found).otherwise(0).cast("long")


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_kept_lines,
    kept_share, kept, clean_text (the lines that stay)."""
    text = F.coalesce("text", F.lit(""))
    split = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), words_of(line).alias("words")))
    read = texts(docs, id_col, text_col).select(
        "doc_id",
        occasions(text).alias("seen"),
        F.when(any_of(text, list(SYMBOLS)), symbols(text)).otherwise(0).cast("long").alias("n_symbols"),
        F.filter(split, lambda x: F.size(x["words"]) > 0).alias("lines"),
    )
    read = read.withColumn("words", F.flatten("lines.words"))
    kept_lines = F.array_distinct(F.transform(F.filter("lines", lambda x: passes(x["line"], x["words"], F.col("seen"))), lambda x: x["line"]))
    read = read.select("*", kept_lines.alias("kept_lines"), repeat_words(F.col("words")).alias("n_repeat_words"), F.size("words").alias("n"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"))
    read = read.withColumn("clean_text", F.array_join("kept_lines", "\n"))
    kept_chars = F.when(F.size("kept_lines") == F.size("lines"), F.col("word_chars")).otherwise(visible(F.col("clean_text")))
    out = read.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines.line"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n"))).alias("base_failed"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("kept_lines").cast("long").alias("n_kept_lines"),
        F.when(F.col("word_chars") > 0, kept_chars / F.col("word_chars")).otherwise(0.0).alias("kept_share"),
        "clean_text",
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= KEPT_SHARE))
