"""Per-document text statistics as Spark columns; no Python runs on the executors.

Arrays that several expressions read are passed through a one-row generator (`held`), because Catalyst may
otherwise paste the expression into every place, and even into every step of an array function, that uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexmat.llm.common import SPACE_CLASS, words_of

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def held(df: DataFrame, drop: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """df with the columns computed once for each row."""
    kept = [c for c in df.columns if c not in drop]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def count_chars(text: Column, kept: str) -> Column:
    """How many characters of the class `kept` (the inside of a regex class) a text has."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def worded_lines(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))


def with_repeats(df: DataFrame, words: str, out: str = "n_repeat_words", size: int = 3) -> DataFrame:
    """Adds the number of words that lie in a window of `size` words found twice or more in the text, first included.

    Windows are hashed to 64 bits and sorted with their places; equal neighbours are the repeated windows, and
    the words they cover are counted along the sorted places, so a text of n words takes n log n steps.
    """
    n = F.size(words) - (size - 1)
    place = F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(place, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(size)]))
    df = held(df, drop=(words,), _grams=grams)
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    sorted_grams = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = held(df, drop=("_grams",), _sorted=F.when(repeats, sorted_grams))
    pairs = F.zip_with("_sorted", F.slice("_sorted", 2, F.greatest(F.size("_sorted"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct((p + size).alias("end"), (acc["n"] + p + size - F.greatest(p, acc["end"])).alias("n")),
        lambda acc: acc["n"],
    )
    cols = [c for c in df.columns if c != "_sorted"]
    return df.select(*cols, F.coalesce(F.when(F.col("_sorted").isNotNull(), covered), F.lit(0)).cast("long").alias(out))


def base_counts(docs: DataFrame, keep: tuple[str, ...], more: bool = False) -> DataFrame:
    """The columns `keep` of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of column text.

    more: also n_distinct_words, n_lines, n_upper, n_letters, n_digits, n_bangs, n_pipes, n_punct. Null texts count as empty.
    """
    df = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    df = held(df, _words=words_of(F.col("_text")), _lines=worded_lines(F.col("_text")))
    text = F.col("_text")
    counts = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": (F.length(text) - count_chars(text, SPACE_CLASS)).cast("long"),
        "n_symbols": count_chars(text, SYMBOLS),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }
    if more:
        counts |= {
            "n_distinct_words": F.size(F.array_distinct("_words")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_upper": count_chars(text, r"\p{Lu}"),
            "n_letters": count_chars(text, r"\p{L}"),
            "n_digits": count_chars(text, "0-9"),
            "n_bangs": count_chars(text, "!"),
            "n_pipes": count_chars(text, "|"),
            "n_punct": count_chars(text, ".,;:?"),
        }
    df = df.select(*keep, "_words", *[c.alias(n) for n, c in counts.items()])
    return with_repeats(df, "_words")
