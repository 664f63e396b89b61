"""Character n-grams and the similarities built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANALYZERS = ("char_wb", "char", "word")


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """All n-grams of a text: lower-cased, blanks collapsed, one blank around it."""
    clean = F.concat(F.lit(" "), F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit(" "))
    return _grams(clean, low, high)


def _slide(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters of a text that has as many."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))


def _none() -> Column:
    return F.array().cast("array<string>")


def _grams(text: Column, low: int, high: int) -> Column:
    return F.concat(*[F.when(F.length(text) >= n, _slide(text, n)).otherwise(_none()) for n in range(low, high + 1)])


def char_wb_ngrams(text: Column, low: int, high: int) -> Column:
    """n-grams inside the words, each word between blanks; a short word is one gram."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    # Two blanks between words: a gram that crosses from one to the next holds both.
    padded = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    inside = [F.filter(_slide(padded, n), lambda g: ~g.contains("  ")) for n in range(low, high + 1)]
    grams = F.concat(*[F.when(F.length(padded) >= n, own).otherwise(_none()) for n, own in zip(range(low, high + 1), inside, strict=True)])
    # A word shorter than the least n gives itself once.
    short = F.transform(F.filter(words, lambda w: F.length(w) + 2 < low), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.when(F.size(words) > 0, F.concat(grams, short)).otherwise(_none())


def word_ngrams(text: Column, low: int, high: int, stop_words: tuple[str, ...] = ()) -> Column:
    """Runs of ``low`` to ``high`` words of two or more letters or digits, stop words left out first."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(_none())

    return F.concat(*[runs(n) for n in range(low, high + 1)])


def grams_of(text: Column, analyzer: str, low: int, high: int, stop_words: tuple[str, ...] = ()) -> Column:
    """The n-grams that an analyzer ("char_wb", "char" or "word") finds in a text."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"analyzer must be one of {ANALYZERS}, not {analyzer!r}")
    if analyzer == "word":
        return word_ngrams(text, low, high, stop_words)
    if analyzer == "char_wb":
        return char_wb_ngrams(text, low, high)
    return _grams(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s\s+", " ")), low, high)


def numbered_grams(grams: Column) -> Column:
    """Each gram with the number of its occurrence: a list without repeats."""
    ordered = F.array_sort(grams)
    return F.transform(ordered, lambda g, i: F.concat(g, F.lit("\0"), (i - F.array_position(ordered, g)).cast("string")))


def similarity_of(left: Column, right: Column) -> Column:
    """Shared over all entries of two lists of numbered grams."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def ngram_similarity(left: Column, right: Column, low: int, high: int) -> Column:
    """Shared n-grams over all n-grams of two texts, with multiplicities."""
    return similarity_of(numbered_grams(char_ngrams(left, low, high)), numbered_grams(char_ngrams(right, low, high)))
