"""Measures of texts as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LETTER, LETTER_OR_NUMBER, SPACE, UNASSIGNED, words

# Listed words, harmful patterns, scripts and their thresholds, and the readability formula.
PROFANITY = ("badword1", "badword2", "offensive")
HARMFUL = (r"\b(kill|murder|bomb)\b",)
SCRIPTS = (("zh", r"[\x{4E00}-\x{9FFF}]"), ("ar", r"[\x{0600}-\x{06FF}]"), ("ru", r"[\x{0400}-\x{04FF}]"))
SCRIPT_SHARE, LATIN_SHARE = 0.3, 0.5
BEYOND_LATIN = r"[^\x{00}-\x{24F}]"
FLESCH = (206.835, 1.015, 84.6)


def profanity(text: Column) -> Column:
    """The listed words among the lower-cased tokens, each once, sorted. Only a text that has one somewhere is split."""
    low, listed = F.lower(text), F.array(*[F.lit(w) for w in PROFANITY])
    found = F.array_sort(F.array_intersect(F.array_distinct(words(low)), listed))
    return F.when(low.rlike("|".join(PROFANITY)), found).otherwise(F.array().cast("array<string>"))


def harmful(text: Column) -> Column:
    """Number of patterns that occur, in any case."""
    total = F.lit(0)
    for pattern in HARMFUL:
        total = total + text.rlike(f"(?i){pattern}").cast("int")
    return total


def special_ratio(text: Column) -> Column:
    """Share of characters that are neither letters, numbers nor white space."""
    special = F.length(F.regexp_replace(text, f"[{LETTER_OR_NUMBER}{SPACE}]+", ""))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(special / F.length(text))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def control_characters(text: Column) -> Column:
    return count(text, r"[\p{Cc}&&[^\n\r\t]]")


def unassigned_characters(text: Column) -> Column:
    return count(text, UNASSIGNED)


def language(text: Column) -> Column:
    """The script that dominates the letters; Latin text counts as "en", digits and blanks with it.

    Only texts with characters beyond Latin are counted; of the others one letter tells.
    """
    letters = count(text, f"[{LETTER}]")
    found = F.when(~text.rlike(f"[{LETTER}]"), "unknown").when(~text.rlike(BEYOND_LATIN), "en")
    for name, pattern in SCRIPTS:
        found = found.when(count(text, pattern) / letters > SCRIPT_SHARE, name)
    return found.when(count(text, r"[\x{00}-\x{24F}]") / letters > LATIN_SHARE, "en").otherwise("unknown")


def syllables(word: Column) -> Column:
    """Groups of vowels, less a final e, at least one."""
    low = F.lower(word)
    groups = F.size(F.regexp_extract_all(low, F.lit("[aeiouy]+"), F.lit(0)))
    return F.greatest(F.lit(1), groups - F.endswith(low, F.lit("e")).cast("int"))


#: A word without vowels, or whose only vowels are the run that its final e ends: it has a syllable less than it counts.
SHORT = rf"(?<![^{SPACE}])(?=[^{SPACE}])[^aeiouy{SPACE}]*+(?:[aeiouy]*e)?(?![^{SPACE}])"


def all_syllables(low: Column) -> Column:
    """Syllables of all words of a lower-cased text, as syllables() counts them, in three passes over the text: vowel runs never go beyond a word."""
    return count(low, "[aeiouy]+") - count(low, rf"e(?![^{SPACE}])") + count(low, SHORT)


def readability(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Flesch reading ease, from 0 to 100; 0 without words or sentences."""
    score = F.lit(FLESCH[0]) - F.lit(FLESCH[1]) * (n_words / n_sentences) - F.lit(FLESCH[2]) * (n_syllables / n_words)
    return F.when((n_words == 0) | (n_sentences == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def letters_in(text: Column) -> Column:
    """Characters of all words."""
    return F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long")
