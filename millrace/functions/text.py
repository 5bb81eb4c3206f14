"""Text cleaning and tokenizing as Column functions.

Everything but Unicode normalization is a built-in expression. Character
classes are spelled so that Java's regex engine agrees with the Unicode classes
that the rules are stated in: word characters are letters, numbers and "_";
white space includes U+001C-U+001F, U+0085 and all separators. Characters of
Unicode 14 to 15.1, which Java 17 doesn't know, are listed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of Unicode 14 to 15.1 that are letters, numbers, decimal digits and non-spacing marks, others that are assigned, and one that is a non-spacing mark no longer.
NEWER_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7D0-A7D1 A7D3 A7D5-A7D9 A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 "
    "105B3-105B9 105BB-105BC 10780-10785 10787-107B0 107B2-107BA 10F70-10F81 11071-11072 11075 1123F-11240 11740-11746 11AB0-11ABF 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 "
    "16A70-16ABE 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE "
    "2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
NEWER_DIGITS = "11F50-11F59 16AC0-16AC9 1E4F0-1E4F9"
NEWER_NUMBERS = f"{NEWER_DIGITS} 1D2C0-1D2D3"
NEWER_MARKS = "898-89F 8CA-8D2 C3C ECE 180F 1AC1-1ACE 1DFA 10EFD-10EFF 10F82-10F85 11070 11073-11074 110C2 11241 11F00-11F01 11F36-11F3A 11F40 11F42 13440 13447-13455 1CF00-1CF2D 1CF30-1CF46 1E08F 1E2AE 1E4EC-1E4EF"
NEWER_OTHERS = (
    "61D 888 890-891 CF3 1715 1B7D-1B7E 20C0 2E53-2E5D 2FFC-2FFF 31EF FBC2 FD40-FD4F FDCF FDFE-FDFF 10F86-10F89 116B9 11B00-11B09 11F03 11F34-11F35 11F3E-11F3F 11F41 11F43-11F4F "
    "12FF1-12FF2 13439-1343F 1CF50-1CFC3 1D1E9-1D1EA 1F6DC-1F6DF 1F774-1F776 1F77B-1F77F 1F7D9 1F7F0 1F979 1F9CC 1FA75-1FA77 1FA7B-1FA7C 1FA87-1FA88 1FAA9-1FAAF 1FAB7-1FABD 1FABF 1FAC3-1FAC5 1FACE-1FACF 1FAD7-1FADB 1FAE0-1FAE8 1FAF0-1FAF8"
)
NO_MARK = "1734"


def code_points(*ranges: str) -> str:
    """A class of code points in hex; others than those beyond Arabic are told at once."""
    either = ("-".join(rf"\x{{{c}}}" for c in r.split("-")) for r in " ".join(ranges).split())
    return rf"[[^\x00-\x{{600}}]&&[{''.join(either)}]]"


# Classes, to be used within brackets.
LETTER = rf"\p{{L}}{code_points(NEWER_LETTERS)}"
LETTER_OR_NUMBER = rf"\p{{L}}\p{{N}}{code_points(NEWER_LETTERS, NEWER_NUMBERS)}"
DIGIT = rf"[\p{{Nd}}{code_points(NEWER_DIGITS)}]"
MARK = rf"[[\p{{Mn}}&&[^\x{{{NO_MARK}}}]]{code_points(NEWER_MARKS)}]"
UNASSIGNED = rf"[\p{{Cn}}&&[^{code_points(NEWER_LETTERS, NEWER_NUMBERS, NEWER_MARKS, NEWER_OTHERS)}]]"

# Patterns that define what is removed, and classes.
URL = r"https?://[!$-_a-z]+"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?U)(\+?1[-.\s]?)?(\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}"
NUMBER = rf"(?<![{LETTER_OR_NUMBER}_]){DIGIT}+(?![{LETTER_OR_NUMBER}_])"
SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
WORD = rf"[{LETTER_OR_NUMBER}_]+"
SENTENCE_END = r"[.!?]+"

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
TOKENIZERS = ("whitespace", "word", "sentence")
#: Tokens with fixed ids, in id order.
SPECIAL_TOKENS = ("<PAD>", "<UNK>", "<BOS>", "<EOS>")


def normalize(text: Column, form: str = "NFKC") -> Column:
    """Unicode normalization. ASCII is a fixed point, so only other texts go through Python."""
    if form not in FORMS:
        raise ValueError(f"unknown Unicode form {form!r}")

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    return F.coalesce(run(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip_accents(text: Column) -> Column:
    """Decomposes and drops non-spacing marks; what stays is decomposed."""
    return F.regexp_replace(normalize(text, "NFD"), f"{MARK}+", "")


def gated(text: Column, gate: Column, pattern: str) -> Column:
    """Replaces matches by a blank where a cheap test says that there may be one."""
    return F.when(gate, F.regexp_replace(text, pattern, " ")).otherwise(text)


def remove_urls(text: Column) -> Column:
    return gated(text, F.contains(text, F.lit("://")), URL)


def remove_emails(text: Column) -> Column:
    return gated(text, F.contains(text, F.lit("@")), EMAIL)


def remove_phones(text: Column) -> Column:
    return gated(text, text.rlike(rf"\p{{Nd}}{{3}}[-.{SPACE}]?\p{{Nd}}{{4}}"), PHONE)


def remove_numbers(text: Column) -> Column:
    return F.regexp_replace(text, NUMBER, " ")


def remove_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{LETTER_OR_NUMBER}_{SPACE}]", " ")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_valid(text: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(text.rlike(f"[^{SPACE}]"), F.lit(False))


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences that are not blank."""
    return F.filter(F.split(text, SENTENCE_END, -1), lambda s: s.rlike(f"[^{SPACE}]"))


def tokenize(text: Column, kind: str = "whitespace") -> Column:
    """Tokens; sentence tokens keep their leading blanks and the empty tail."""
    if kind == "whitespace":
        return words(text)
    if kind == "word":
        return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    if kind == "sentence":
        return F.split(text, SENTENCE_END, -1)
    raise ValueError(f"unknown tokenizer {kind!r}")


@dataclass(frozen=True)
class TextConfig:
    """How texts are cleaned and tokenized; lengths count characters."""

    unicode_form: str | None = "NFKC"
    remove_accents: bool = False
    lowercase: bool = True
    remove_urls: bool = True
    remove_emails: bool = True
    remove_phone_numbers: bool = True
    remove_numbers: bool = False
    remove_punctuation: bool = False
    collapse_space: bool = True
    min_length: int | None = 1
    max_length: int | None = None
    tokenizer: str | None = "whitespace"
    special_tokens: bool = False
    bos: str = SPECIAL_TOKENS[2]
    eos: str = SPECIAL_TOKENS[3]

    def __post_init__(self) -> None:
        if self.tokenizer is not None and self.tokenizer not in TOKENIZERS:
            raise ValueError(f"unknown tokenizer {self.tokenizer!r}")
        if self.unicode_form and self.unicode_form not in FORMS:
            raise ValueError(f"unknown Unicode form {self.unicode_form!r}")


def cleaning_steps(config: TextConfig) -> list[Callable[[Column], Column]]:
    """The steps in their fixed order; each takes the column of the one before."""
    steps: list[tuple[bool, Callable[[Column], Column]]] = [
        (bool(config.unicode_form), lambda c: normalize(c, config.unicode_form or "NFKC")),
        (config.remove_accents, strip_accents),
        (config.lowercase, F.lower),
        (config.remove_urls, remove_urls),
        (config.remove_emails, remove_emails),
        (config.remove_phone_numbers, remove_phones),
        (config.remove_numbers, remove_numbers),
        (config.remove_punctuation, remove_punctuation),
        (config.collapse_space, collapse_space),
    ]
    return [step for wanted, step in steps if wanted]


def fit_length(text: Column, config: TextConfig) -> Column:
    """Texts that are too short become empty, long ones lose their end."""
    if config.max_length is not None:
        fitted = F.substring(text, 1, config.max_length)
    else:
        fitted = text
    return F.when(F.length(text) < config.min_length, "").otherwise(fitted) if config.min_length else fitted


def with_special_tokens(tokens: Column, config: TextConfig) -> Column:
    return F.concat(F.array(F.lit(config.bos)), tokens, F.array(F.lit(config.eos)))
