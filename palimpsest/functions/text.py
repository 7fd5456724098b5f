"""Representation-only text normalisation.

ASCII texts stay in the JVM; only texts with other characters go through Arrow, since
Spark has no Unicode normalisation forms and no case folding. A null stays null.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space among ASCII, as Python's str.strip sees it.
ASCII_SPACE = "[\\x09-\\x0D\\x1C-\\x20]+"
#: Letters, numbers and the underscore, as str.isalnum sees them.
WORD_CHAR = "[\\p{L}\\p{N}_]"
_WORD = re.compile(r"\w+")


@F.pandas_udf(StringType())
def _scored(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFC", t).strip()).casefold(), na_action="ignore")


def checked(text: str) -> str:
    """normalize_check of one text, for use inside tasks."""
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold().split())


@F.pandas_udf(StringType())
def _checked(texts: pd.Series) -> pd.Series:
    return texts.map(checked, na_action="ignore")


@F.pandas_udf(StringType())
def _stripped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t.strip()).casefold(), na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _WORD.findall(unicodedata.normalize("NFKC", t).casefold()), na_action="ignore")


def _split_by_script(text: Column, ascii_form: Column, udf) -> Column:
    other = text.rlike("[^\\x00-\\x7F]")
    return F.when(other, udf(F.when(other, text))).otherwise(ascii_form)


def _ends(text: Column) -> Column:
    return F.regexp_replace(text, f"^{ASCII_SPACE}|{ASCII_SPACE}$", "")


def normalize_answer(text: Column) -> Column:
    """NFC, trimmed, runs of white space as one space, case folded."""
    return _split_by_script(text, F.lower(F.regexp_replace(_ends(text), ASCII_SPACE, " ")), _scored)


def normalize_check(text: Column) -> Column:
    """NFKC, case folded, words joined by one space."""
    return _split_by_script(text, F.lower(F.regexp_replace(_ends(text), ASCII_SPACE, " ")), _checked)


def normalize_strip(text: Column) -> Column:
    """Trimmed, NFC, case folded; white space inside stays."""
    return _split_by_script(text, F.lower(_ends(text)), _stripped)


def unicode_words(text: Column) -> Column:
    """Words of letters, digits and underscores, NFKC and case folded."""
    return _split_by_script(text, F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)")), _words)


def contains_expression(text: Column, expression: Column) -> Column:
    """Whether the normalised text holds the whole normalised expression, literally and
    between word bounds."""
    literal = F.replace(normalize_check(expression), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.regexp_like(normalize_check(text), F.concat(F.lit(f"(?<!{WORD_CHAR})\\Q"), literal, F.lit(f"\\E(?!{WORD_CHAR})")))


def overlap(a: Column, b: Column) -> Column:
    """Whether either holds the other as an expression."""
    return contains_expression(a, b) | contains_expression(b, a)
