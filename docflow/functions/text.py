"""Text functions as native columns."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from docflow import rules

#: Unicode white space, as ``(?U)\\s`` has it.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, computed once: a column that occurs several times in another is computed each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nfc(text: Column) -> Column:
    """Unicode composition by ICU, which is part of Spark: no Python. ASCII texts stay as they are."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(F.octet_length(text) != F.length(text), composed).otherwise(text)


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def unescaped(text: Column) -> Column:
    """Character references decoded. Python sees a null in place of a text without any."""
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.btrim(text, F.lit(WHITE))


def squash(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_controls(text: Column, keep: str = r"\n") -> Column:
    """Without zero-width characters and the Unicode category C, but for ``keep``."""
    return F.regexp_replace(text, rf"[^\P{{C}}{keep}]", "")


def clean_prose(text: Column, compose: bool = True) -> Column:
    """Tabs and lone carriage returns go before white space is collapsed."""
    text = without_controls(nfc(text) if compose else text)
    return strip(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


def clean_code(text: Column, compose: bool = True) -> Column:
    return without_controls(nfc(text) if compose else text, r"\n\t")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first and the rest small, digits and marks ending a run."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def looks_like_code(text: Column) -> Column:
    token = F.lit(False)
    for t in rules.CODE_TOKENS:
        token = token | text.contains(t)
    return (text.contains("\n") & token) | (F.regexp_count(text, F.lit(";")) >= 2) | (text.contains("{") & text.contains("}"))
