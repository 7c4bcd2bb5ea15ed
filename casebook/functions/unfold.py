"""Full Unicode folding where the JVM has no normalisation: Arrow functions over text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F


@lru_cache(1)
def _bases() -> dict[int, str | None]:
    """What every character that has a compatibility decomposition, or is a combining mark, becomes: the letters of its
    decomposition. The ligature oe has none and is opened by hand."""
    out: dict[int, str | None] = {ord("œ"): "oe", ord("Œ"): "OE"}
    for code in range(0x80, 0x110000):
        char = chr(code)
        if unicodedata.combining(char):
            out[code] = None
        elif unicodedata.decomposition(char) or 0xAC00 <= code <= 0xD7A3:
            out[code] = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
    return out


def fold_text(text: str) -> str:
    """Decomposed, without combining marks, ligature opened, white space squeezed, case folded."""
    return " ".join(text.translate(_bases()).split()).casefold()


def unicode_fold(text):
    """``fold_text`` of a column."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else fold_text(t))

    return F.pandas_udf(run, "string")(text)


def first_letter(text):
    """The first character, decomposed and lower-cased."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if not t else unicodedata.normalize("NFD", t).lower()[:1])

    return F.pandas_udf(run, "string")(text)
