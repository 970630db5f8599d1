"""Problem 1: texts that look the same in one consistent form, and cards of one archival address that meet.

``canonical`` is compatibility normalisation in composed form with full case folding, mapped white space and no
default-ignorable characters. ``address_form`` adds what an archival address needs: a look-alike sign in the place of
a digit becomes that digit, and a look-alike letter at the end becomes the Cyrillic one. Both work once for each
distinct value of an Arrow batch, so the plan has no shuffle and a value that holds a third of the rows costs nothing.

Results at the edges: null stays null; an empty or blank value becomes ''; a value with signs outside the address
alphabet keeps them in canonical form; rows are never dropped by ``with_forms``.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ranges of Default_Ignorable_Code_Point in the Unicode Character Database.
DEFAULT_IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# Signs that stand for a digit, after case folding.
DIGIT_LOOKALIKES = {
    "0": "oоοօσ", "1": "liіιıӏ|!ǀ", "2": "zƨ", "3": "зʒэɜҙӡ", "4": "чҷ", "5": "sѕƽ", "6": "бb", "7": "т", "8": "вȣ", "9": "gqд",
}
# Letters that look like a Cyrillic one, after case folding.
CYRILLIC_LOOKALIKES = {
    "а": "aɑαа", "в": "bʙβ", "г": "rɼг", "е": "eεє", "ё": "ë", "и": "uиɩ", "й": "ŭ", "к": "kκĸ", "м": "mμ", "н": "hʜ",
    "о": "oοօ", "р": "pρ", "с": "cϲɔ", "т": "tτ", "у": "yγʏ", "х": "xχ", "б": "ƃ", "з": "ʒɜ", "п": "nπ", "д": "δ", "л": "λ", "ф": "φ",
}

_IGNORABLE = {c: None for a, b in DEFAULT_IGNORABLE for c in range(a, b + 1)}
_SPACES = {c: " " for c in range(sys.maxunicode + 1) if chr(c).isspace() or unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp")}
_MAPPED = _IGNORABLE | _SPACES
_TO_DIGIT = {ord(c): d for d, signs in DIGIT_LOOKALIKES.items() for c in signs}
_TO_CYRILLIC = {ord(c): d for d, signs in CYRILLIC_LOOKALIKES.items() for c in signs}
_DIGITS = frozenset("0123456789")


def canonical(text: str | None) -> str | None:
    """One consistent form of a text; applying it again changes nothing."""
    if text is None:
        return None
    if text.isascii():
        return " ".join(text.casefold().split())
    text = unicodedata.normalize("NFKC", text.translate(_MAPPED))
    text = unicodedata.normalize("NFKC", text.casefold()).translate(_MAPPED)
    # a fold may bring about a new pair to compose, so it is repeated until nothing changes
    while (again := unicodedata.normalize("NFKC", text.casefold()).translate(_MAPPED)) != text:
        text = again
    return " ".join(text.split())


def address_form(value: str | None) -> str | None:
    """The consistent form of an inventory code or a file number: digits, then at most one Cyrillic letter."""
    text = canonical(value)
    if text is None:
        return None
    text = text.replace(" ", "")
    if not text:
        return ""
    head, last = text[:-1], text[-1]
    if not head or last in _DIGITS:
        head, last = text, ""
    return head.translate(_TO_DIGIT) + last.translate(_TO_CYRILLIC)


def _by_distinct(values: pd.Series, f) -> pd.Series:
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    forms = [f(x) for x in distinct]
    return pd.Series([forms[c] if c >= 0 else None for c in codes], dtype=object)


@F.pandas_udf(T.StringType())
def _canonical_udf(values: pd.Series) -> pd.Series:
    return _by_distinct(values, canonical)


@F.pandas_udf(T.StringType())
def _address_udf(values: pd.Series) -> pd.Series:
    return _by_distinct(values, address_form)


_address_udf = _address_udf.asNondeterministic()


def canonical_column(column: Column | str) -> Column:
    """``canonical`` as a column."""
    return _canonical_udf(column)


def address_column(column: Column | str) -> Column:
    """``address_form`` as a column."""
    return _address_udf(column)  # marked as nondeterministic, so that no filter is pushed below it and it runs once


def with_forms(df: DataFrame, opis: str = "opis_code", delo: str = "delo", prefix: str = "form_") -> DataFrame:
    """``df`` with the consistent form of its address beside the stored one, as ``form_<column>``.

    A column of that name in ``df`` is replaced. Rows stay as they are, repeated ones too.
    """
    return df.withColumns({f"{prefix}{opis}": address_column(F.col(opis)), f"{prefix}{delo}": address_column(F.col(delo))})


def addresses(catalog: DataFrame) -> DataFrame:
    """One row for each card and stored address: portal_id, opis_code, delo, form_opis_code, form_delo, cards, forms.

    ``cards`` counts the different portal_ids of the address, ``forms`` the different stored spellings. Cards with a
    null id or a null part of the address are left out. The counts come from a partial aggregation, so an address
    with a third of all cards is added up before the shuffle.
    """
    kept = with_forms(catalog.select("portal_id", "opis_code", "delo").dropna().distinct())
    key = ["form_opis_code", "form_delo"]
    counts = kept.groupBy(*key).agg(
        F.countDistinct("portal_id").alias("cards"), F.countDistinct(F.struct("opis_code", "delo")).alias("forms")
    )
    return kept.join(counts, key).select("portal_id", "opis_code", "delo", *key, "cards", "forms")


def same_address_pairs(catalog: DataFrame) -> DataFrame:
    """Pairs portal_id_a < portal_id_b of one address whose stored strings are not both equal.

    The join is an equi-join on the consistent address, which adaptive execution splits where one address is hot. A
    pair of cards that meets in several stored spellings comes out once.
    """
    kept = with_forms(catalog.select("portal_id", "opis_code", "delo").dropna().distinct())
    a, b = (kept.select(*(F.col(c).alias(f"{c}_{s}") for c in kept.columns)) for s in "ab")
    return (
        a.join(b, (F.col("form_opis_code_a") == F.col("form_opis_code_b")) & (F.col("form_delo_a") == F.col("form_delo_b")))
        .filter("portal_id_a < portal_id_b and (opis_code_a <> opis_code_b or delo_a <> delo_b)")
        .select(F.col("portal_id_a").cast("bigint"), F.col("portal_id_b").cast("bigint"))
        .distinct()
    )
