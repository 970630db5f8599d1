"""Text functions as columns: editorial markup, orthographic folding, tokens, rates. All JVM-side but NFKC.

Every function takes and returns a column; null gives null. ``(?U)`` makes \\w and \\s follow Unicode, ``(?d)`` makes
a dot stop at \\n only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of bracketed marks whose text is not the author's running text.
STRIPPED_MARKS = ["вставка", "на полях", "другой почерк", "формула", "рисунок", "штамп"]
# Pre-reform letters and ё, and what they fold to.
FOLD_FROM, FOLD_TO = "ѣіѳѵё", "еифие"
# Quotation marks and dashes that normalisation makes alike.
QUOTES, DASHES = "«»„“”‟‹›", "‐‑‒–—―−"


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_markup(c: Column, drop_struck: bool = True) -> Column:
    """Text without editorial marks: struck words (or only their signs), bracketed marks, illegible places, doubts."""
    c = F.regexp_replace(c, r"(?d)~~.*?~~", " ") if drop_struck else F.regexp_replace(c, "~~", "")
    c = F.regexp_replace(c, r"\[(?:" + "|".join(STRIPPED_MARKS) + r")[^\]]*\]", " ")
    c = F.regexp_replace(c, r"\[неразборчиво[^\]]*\]", " ")
    return squeeze(F.regexp_replace(c, r"\[\?\]", ""))


def fold_orthography(c: Column) -> Column:
    """Lower case, no final ъ, old letters modern, ё as е, punctuation as spaces. The ъ goes before punctuation does, so
    one that a comma shields stays."""
    c = F.regexp_replace(F.lower(c), r"ъ(?=\s|$)", "")
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"(?U)[^\w\s]", " ")


def word_tokens(c: Column) -> Column:
    """Folded words of a marked-up text, in order; a word with an inner sign holds a space in its place."""
    words = F.split(clean_markup(c), " ")
    return F.filter(F.transform(words, lambda w: F.trim(fold_orthography(w))), lambda w: w != "")


# Markup that the full-text index leaves out: marks, and lines of headings, of fields and of notes.
INDEX_MARKUP = r"\[[^\]]*\]|~~|^#+[^\n]*|^\*\*[^\n]*|^>[^\n]*"


def index_terms(c: Column) -> Column:
    """Terms of the full-text index: markup removed, lower case, runs of three letters and more, ё as е."""
    c = F.regexp_replace(F.lower(c), f"(?dm){INDEX_MARKUP}", " ")
    return F.transform(F.regexp_extract_all(c, F.lit(r"[а-яёa-z]{3,}"), F.lit(0)), lambda w: F.translate(w, "ё", "е"))


def spaced_words(c: Column) -> Column:
    """How many pieces white space divides the text into."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def uncertainty(c: Column, least: int = 30) -> Column:
    """Doubtful and illegible places for each word; null under ``least`` words."""
    n = spaced_words(c)
    marks = F.regexp_count(c, F.lit(r"\[\?\]")) + F.regexp_count(c, F.lit(r"\[неразборчиво"))
    return F.when(n >= max(least, 1), marks / n)


def uncertainty_or_zero(c: Column) -> Column:
    """``uncertainty`` without a least number of words; 0 for a text without words."""
    return F.when(c.isNotNull(), F.coalesce(uncertainty(c, 1), F.lit(0.0)))


def archaisation(c: Column, least: int = 30) -> Column:
    """Old letters and final ъ for each word; null under ``least`` words."""
    n = spaced_words(c)
    return F.when(n >= max(least, 1), (F.regexp_count(c, F.lit("[ѣіѳѵѢІѲѴ]")) + F.regexp_count(c, F.lit(r"[ъЪ](?![\p{L}\p{N}_])"))) / n)


def normal_line(c: Column) -> Column:
    """A line's letters and digits in lower case, for comparing lines."""
    return F.regexp_replace(F.lower(c), r"(?U)[^\p{Alnum}]", "")


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def normalize_text(c: Column, fold: bool = False) -> Column:
    """A text ready for comparison: headings and markup removed, line-end hyphens joined, compatibility forms, lower
    case, one kind of quotes, no punctuation; with ``fold`` old orthography made modern as well."""
    c = F.regexp_replace(c, r"(?m)^(?:#|>|---|\*\*).*$", " ")
    c = F.regexp_replace(clean_markup(F.regexp_replace(c, r"-\n", "")), "[" + QUOTES + "]", '"')
    c = F.regexp_replace(F.translate(F.lower(_nfkc(c)), "ё", "е"), "[" + DASHES + "]", "-")
    c = squeeze(F.regexp_replace(c, r"(?U)[^\w\s]", " "))
    return squeeze(F.translate(F.regexp_replace(c, r"ъ(?=\s|$)", ""), FOLD_FROM, FOLD_TO)) if fold else c


def mark_counts(c: Column) -> dict[str, Column]:
    """Counts of sheets, doubts, illegible places and struck words in an assembled document."""
    return {
        "sheets": F.regexp_count(c, F.lit(r"(?m)^## Лист ")),
        "doubts": F.regexp_count(c, F.lit(r"\[\?\]")),
        "illegible": F.regexp_count(c, F.lit(r"\[неразборчиво")),
        "struck": F.regexp_count(c, F.lit(r"(?d)~~.+?~~")),
    }


def strip_html(c: Column) -> Column:
    """HTML without tags, white space collapsed."""
    return squeeze(F.regexp_replace(c, r"<[^>]+>", " "))


# Classes of page elements that are no text.
NO_TEXT_CLASSES = "reference|pagenum|ws-noexport|ws-summary"


def strip_blocks(c: Column) -> Column:
    """HTML without scripts, styles, tables, elements of the classes that are no text, and tags; entities as characters
    (numeric ones of the basic plane, and the named ones that pages use)."""
    c = F.regexp_replace(c, r"(?is)<(script|style|table)[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, rf'(?is)<(sup|span|div)[^>]*class="[^"]*(?:{NO_TEXT_CLASSES})[^"]*"[^>]*>.*?</\1>', " ")
    c = strip_html(c)
    # Entities that pages use.
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&laquo;", "«"), ("&raquo;", "»"), ("&bdquo;", "„"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&shy;", "\u00ad")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    # numeric entities: the text between them stays, each number becomes its sign
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"&#(\d{1,5}|[xX][0-9a-fA-F]{1,4});"), F.lit(1)), _entity)
    between = F.split(c, r"&#(?:\d{1,5}|[xX][0-9a-fA-F]{1,4});", -1)
    c = F.array_join(F.zip_with(between, numbers, lambda t, n: F.concat(t, F.coalesce(n, F.lit("")))), "")
    return squeeze(F.replace(c, F.lit("&amp;"), F.lit("&")))


def _entity(n: Column) -> Column:
    code = F.when(n.rlike("^[xX]"), F.conv(F.substr(n, F.lit(2)), 16, 10)).otherwise(n).cast("int")
    octets = F.lpad(F.hex(code), 4, "0")
    return F.when(code.between(1, 65535), F.decode(F.unhex(octets), "UTF-16BE"))


def contradictions(c: Column, pattern: str, want: Column) -> Column:
    """What a pattern's first group finds in a text besides the value it should be, each once."""
    return F.array_except(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.array(want.cast("string")))


def states(c: Column, claim: Column) -> Column:
    """Whether a text states a claim, without regard to case and white space."""
    return F.contains(F.lower(squeeze(c)), F.lower(squeeze(claim)))


def balanced(c: Column, opening: str = "{", closing: str = "}") -> Column:
    """Whether a text opens and closes equally often."""
    return F.length(F.replace(c, F.lit(opening), F.lit(""))) == F.length(F.replace(c, F.lit(closing), F.lit("")))
