"""Parsers of catalogue fields as columns: run-on names, numbers, dates, paths, glosses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.vocabulary import GLOSSES

# Labels of a run-on name, in order.
NAME_LABELS = ["Вид материала:", "Способ воспроизведения:", "Языки:", "Язык:", "Крайние даты:"]
# Month stems in the order they are looked for (март before ма).
MONTHS = [("январ", 1), ("феврал", 2), ("март", 3), ("апрел", 4), ("ма", 5), ("июн", 6), ("июл", 7), ("август", 8), ("сентябр", 9), ("октябр", 10), ("ноябр", 11), ("декабр", 12)]

# A scan's path: inventory, file number, page.
SCAN_PATH = r"opis_([^/]+)/delo_(\d+[а-яёa-z]?)/(\d+)\.jpg"
# A work in quotes.
QUOTED = r'[«"]([^»"]{5,})[»"]'
_STOPS = "|".join(NAME_LABELS)


def card_field(text: Column, label: str) -> Column:
    """What follows a label of a card, up to the next label; '' for an empty or missing field."""
    return F.trim(F.regexp_extract(text, rf"{label}\s*(.*?)\s*(?:{_STOPS}|$)", 1), F.lit(" .;"))


def name_fields(name: Column) -> dict[str, Column]:
    """title, material, reproduction and language of a run-on name."""
    return {
        "title": F.trim(F.split(name, _STOPS, 2)[0], F.lit(" .;")),
        "material": card_field(name, "Вид материала:"),
        "reproduction": card_field(name, "Способ воспроизведения:"),
        "language": card_field(name, "Языки?:"),
    }


def pad_number(delo: Column, width: int = 4) -> Column:
    """A file number with its digits padded with zeros, its suffix kept; longer numbers stay as they are."""
    digits, suffix = F.regexp_extract(delo, r"^0*(\d+)", 1), F.regexp_extract(delo, r"^\d+(.*)$", 1)
    return F.when(delo.rlike(r"^\d"), F.concat(F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits), suffix)).otherwise(delo)


def strip_zeros(delo: Column) -> Column:
    """A file number without leading zeros; '0' if nothing is left."""
    return F.regexp_replace(delo, r"^0+(?=.)", "")


def year_range(raw: Column) -> dict[str, Column]:
    """First and last full year of a text and whether a bracket marks it as conjectural."""
    years = F.transform(F.regexp_extract_all(raw, F.lit(r"(?U)\b(1[89]\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    return {"year_from": F.array_min(years), "year_to": F.array_max(years), "bracketed": F.contains(raw, F.lit("["))}


def partial_date(raw: Column) -> tuple[Column, Column]:
    """(array of year, month, day with 0 for unknown, precision 3, 2, 1) of the start of a date, up to the first hyphen;
    nulls if there is none. A month is a word that begins with its stem."""
    head = F.split(F.trim(raw), "-", 2)[0]
    day = [F.regexp_extract(head, r"(?U)\b(\d{1,2})\.(\d{1,2})\.(1[89]\d\d)", k).try_cast("int") for k in (3, 2, 1)]
    year = F.regexp_extract(head, r"(?U)\b(1[89]\d\d)", 1).try_cast("int")
    month = F.lit(0)
    for stem, number in reversed(MONTHS):
        month = F.when(F.lower(head).rlike(rf"(?U)\b{stem}[а-я]*\b"), number).otherwise(month)
    is_day = day[0].isNotNull()
    ymd = F.when(is_day, F.array(*day)).when(year.isNotNull(), F.array(year, month, F.lit(0)))
    precision = F.when(is_day, 3).when(year.isNotNull() & (month > 0), 2).when(year.isNotNull(), 1)
    return ymd, precision


def earlier_at_common_precision(a: Column, pa: Column, b: Column, pb: Column) -> Column:
    """Whether date a is before date b as far as both are known."""
    k = F.least(pa, pb)
    return F.slice(a, F.lit(1), k) < F.slice(b, F.lit(1), k)


def quoted_work(name: Column) -> Column:
    """The work a name quotes (five characters and more), in lower case with е for ё; null if there is none."""
    return F.nullif(F.translate(F.lower(F.trim(F.regexp_extract(name, QUOTED, 1))), "ё", "е"), F.lit(""))


def variant_number(name: Column) -> Column:
    """The number of a variant, null if the name has none."""
    return F.regexp_extract(name, r"(\d)-й вариант", 1).try_cast("int")


def path_parts(path: Column) -> dict[str, Column]:
    """Inventory, file and page of a scan's path."""
    return {n: F.regexp_extract(path, SCAN_PATH, k) for k, n in enumerate(("path_opis", "path_delo", "path_page"), 1)}


def corpus_path(path: Column) -> dict[str, Column]:
    """Inventory and file of the path of a document, of a folder of sheets or of a sheet."""
    return {n: F.nullif(F.regexp_extract(path, r"opis_([^/]+)/delo_([^/.]+)(?:\.md$|/|$)", k), F.lit("")) for k, n in enumerate(("opis_code", "delo"), 1)}


def scan_path(opis: Column, delo: Column, page: Column) -> Column:
    return F.concat(F.lit("data/opis_"), opis, F.lit("/delo_"), delo, F.lit("/"), page, F.lit(".jpg"))


def gloss(value: Column, domain: str) -> Column:
    """A comma-separated value with each term glossed, by its own form or lower case; unknown terms stay."""
    table = F.create_map(*(F.lit(x) for pair in GLOSSES[domain].items() for x in pair))
    terms = F.filter(F.transform(F.split(value, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.array_join(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), F.try_element_at(table, F.lower(t)), t)), ", ")


def expand_pages(spec: Column, width: int = 3) -> Column:
    """'003-007' or '3,5' as an array of padded pages."""
    ends = [F.regexp_extract(spec, r"^(\d+)-(\d+)$", k).try_cast("int") for k in (1, 2)]
    ranged = F.when((ends[0].isNotNull()) & (ends[0] <= ends[1]), F.transform(F.sequence(*ends), lambda n: F.lpad(n.cast("string"), width, "0")))
    return F.coalesce(ranged, F.transform(F.split(spec, ","), lambda p: F.lpad(F.trim(p), width, "0")))


def percent_encode(text: Column, safe: str = "/:?=&") -> Column:
    """Percent-encoding that keeps ``safe`` and writes a space as %20."""
    c = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for sign in safe:
        c = F.replace(c, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return c


def seconds_until(reply: Column, now: Column, longest: int = 7200) -> Column:
    """Seconds from ``now`` to a minute past a 12-hour clock time in a reply ('resets 1am'); 0 beyond ``longest`` or without one."""
    hour, minute, half = (F.regexp_extract(reply, r"(?i)resets?\s+(?:at\s+)?(\d{1,2})(?::(\d\d))?\s*(am|pm)", k) for k in (1, 2, 3))
    at = (hour.try_cast("int") % 12 + F.when(F.lower(half) == "pm", 12).otherwise(0)) * 3600 + F.coalesce(minute.try_cast("int"), F.lit(0)) * 60 + 60
    now_s = F.hour(now) * 3600 + F.minute(now) * 60 + F.second(now)
    wait = F.pmod(at - now_s, F.lit(86400))
    return F.when(hour == "", 0).when(wait > longest, 0).otherwise(wait)


# What a title does not hold for comparison (field labels and all after them).
TITLE_TAIL = r"вид материала[^\n]*|способ воспроизведения[^\n]*|языки[^\n]*"


def comparable(text: Column, drop: str | None = None) -> Column:
    """A title for comparison: lower case, е for ё, field labels and what follows gone, only letters, digits and single
    spaces. ``drop``: a pattern of what else goes, such as an author's name in brackets."""
    c = F.translate(F.lower(text), "ё", "е")
    c = F.regexp_replace(c, drop, " ") if drop else c
    c = F.regexp_replace(F.regexp_replace(c, TITLE_TAIL, " "), "[^а-яa-z0-9 ]", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def clean_title(name: Column) -> Column:
    """``comparable`` of what a name has in straight quotes, of the whole name without any."""
    quoted = F.regexp_extract(name, r'"([^"]+)"', 1)
    return comparable(F.when(quoted != "", quoted).otherwise(name))


def page_fields(html: Column, folder: str = r"[^/\\\\\"'> ]+", images: str = "/pageimages/") -> dict[str, Column]:
    """Name, inventory, file number and scan links of a file's page.

    The name stands between its label and the next one; the links are each taken once, in order of first appearance;
    the folder of the first link that has one is inventory, an underscore and the file number."""
    text = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"(?U)\s+", " ")
    name = F.trim(F.trim(F.trim(F.regexp_extract(text, r"Название: *(.+?)(?:Крайние даты|Количество (?:дел|листов)|Даты|$)", 1)), F.lit('"')))
    links = F.array_distinct(F.regexp_extract_all(html, F.lit(rf"(?i){images}[^\"'> ]+?\.jpg"), F.lit(0)))
    code = F.regexp_extract(F.array_join(links, " "), rf"{images}[^/\\ ]*\\({folder})/", 1)
    return {
        "name": name,
        "opis_code": F.when(F.contains(code, F.lit("_")), F.substring_index(code, "_", 1)),
        "delo_no": F.when(F.contains(code, F.lit("_")), F.regexp_replace(code, "^[^_]*_", "")),
        "links": F.transform(links, lambda x: F.replace(x, F.lit("\\"), F.lit("%5C"))),
    }


def source_url(base: str, portal_id: Column) -> Column:
    """The address of a card's page."""
    return F.format_string(f"{base.replace('%', '%%')}/%d", portal_id)


def inventory_label(opis: Column, code: Column) -> Column:
    """An inventory's name, or its code for one that has none."""
    return F.coalesce(opis, F.concat(F.lit("opis "), code))


def is_number(c: Column) -> Column:
    """Whether a text is nothing but digits; false for null."""
    return F.coalesce(c.rlike(r"^[0-9]+$"), F.lit(False))


# Stems of the topics that are looked at first.
TOPICS = r"реактивн|ракет|космическ|звездоплав|мировых\s+пространств|небесных\s+пространств|вне\s+земли|эфирн|межпланетн|заатмосферн|тяготени|скорост"


def on_topic(title: Column, topics: str = TOPICS) -> Column:
    """Whether a title has one of the topics, whatever its case; false for null."""
    return F.coalesce(title.rlike(f"(?iu){topics}"), F.lit(False))


def has_all(c: Column, *parts: str) -> Column:
    """Whether a text holds every part; false for null."""
    out = F.lit(True)
    for part in parts:
        out = out & F.contains(c, F.lit(part))
    return F.coalesce(out, F.lit(False))


def translated(source: Column, target: Column) -> Column:
    """Whether there is a translation that differs from the original; false for an empty one or null."""
    return F.coalesce((target != "") & ~target.eqNullSafe(source), F.lit(False))


def thousands(n: Column) -> Column:
    """A whole number with commas between groups of three digits."""
    return F.format_number(n, 0)


def percent(part: Column, whole: Column) -> Column:
    """A share in whole percent, halves to the even number; null of nothing."""
    return F.when(whole != 0, F.concat(F.bround(part * 100 / whole, 0).cast("int").cast("string"), F.lit("%")))


def first_long_enough(a: Column, b: Column, least: int = 30) -> Column:
    """The first text if it has at least ``least`` words, else the second."""
    return F.when(F.regexp_count(a, F.lit(r"(?U)\S+")) >= least, a).otherwise(b)


def order_keys(delo: Column) -> dict[str, Column]:
    """Two orders of file numbers: as text padded to five signs (a suffix counts as a sign), and by number, then text."""
    return {
        "as_text": F.when(F.length(delo) < 5, F.lpad(delo, 5, "0")).otherwise(delo),
        "as_number": F.coalesce(F.regexp_replace(delo, r"\D", "").try_cast("int"), F.lit(0)),
    }
