"""Documents made of sheets and split into them again; comparisons of overlapping strips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions import parse
from papyrine.functions.text import normal_line

_HEAD = r"(?m)^## Лист (\S+)\s*$"


def assemble(sheets: DataFrame, keys: list[str], sheet: str, text: str) -> DataFrame:
    """(keys, sheets, document): the sheets of each file in order, each under its heading, with rules between them.

    A file is one document, so its text is one value; null sheets are set apart from declared empty ones.
    """
    ordered = sheets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(sheet, text))).alias("xs"))
    joined = F.array_join(F.transform("xs", lambda x: F.concat(F.lit("## Лист "), x[sheet], F.lit("\n\n"), F.coalesce(x[text], F.lit("[не получено]")))), "\n\n---\n\n")
    return ordered.select(*keys, F.size("xs").alias("sheets"), joined.alias("document"))


def split_sheets(documents: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, ord, sheet, text): the sheets of a document; one with the name of an earlier one takes its place."""
    names = F.regexp_extract_all(text, F.lit(_HEAD), F.lit(1))
    bodies = F.slice(F.split(text, _HEAD, -1), F.lit(2), F.size(names))
    parts = documents.select(*keys, F.posexplode(F.arrays_zip(names.alias("sheet"), bodies.alias("body"))).alias("ord", "x")).select(*keys, "ord", F.col("x.sheet").alias("sheet"), F.col("x.body").alias("body"))
    last = parts.groupBy(*keys, "sheet").agg(F.max("ord").alias("ord"))
    trimmed = F.regexp_replace(F.regexp_replace("body", r"\s*\n---\s*$", ""), r"^\s+|\s+$", "")
    return parts.join(last, [*keys, "sheet", "ord"], "left_semi").select(*keys, "ord", "sheet", trimmed.alias("text"))


def complete_only(df: DataFrame, done: str, expected: str) -> DataFrame:
    """Files of which all expected sheets (and at least one) are there."""
    return df.filter((F.col(expected) > 0) & (F.col(done) >= F.col(expected)))


def file_documents(readings: DataFrame, cards: DataFrame, volume: int = 500) -> DataFrame:
    """(opis_code, delo, volume, portal_id, sheets, document): the files of which every sheet has a done reading, each
    volume under a header with the file's particulars.

    ``cards`` has an address in the form that ``readings`` has it in, portal_id, opis, name and fetched_at; the newest
    card of an address counts, and a file without a card gets a header of its address only. A sheet takes its last done
    reading that has a text; a blank text is an empty sheet, a null one is not received. ``sheets`` counts the volume's.
    """
    key, done = ["opis_code", "delo"], F.col("status") == "done"
    pages = readings.groupBy(*key, "page").agg(F.max(F.coalesce(done, F.lit(False)).cast("int")).alias("done"))
    complete = complete_only(pages.groupBy(*key).agg(F.sum("done").alias("done"), F.count("*").alias("scans")), "done", "scans")
    last = readings.filter(done).groupBy(*key, "page").agg(F.max_by("text", F.struct(F.col("text").isNotNull(), "read_at", "reading_id")).alias("text"))
    text = F.when(F.col("text").rlike(r"(?U)^\s*$"), "[пустой лист]").otherwise(F.col("text"))
    sheets = last.join(complete.select(*key), key, "left_semi").withColumns({"text": text, "volume": F.floor(F.col("page").cast("int") / volume).cast("int")})
    card = cards.groupBy(*key).agg(F.max_by(F.struct("opis", "name", "portal_id"), F.struct("fetched_at", "portal_id")).alias("card")).select(*key, "card.*")
    fields = parse.name_fields(F.col("name")) | {"dates": parse.card_field(F.col("name"), "Крайние даты:")}
    labels = {"title": "Название", "material": "Вид материала", "reproduction": "Способ воспроизведения", "language": "Языки", "dates": "Крайние даты"}
    head = [F.concat(F.lit("# "), F.coalesce("opis", F.concat(F.lit("Опись "), "opis_code")), F.lit(", дело "), parse.strip_zeros(F.col("delo"))), F.lit("")]
    head += [F.when(fields[k] != "", F.concat(F.lit(f"**{v}:** "), fields[k])) for k, v in labels.items()]
    head += [F.concat(F.lit("**Сканов:** "), F.col("scans").cast("string")), F.concat(F.lit("**Источник:** карточка "), F.col("portal_id").cast("string"))]
    note = "\n> Машинная транскрипция. Экспертная выверка не проводилась. Орфография оригинала сохранена.\n\n---\n\n"
    heads = complete.select(*key, "scans").join(card, key, "left").select(*key, "portal_id", F.concat(F.concat_ws("\n", *head), F.lit("\n" + note)).alias("head"))
    bodies = assemble(sheets, [*key, "volume"], "page", "text")
    return bodies.join(heads, key).select(*key, "volume", "portal_id", F.col("sheets").cast("bigint").alias("sheets"), F.concat("head", "document").alias("document"))


def overlap(above: Column, below: Column, longest: int = 6) -> Column:
    """How many last lines of one strip are the first ones of the next, compared without case and signs (at most ``longest``)."""
    a, b = (F.transform(F.split(c, "\n"), normal_line) for c in (above, below))
    fits = [F.when((F.size(a) >= k) & (F.size(b) >= k) & (F.slice(a, -k, k) == F.slice(b, 1, k)) & F.exists(F.slice(b, 1, k), lambda x: x != ""), k) for k in range(longest, 0, -1)]
    return F.coalesce(*fits, F.lit(0))


def stitch(strips: Column, longest: int = 6) -> Column:
    """An array of strips as one text, the lines that overlap kept once."""
    def add(acc: Column, strip: Column) -> Column:
        lines = F.split(strip, "\n")
        return F.when(acc == "", strip).otherwise(F.concat_ws("\n", acc, F.array_join(F.slice(lines, overlap(acc, strip, longest) + 1, F.size(lines)), "\n")))

    return F.regexp_replace(F.aggregate(F.filter(strips, lambda s: s.isNotNull() & (s != "")), F.lit(""), add), r"\n+$", "")


# How a reply begins that talks about the sheet instead of reading it.
EXCUSE = "вот текст|на этом листе|этот лист|я не могу|извин|к сожал"
# Signs with which the text of a sheet may end.
CLOSING = ".!?]»\"'-–—:;,"


def reading_flags(text: Column, shortest: int = 60) -> dict[str, Column]:
    """What a reply looks like: empty, declared empty, an excuse, or without a sign at its end though it is long."""
    trimmed = F.trim(text)
    bare = F.regexp_replace(text, r"(?U)\s+$", "")
    return {
        "is_empty": F.coalesce(trimmed == "", F.lit(True)),
        "declared_empty": F.coalesce(trimmed == "[пустой лист]", F.lit(False)),
        "excuse": F.coalesce(text.rlike(rf"(?iu)^\s*(?:{EXCUSE})"), F.lit(False)),
        "open_ended": F.coalesce((F.regexp_count(text, F.lit(r"(?U)\S+")) > shortest) & ~F.contains(F.lit(CLOSING), F.right(bare, F.lit(1))), F.lit(False)),
    }


def usable_reply(text: Column, finish: Column) -> Column:
    """Whether a reply can be kept: it has a text and was not ended by a limit on its length."""
    return F.coalesce(F.trim(text) != "", F.lit(False)) & ~finish.eqNullSafe(F.lit("MAX_TOKENS"))
