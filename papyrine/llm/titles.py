"""Running titles in wordings of their own, gathered for each file from lines that recur at the edges of its sheets.

``sheets.is_title`` knows a title by its wording or its setting. A title in any other wording shows only in that the same
line stands at the top or the bottom of many sheets of one file. The edges are taken with built-ins, where the texts
are; what is shuffled is a number for each of the few short lines that may be titles, once for each page.

Results at the edges: rows without a file, page or text give nothing; rows delivered twice count once, because pages
are counted; a file with fewer than ``PAGES`` pages has no titles of this kind.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.sheets import is_title, skeleton
from papyrine.session import cut, join_small

FILE = ("opis_code", "delo")
SCHEMA = "opis_code string, delo string, titles array<string>"
#: A title stands on this many pages of its file at least, and on this share of them: at the top, or at the bottom, where
#: signatures recur as well.
PAGES, TOP, BOTTOM = 3, 0.2, 0.6
#: How many lines from either edge are looked at; of these, the first with a word in it.
EDGE = 3
#: A line that may be a title: short, begins with a capital or a number, no sentence, table row, mark, signature or date.
_MAY_BE = r"^(?=.{6,100}$)[\W\d]*\p{Lu}[^|\[\]«»]*[^.!?…,;:|\[\]\-‐‑¬=]$"
# signatures, dates, totals; titles that show themselves by wording or setting
_IS_ELSE = r"(?iu:д[eе]л[oо0]\s|вып\.|ч[aа][cс]ть\s+[ivx])|^\P{Ll}+$|^\W*(?:\p{L} +){4,}|^\p{L}\.\s*(?:\p{L}\.\s*)?\p{Lu}\S*$|\d{1,2}\s+\p{L}+\s+1[5-9]\d\d|^(?i:итого|всего|total|summe|somme)\b"


def running_titles(readings: DataFrame) -> DataFrame:
    """(opis_code, delo, titles): skeletons of titles that ``sheets.is_title`` does not know by itself."""
    # only the ends of a text are split into lines
    top, bottom = (F.get(F.filter(F.split(F.substring_index("text", "\n", k), "\n"), lambda x: x.rlike(r"\p{L}{3}")), F.lit(0)) for k in (EDGE, -EDGE))
    rows = (
        readings.filter("contains(text, '\n') and page is not null and opis_code is not null and delo is not null")
        .select(*FILE, "page", top.alias("top"), bottom.alias("bottom"))
        .select(*FILE, "page", F.expr("stack(2, top, 'top', bottom, 'bottom') as (line, place)"))
        .withColumn("line", F.trim("line"))
        .filter(F.col("line").rlike(_MAY_BE) & ~F.col("line").rlike(_IS_ELSE))
    )
    rows = rows.withColumn("letters", F.lower(F.regexp_replace("line", r"\P{L}", ""))).filter("length(letters) >= 5").withColumn("code", F.xxhash64("letters"))
    # first only codes of lines are counted; mostly none recurs, and nothing more is read
    group = [*FILE, "code", "place"]
    recurring = cut(rows.select(*group, "page").distinct().groupBy(*group).agg(F.count("*").alias("n")).filter(F.col("n") >= PAGES))
    if recurring.isEmpty():
        return readings.sparkSession.createDataFrame([], SCHEMA)
    pages = join_small(readings.select(*FILE, "page"), recurring.select(*FILE).distinct(), list(FILE), "left_semi").distinct().groupBy(*FILE).agg(F.count("page").alias("pages"))
    often = recurring.join(pages, list(FILE)).filter(F.col("n") >= F.col("pages") * F.when(F.col("place") == "top", TOP).otherwise(BOTTOM)).select(*group)
    kept = join_small(rows.select(*group, "line"), cut(often), group, "left_semi").groupBy(*group).agg(F.min("line").alias("line")).select(*FILE, "line")

    def unknown(batches):
        for batch in batches:
            codes = [[skeleton(x)] if not is_title([x], 0) else [] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.list_(pa.string()))], [*FILE, "titles"])

    return kept.mapInArrow(unknown, SCHEMA).filter("size(titles) > 0").groupBy(*FILE).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("titles")))).alias("titles"))


def with_titles(readings: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the readings and ``titles``, the running titles of their file (null where it has none).

    Frames without the columns of a file have none. The titles are shared with all tasks below a size check only."""
    if not set(FILE) <= set(readings.columns):
        return readings.select(*columns, F.lit(None).cast("array<string>").alias("titles"))
    readings = readings.withColumns({c: F.col(c).cast("string") for c in FILE})
    found = cut(running_titles(readings))
    return join_small(readings.select(*FILE, *columns), found, list(FILE)).select(*columns, "titles")
