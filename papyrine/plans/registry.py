"""The registry of named queries and of the SQL that gives the same rows, and tables that several queries begin with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import sequence
from papyrine.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# White space as Java's Unicode-aware \s has it, for engines whose \s is ASCII.
WS = r"\x{9}-\x{d} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
COUNT_WORDS = f"len(regexp_extract_all(text, '[^{WS}]+'))"
#: The last state of every card.
CARDS = "c as (select * from (select *, row_number() over (partition by portal_id order by fetched_at desc, pages desc nulls last, status) k from catalog) where k = 1)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def distinct(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return table(spark, sf, name, *columns).distinct()


def cards(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.latest(table(spark, sf, "catalog"), ["portal_id"], F.desc("fetched_at"), F.col("pages").desc_nulls_last(), F.col("status"))
