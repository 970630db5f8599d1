"""Inverted full-text index: terms, stop terms, postings by shard, prefix search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import index_terms
from papyrine.session import cut

#: Terms in more than this share of all documents are left out.
STOP_SHARE = 0.25


def document_terms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term), distinct. Made distinct inside the row, so nothing is shuffled."""
    return documents.select(key, F.explode(F.array_distinct(index_terms(F.col(text)))).alias("term"))


def document_frequencies(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df) of all terms; added up in each task before the shuffle."""
    return document_terms(documents, key, text).groupBy("term").agg(F.count("*").alias("df"))


def split_stop_terms(documents: DataFrame, key: str = "doc_id", text: str = "text", stop_share: float = STOP_SHARE) -> tuple[DataFrame, DataFrame]:
    """(kept terms, stop terms), each (term, df)."""
    frequencies = document_frequencies(documents, key, text)
    counted = frequencies.join(documents.agg(F.count("*").alias("total")))  # one row beside each term
    stop = F.col("df") > F.col("total") * stop_share
    return counted.filter(~stop).select("term", "df"), counted.filter(stop).select("term", "df")


def postings(documents: DataFrame, key: str = "doc_id", text: str = "text", stop_share: float = STOP_SHARE, block: int = 100_000) -> DataFrame:
    """(shard, term, df, block, docs): the sorted documents of each kept term; the shard is the code point of its first
    letter. A list holds the documents of one block of ids, so no list grows with the corpus. Texts are read once: each
    document's terms are written beside its id, so stop terms are known before anything is shuffled."""
    terms = cut(documents.select(key, F.array_distinct(index_terms(F.col(text))).alias("terms")))
    rows = terms.select(key, F.explode("terms").alias("term"))
    stop = F.col("df") > F.col("total") * stop_share
    kept = rows.groupBy("term").agg(F.count("*").alias("df")).join(terms.agg(F.count("*").alias("total"))).filter(~stop).select("term", "df")
    lists = rows.join(kept, "term").withColumn("block", F.floor(F.col(key) / block)).groupBy("term", "df", "block").agg(F.sort_array(F.collect_list(key)).alias("docs"))
    return lists.select(F.ascii("term").alias("shard"), "term", "df", "block", "docs")


def write_index(documents: DataFrame, path: str, **options) -> None:
    """The index as files partitioned by shard, so that a prefix query reads one shard."""
    postings(documents, **options).write.mode("overwrite").partitionBy("shard").parquet(path)


def prefix_search(index: DataFrame, prefix: str, key: str = "doc_id") -> DataFrame:
    """Documents of the terms that begin with a prefix; the predicate on the shard prunes partitions."""
    hits = index.filter((F.col("shard") == ord(prefix[0])) & F.startswith("term", F.lit(prefix)))
    return hits.select(F.explode("docs").alias(key)).distinct()
