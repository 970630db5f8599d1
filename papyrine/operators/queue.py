"""Work queues as tables: batches, attempts, replies put back to their items, completion in passes.

A queue is rows of items with a place (``ord``), a model, a file and a status; replies and failures are rows of a log.
States are worked out from the rows, nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.operators.sequence import numbered, upsert
from papyrine.session import cut

FILE = ["opis_code", "delo"]


def batches_of_queue(queue: DataFrame, size: int) -> DataFrame:
    """The pending items with ``batch``, the place of its first item: items of one model and file that follow one another
    among the model's pending items, at most ``size`` together. Items of other models between them do not matter.

    Places are numbered over range partitions, so a model with a third of all items is many tasks."""
    pending = queue.filter("status = 'pending'")
    placed = numbered(numbered(pending, ["model"], ["ord"], "_m"), ["model", *FILE], ["ord"], "_f")
    island = placed.withColumn("_island", F.col("_m") - F.col("_f"))
    at = numbered(island, ["model", *FILE, "_island"], ["ord"], "_n").withColumn("_k", F.floor((F.col("_n") - 1) / size))
    group = ["model", *FILE, "_island", "_k"]
    first = at.groupBy(*group).agg(F.min("ord").alias("batch")).select(*(F.col(c).alias(f"_of_{c}") for c in group), "batch")
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return at.join(first, same).select(*queue.columns, "batch")


def next_batch(queue: DataFrame, size: int) -> DataFrame:
    """The batch of ``batches_of_queue`` that begins with the first pending item; empty if nothing is pending. Only two
    one-row aggregates are needed, not the whole queue's batches."""
    pending = queue.filter("status = 'pending'")
    first = pending.agg(F.min_by(F.struct("model", *FILE), "ord").alias("x")).select(*(F.col(f"x.{c}").alias(f"_{c}") for c in ("model", *FILE)))
    mine = pending.join(F.broadcast(first), F.col("model").eqNullSafe(F.col("_model")))
    here = F.col(FILE[0]).eqNullSafe(F.col(f"_{FILE[0]}")) & F.col(FILE[1]).eqNullSafe(F.col(f"_{FILE[1]}"))
    stop = mine.filter(~here).agg(F.min("ord").alias("_stop"))
    # the first item is in this file, so the first one of another file ends the batch
    return mine.filter(here).join(F.broadcast(stop)).filter("_stop is null or ord < _stop").orderBy("ord").limit(size).select(*queue.columns)


def states(log: DataFrame, key: str, order: Column, ok: Column, reason: str, most: int = 3) -> DataFrame:
    """(key, attempts, last_reason, status) from a log of tries: done after any success, refused after ``most`` failures,
    else failed. ``last_reason`` is that of the last failure. An aggregation, whatever the number of tries."""
    failed = ~F.coalesce(ok, F.lit(False))
    attempts = F.count_if(failed)
    status = F.when(F.count_if(~failed) > 0, "done").when(attempts >= most, "refused").otherwise("failed")
    return log.groupBy(key).agg(attempts.alias("attempts"), F.max_by(F.when(failed, F.col(reason)), F.when(failed, order)).alias("last_reason"), status.alias("status"))


def put_back(queue: DataFrame, replies: DataFrame, key: str = "key") -> DataFrame:
    """The items with the columns of the reply whose key is their place; replies without an item are left out."""
    numbered_replies = replies.withColumn("ord", F.col(key).try_cast("bigint")).drop(key)
    return queue.join(numbered_replies, "ord")


def reclassified(queue: DataFrame, classes: DataFrame) -> DataFrame:
    """The items with ``class_now``: the class their scan has now, the one they were queued with if it has none."""
    now = classes.select("path", F.col("class").alias("_now")).distinct()
    return queue.join(now, "path", "left").withColumn("class_now", F.coalesce("_now", "class")).drop("_now")


def by_name(pages: DataFrame, parts: DataFrame, batch: str = "batch") -> DataFrame:
    """The pages of each batch with ``body``: that of the first part (by ``place``) whose name holds the page's name; if a
    batch has one page and one part, that part, whatever its name. Null where nothing fits.

    A batch is a single reply to a handful of pages, so what meets in the join is small by construction."""
    named = pages.join(parts.select(batch, "name", "place", "body"), batch, "left")
    sizes = parts.groupBy(batch).agg(F.count("*").alias("_parts")).join(pages.groupBy(batch).agg(F.count("*").alias("_pages")), batch)
    fits = F.contains("name", F.col("page"))
    found = named.groupBy(batch, "page").agg(F.min_by(F.when(fits, F.col("body")), F.when(fits, F.col("place"))).alias("_fit"), F.first("body").alias("_only"))
    alone = (F.col("_parts") == 1) & (F.col("_pages") == 1)
    body = F.when(F.coalesce(F.col("_fit"), F.lit("")) != "", F.col("_fit")).when(alone, F.col("_only")).otherwise(F.col("_fit"))
    return found.join(sizes, batch, "left").select(batch, "page", body.alias("body"))


def completion(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, items, percent, next): the share of done items, and the first pending one."""
    pending = F.col("status") == "pending"
    return df.groupBy(*keys).agg(F.count("*").alias("items"), (F.avg((F.col("status") == "done").cast("int")) * 100).alias("percent"), F.min(F.when(pending, F.col(order))).alias("next"))


def busy(jobs: DataFrame, keys: str = "keys") -> DataFrame:
    """(ord) of the items in jobs that are not collected yet, each once."""
    return jobs.filter("state is distinct from 'collected'").select(F.explode(keys).alias("ord")).distinct()


def first_place(df: DataFrame, keys: Sequence[str], place: str, order: Sequence[str]) -> DataFrame:
    """For each key the rows of the first place of ``order`` in which it is found; other places do not count."""
    rank = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(place))
    ranked = df.withColumn("_rank", rank).filter("_rank > 0")
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [*keys, "_rank"]).select(*df.columns)


def in_passes(todo: DataFrame, attempt: Callable[[DataFrame], DataFrame], keys: list[str], passes: int = 8) -> DataFrame:
    """The rows after at most ``passes`` passes: each gives the rows that are not ok to ``attempt`` and takes what it
    returns in their place. Every pass is written, so that a lost executor costs one pass at most. It ends once all rows
    are ok."""
    rows = cut(todo)
    for _ in range(passes):
        open_rows = rows.filter("status is null or status <> 'ok'")
        if open_rows.isEmpty():
            break
        rows = cut(upsert(rows, attempt(open_rows), keys))
    return rows
