"""Operators on ordered rows: runs, streaks, samples, batches, prefixes, latest states. All as windows or islands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.session import cut


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """``df`` with the running total of each of ``values`` (name: value) within each key, by ``order`` (which must tell all
    rows apart).

    Rows are range-partitioned by (keys, order), so a key with a third of all rows is spread over many tasks; each task
    adds up its own part, and the totals of the parts before (one row for each part of a key) are added after that.
    """
    names = list(values)
    ordered = df.withColumns({f"__v{i}": values[n] for i, n in enumerate(names)}).repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id())
    ordered = cut(ordered)  # both uses below must see the same parts
    own = Window.partitionBy("__p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("__p", *keys).agg(*(F.sum(f"__v{i}").alias(f"__t{i}") for i in range(len(names))))
    before = [F.coalesce(F.sum(f"__t{i}").over(earlier), F.lit(0)).alias(f"__b{i}") for i in range(len(names))]
    totals = totals.select(F.col("__p").alias("__q"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *before)
    same = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    added = ordered.withColumns({f"__o{i}": F.sum(f"__v{i}").over(own) for i in range(len(names))}).join(totals, same)
    helpers = [f"__{c}{i}" for i in range(len(names)) for c in "vob"] + [f"__k{i}" for i in range(len(keys))]
    return added.withColumns({n: F.col(f"__o{i}") + F.col(f"__b{i}") for i, n in enumerate(names)}).drop("__p", "__q", *helpers)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``running_totals`` of one value."""
    return running_totals(df, keys, order, {name: value})


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """``df`` with each row's place in its key, from 1, by ``order`` (which must tell all rows apart)."""
    return running(df, keys, order, F.lit(1).cast("bigint"), name)


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the first by ``order`` (give ties an order too)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__row_number", F.row_number().over(w)).filter("__row_number = 1").drop("__row_number")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in the place of those of the same key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def replace_by_label(old: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """``old`` without the labels that ``new`` has, then ``new``."""
    return upsert(old, new, [label])


def fold_runs(text: Column, least: int = 3) -> Column:
    """A text whose runs of ``least`` and more equal lines are one line and a marker; blank lines never fold.

    Works inside the row, in time proportional to its lines: no shuffle, whatever the length of a text or its runs.
    """
    bound = lambda c, f: F.transform(F.array(c), f)[0]  # noqa: E731  (evaluates ``c`` once)
    at = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    marker = lambda n: F.format_string("[повтор свёрнут: та же строка ещё %d раз]", n)

    def shown(lines: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.trim(at(lines, i)) == "") | (at(lines, i) != F.when(i > 0, at(lines, i - 1))))

        def run(s: Column, i: Column, k: Column) -> Column:
            n = F.when(k < F.size(s) - 1, at(s, k + 1)).otherwise(F.size(lines)) - i
            return F.when(n >= least, F.array(at(lines, i), marker(n - 1))).otherwise(F.array_repeat(at(lines, i), n.cast("int")))

        return bound(starts, lambda s: F.flatten(F.transform(s, lambda i, k: run(s, i, k))))

    return F.array_join(bound(F.split(text, "\n", -1), shown), "\n")


def line_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, line, n): runs of equal lines by gaps and islands; blank lines are runs of their own."""
    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    before = F.lag("line").over(w)
    starts = lines.withColumn("new", F.when(before.isNull() | (before != F.col("line")) | (F.trim("line") == ""), 1).otherwise(0))
    return starts.withColumn("run", F.sum("new").over(w)).groupBy(key, "run").agg(F.min("pos").alias("start"), F.first("line").alias("line"), F.count("*").alias("n")).drop("run")


def streak_stop(df: DataFrame, key: str, order: Sequence[str], hit: Column, k: int) -> DataFrame:
    """Rows of each key before its first streak of ``k`` rows in a row without a hit (a null hit is none). ``order`` must tell
    all rows apart. Places and islands are running totals over range partitions, so a hot key is many tasks."""
    flagged = df.withColumn("_hit", F.coalesce(hit.cast("int"), F.lit(0)))
    placed = running_totals(flagged, [key], order, {"_n": F.lit(1).cast("bigint"), "_island": F.col("_hit")})
    islands = placed.filter("_hit = 0").groupBy(key, "_island").agg(F.count("*").alias("_len"), F.min("_n").alias("_start"))
    stops = islands.filter(F.col("_len") >= k).groupBy(F.col(key).alias("_key")).agg(F.min("_start").alias("_stop"))
    return placed.join(stops, F.col(key).eqNullSafe(F.col("_key")), "left").filter("_stop is null or _n < _stop").drop("_hit", "_n", "_island", "_key", "_stop")


def round_robin(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows when the groups take turns: the first row of each group, then the second, and so on."""
    return numbered(df, [group], [order], "turn").filter(F.col("turn") <= n).orderBy("turn", group, order).limit(n)


def stratified(df: DataFrame, group: str, order: str, bands: Sequence[tuple[str, Column, int]]) -> DataFrame:
    """At most ``quota`` rows of each (name, predicate, quota) band, one of each group, a group in one band only."""
    out, rest = None, df
    columns = [c for c in df.columns if c not in (group, order)]
    for name, predicate, quota in bands:
        # the first row of a group as a partial aggregation, not as a window
        lead = F.min(F.struct(order, *columns)).alias("_x")
        first = rest.filter(predicate).groupBy(group).agg(lead).select(group, "_x.*").orderBy(order).limit(quota).withColumn("band", F.lit(name))
        out = first if out is None else out.unionByName(first)
        rest = rest.join(first.select(group), group, "left_anti")
    return out


def batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Rows numbered into batches of ``size`` within each key, from 0."""
    return numbered(df, keys, order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def prefix_by_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, budget: int) -> DataFrame:
    """The rows of each key up to the first at which the running total passes ``budget``; the first row always stays."""
    return running(df.withColumn("_size", size), keys, order, F.col("_size"), "running").filter((F.col("running") <= budget) | (F.col("running") == F.col("_size"))).drop("_size")


def skip_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Rows of each key after its first ``k``."""
    return numbered(df, keys, order, "_n").filter(F.col("_n") > k).drop("_n")


def half(c: Column) -> Column:
    """0 or 1 by the parity of the last hexadecimal digit of a value's md5: a split that every run and engine repeats."""
    return F.conv(F.right(F.md5(c), F.lit(1)), 16, 10).cast("int") % 2


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded md5 of their key: the same ones on every run and in every engine."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def crawl(start: DataFrame, edges: DataFrame, node: list[str], parent: list[str]) -> DataFrame:
    """The nodes that can be reached from ``start`` over edges (parent columns, node columns), each once, ``start``
    included. Cycles end by themselves: only nodes not seen before go on. Every frontier is written, so the plan of a
    round does not grow and a lost executor costs one round at most; rounds are as many as the longest way."""
    to = edges.select(*(F.col(p).alias(f"__{p}") for p in parent), *node)
    frontier = seen = cut(start.select(*node).distinct())
    while not frontier.isEmpty():
        step = frontier.select(*(F.col(n).alias(f"__{p}") for n, p in zip(node, parent, strict=True)))
        frontier = cut(to.join(step, [f"__{p}" for p in parent]).select(*node).distinct().join(seen, node, "left_anti"))
        seen = seen.unionByName(frontier)
    return seen
