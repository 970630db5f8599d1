"""Statistics of measurements: medians, rank correlation, decision stumps, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.sequence import numbered, running_totals
from papyrine.session import cut


def upper_median(column: str) -> Column:
    """The middle value, of an even number of values the upper one of the two."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def share(condition: Column) -> Column:
    """The share of rows for which a condition holds (null counts as false); null of no rows."""
    return F.try_divide(F.count_if(condition), F.count("*"))


def ranks(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """``df`` with the place of each row by (value, tie) as ``name``, without one task that sorts all rows."""
    return numbered(df, [], [value, tie], name)


def spearman(df: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    """(n, rho) with ties ranked by ``tie``: 1 - 6 sum d^2 / (n (n^2 - 1)); null rho for fewer than two rows. Rows with a
    null measure are left out."""
    ranked = ranks(ranks(df.select(a, b, tie).dropna(), a, tie, "_a"), b, tie, "_b")
    d = (F.col("_a") - F.col("_b")).cast("decimal(20,0)")
    return ranked.agg(F.count("*").alias("n"), F.sum((d * d).cast("decimal(38,0)")).cast("double").alias("d2")).select(
        "n", F.when(F.col("n") > 1, 1 - 6 * F.col("d2") / (F.col("n") * (F.col("n").cast("double") * F.col("n") - 1))).alias("rho")
    )


def stump(df: DataFrame, feature: Column, positive: Column, by: str | None = None) -> DataFrame:
    """The best one-feature threshold of each group: (by, cut, sense, correct, n).

    Values are added up first. Running totals over the distinct values of a group are worked out over range partitions, so a
    continuous feature is many tasks. A cut lies midway between neighbouring values; '>' calls larger values positive.
    Most correct wins, then the smaller cut, then '<' after '>'. Rows with a null feature or class are left out; a group of
    one value has no cut.
    """
    group = F.col(by) if by else F.lit("all")
    rows = df.select(group.alias("by"), feature.alias("v"), positive.cast("int").alias("y")).dropna()
    values = rows.groupBy("by", "v").agg(F.sum("y").alias("p"), F.count("*").alias("c"))
    totals = values.groupBy("by").agg(F.sum("p").alias("p_all"), F.sum("c").alias("n"))
    placed = cut(running_totals(values, ["by"], ["v"], {"p_low": F.col("p"), "c_low": F.col("c"), "k": F.lit(1).cast("bigint")}))
    after = placed.select("by", (F.col("k") - 1).alias("k"), F.col("v").alias("next"))
    cuts = placed.join(after, ["by", "k"]).join(totals, "by")
    above = (F.col("c_low") - F.col("p_low")) + (F.col("p_all") - F.col("p_low"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("less"), above.alias("correct")), F.struct(F.lit(1).alias("less"), (F.col("n") - above).alias("correct"))))
    scored = cuts.select("by", "n", ((F.col("v") + F.col("next")) / 2).alias("cut"), sides.alias("s"))
    best = scored.groupBy("by", "n").agg(F.min(F.struct((-F.col("s.correct")).alias("wrong"), F.col("cut").alias("cut"), F.col("s.less").alias("less"))).alias("b"))
    return best.select("by", F.col("b.cut").alias("cut"), F.when(F.col("b.less") == 1, "<").otherwise(">").alias("sense"), (-F.col("b.wrong")).alias("correct"), "n")


def wins(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, wins_a, wins_b, draws, median_difference) of two paired measures."""
    d = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().withColumn("d", F.col("a") - F.col("b"))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("a") > F.col("b")).alias("wins_a"), F.count_if(F.col("a") < F.col("b")).alias("wins_b"), F.count_if(F.col("a") == F.col("b")).alias("draws"), upper_median("d").alias("median_difference"))


def mix(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Each key's share of rows for which a condition holds, in whole percent, halves to the even number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.bround(F.count_if(condition) * 100 / F.count("*"), 0).cast("int").alias("percent"))


def histogram(df: DataFrame, bucket: Column, value: str | None = None) -> DataFrame:
    """(bucket, n, share and, with ``value``, its sum) of all rows."""
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return df.groupBy(bucket.alias("bucket")).agg(*aggs).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
