"""Similarity of token sequences: native bounds by multiset, longest common runs, exact ratios in Arrow batches.

Pairs come from an equi-join on a key (two readings of a path, for instance); pairs across keys are never formed.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pairs(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """(key, a_<c>, b_<c>) of all rows a before b (by ``order``) with an equal, non-null key."""
    kept = df.filter(F.col(key).isNotNull()).select(key, order, *columns)
    a, b = (kept.select(key, *(F.col(c).alias(f"{s}_{c}") for c in (order, *columns))) for s in "ab")
    return a.join(b, key).filter(F.col(f"a_{order}") < F.col(f"b_{order}"))


def real_quick_ratio(a: Column, b: Column) -> Column:
    """The bound by lengths alone: 2 min / (sum); 1 for two empty sequences."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.size(a), F.size(b)) / total)


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays, inside the row."""
    counts = F.transform(F.array(F.array_sort(a)), lambda s: F.aggregate(F.array_distinct(b), F.lit(0), lambda acc, w: acc + F.least(F.size(F.filter(s, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w)))))
    return counts[0]


def quick_ratio(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """``df`` with ``common`` and ``bound`` = 2 common / (sum of lengths), an upper bound of the exact ratio.

    Tokens of both sides are counted per pair and added up; only tokens of a pair's own two sequences meet.
    """
    def counted(side: str) -> DataFrame:
        return df.select(*key, F.explode(side).alias("w")).groupBy(*key, "w").agg(F.count("*").alias(f"n_{side}"))

    common = counted(a).join(counted(b), [*key, "w"]).groupBy(*key).agg(F.sum(F.least(f"n_{a}", f"n_{b}")).alias("common"))
    total = F.size(a) + F.size(b)
    return df.join(common, key, "left").withColumn("common", F.coalesce("common", F.lit(0).cast("bigint"))).withColumn("bound", F.when(total == 0, 1.0).otherwise(2.0 * F.col("common") / total))


def longest_run(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, run): the longest common contiguous run of tokens; positions join on their token, islands on the diagonal."""
    pa = df.select(*key, F.posexplode(a).alias("i", "w"))
    pb = df.select(*key, F.posexplode(b).alias("j", "w"))
    diagonal = pa.join(pb, [*key, "w"]).select(*key, "i", (F.col("i") - F.col("j")).alias("d"))
    w = Window.partitionBy(*key, "d").orderBy("i")
    runs = diagonal.withColumn("island", F.col("i") - F.row_number().over(w)).groupBy(*key, "d", "island").agg(F.count("*").alias("n"))
    return df.select(*key).join(runs.groupBy(*key).agg(F.max("n").alias("run")), key, "left").withColumn("run", F.coalesce("run", F.lit(0).cast("bigint")))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact Ratcliff-Obershelp ratio of two token arrays (order of the sides matters); null if one is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, list(x), list(y), False).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


_EDIT = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("i1", "i2", "j1", "j2"))]))


@F.pandas_udf(_EDIT)
def edit_script(a: pd.Series, b: pd.Series) -> pd.Series:
    """Opcodes that turn one token array into the other, equal stretches included."""
    return pd.Series([None if x is None or y is None else [dict(zip(("tag", "i1", "i2", "j1", "j2"), o, strict=True)) for o in SequenceMatcher(None, list(x), list(y), False).get_opcodes()] for x, y in zip(a, b, strict=True)], dtype=object)


def differing_runs(script: Column, least: int = 25) -> Column:
    """The changed stretches of an edit script of at least ``least`` tokens on either side."""
    return F.filter(script, lambda o: (o["tag"] != "equal") & (F.greatest(o["i2"] - o["i1"], o["j2"] - o["j1"]) >= least))


_BLOCK = T.StructType([T.StructField("block_ratio", T.DoubleType()), T.StructField("length_ratio", T.DoubleType())])


def _block(x: list, y: list) -> tuple[float, float]:
    short, long = sorted((x, y), key=len)
    if not short:
        return 0.0, 0.0
    m = SequenceMatcher(None, short, long, False).find_longest_match()
    share = len(short) / len(long)
    if not m.size:
        return 0.0, share
    at = min(max(0, m.b - m.a), len(long) - len(short))
    return SequenceMatcher(None, short, long[at : at + len(short)], False).ratio(), share


@F.pandas_udf(_BLOCK)
def best_block(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The shorter sequence against the window of its length in the longer one, placed at the longest verbatim match.

    (0, length ratio) without any match, (0, 0) if one side is empty.
    """
    rows = [_block(list(x if x is not None else []), list(y if y is not None else [])) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=["block_ratio", "length_ratio"])


@F.pandas_udf(T.StructType([*_BLOCK.fields, T.StructField("words_a", T.IntegerType()), T.StructField("words_b", T.IntegerType())]))
def best_block_of_words(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """``best_block`` of the words that spaces divide two texts into, and how many each has (null for no text). A batch
    holds whole texts; words are made for one pair at a time."""
    rows = []
    for pair in zip(a, b, strict=True):
        x, y = ([w for w in (t or "").split(" ") if w] for t in pair)
        rows.append((*_block(x, y), *(None if t is None else len(w) for t, w in zip(pair, (x, y), strict=True))))
    return pd.DataFrame(rows, columns=["block_ratio", "length_ratio", "words_a", "words_b"]).astype({"words_a": "Int32", "words_b": "Int32"})


def _window(needle, hay) -> tuple[int, float] | None:
    x, y = list(needle if needle is not None else []), list(hay if hay is not None else [])
    n = len(x)
    if n < 20 or len(y) < n:
        return None
    step = max(1, n // 6)
    score = lambda k, f: getattr(SequenceMatcher(None, x, y[k : k + n], False), f)()
    start = max(range(0, len(y) - n + 1, step), key=lambda k: (score(k, "quick_ratio"), -k))
    near = range(max(0, start - step), min(len(y) - n, start + step) + 1, max(1, step // 8))
    ratio_, at = max((score(k, "ratio"), -k) for k in near)
    return -at, ratio_


@F.pandas_udf(T.DoubleType())
def best_window(needle: pd.Series, hay: pd.Series) -> pd.Series:
    """The best ratio of a sequence with a window of its length: coarse steps by the multiset bound, then fine ones by the
    exact ratio around the best. Null for fewer than 20 tokens or a shorter hay."""
    return pd.Series([None if (at := _window(x, y)) is None else at[1] for x, y in zip(needle, hay, strict=True)], dtype=float)


def best_in_blocks(queries: DataFrame, rows: DataFrame, key: list[str], name: str, tokens: str, least: float = 0.25, exact: bool = True, block: int = 256) -> DataFrame:
    """(key, a_id, b_id, ratio, common): for each query the row of its key with the largest ratio of at least ``least``;
    of equal ones the first by ``name``. ``exact`` false ranks by the multiset bound itself.

    Both sides of a key are divided into blocks by a hash of their names, so that a key with a third of all rows is
    many small tasks; a task holds one block of queries and one of rows, and returns one row for each query. Within it
    the bound is worked out for all rows at once, and exact ratios in falling order of bounds until no bound reaches the
    best ratio. Rows of a null key, name or token array take no part. ``tokens`` may be a string, a sequence of letters.
    """
    if not key:
        found = best_in_blocks(queries.withColumn("__all", F.lit(0)), rows.withColumn("__all", F.lit(0)), ["__all"], name, tokens, least, exact, block)
        return found.drop("__all")
    kind = dict(rows.dtypes)
    q = queries.select(*key, F.col(name).alias("a_id"), F.col(tokens).alias("a")).dropna()
    r = rows.select(*key, F.col(name).alias("b_id"), F.col(tokens).alias("b")).dropna()
    sizes = q.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("__q")).join(r.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("__r")), key)
    part = lambda column, n: F.pmod(F.xxhash64(column), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1))
    left = q.join(sizes, key).select(*key, "a_id", "a", part("a_id", "__q").alias("__x"), every("__r").alias("__y"))
    right = r.join(sizes, key).select(*key, "b_id", "b", part("b_id", "__r").alias("__y"), every("__q").alias("__x"))
    group = [*key, "__x", "__y"]

    def search(keys: tuple, ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        columns = [*key, "a_id", "b_id", "ratio", "common"]
        if ours.empty or theirs.empty:
            return pd.DataFrame(columns=columns)
        theirs = theirs.sort_values("b_id").reset_index(drop=True)
        others = theirs["b"].tolist()
        lengths = np.array([len(x) for x in others])
        index: dict[str, tuple[list[int], list[int]]] = {}
        for k, words in enumerate(others):
            for w, n in Counter(words).items():
                where, counts = index.setdefault(w, ([], []))
                where.append(k)
                counts.append(n)
        arrays = {w: (np.array(a), np.array(b)) for w, (a, b) in index.items()}
        out = []
        for a_id, words in zip(ours["a_id"], ours["a"], strict=True):
            words = list(words)
            common = np.zeros(len(theirs), np.int64)
            for w, n in Counter(words).items():
                if w in arrays:
                    common[arrays[w][0]] += np.minimum(arrays[w][1], n)
            total = lengths + len(words)
            bound = np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)
            best, at = -1.0, -1
            near = np.flatnonzero(bound >= least)
            for k in near[np.argsort(-bound[near], kind="stable")].tolist():
                if bound[k] < best:
                    break
                value = SequenceMatcher(None, words, list(others[k]), False).ratio() if exact else float(bound[k])
                if value > best or (value == best and k < at):
                    best, at = value, k
                if not exact:
                    break
            if at >= 0 and best >= least:
                out.append((*keys[: len(key)], a_id, theirs["b_id"][at], best, int(common[at])))
        return pd.DataFrame(out, columns=columns)

    types = dict(q.dtypes) | {"b_id": kind[name], "ratio": "double", "common": "bigint"}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*key, "a_id", "b_id", "ratio", "common"])
    right = right.toDF(*right.columns)  # both sides may come from one table
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(search, schema)
    first = F.min(F.struct((-F.col("ratio")).alias("r"), F.col("b_id").alias("b_id"), F.col("common").alias("common"))).alias("x")
    return found.groupBy(*key, "a_id").agg(first).select(*key, "a_id", F.col("x.b_id").alias("b_id"), (-F.col("x.r")).alias("ratio"), F.col("x.common").alias("common"))


@F.pandas_udf(T.LongType())
def run_in_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest matching block of two token arrays; null if one is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, list(x), list(y), False).find_longest_match().size for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def window_of(needle: pd.Series, hay: pd.Series) -> pd.Series:
    """The stretch of ``hay`` that ``best_window`` finds; null where that is null."""
    return pd.Series([None if (at := _window(x, y)) is None else list(y[at[0] : at[0] + len(x)]) for x, y in zip(needle, hay, strict=True)], dtype=object)


def observed_similarity(script: Column, a: Column, b: Column) -> Column:
    """Tokens in the equal stretches of an edit script for each token of the longer side; null for two empty sides."""
    equal = F.aggregate(F.filter(script, lambda o: o["tag"] == "equal"), F.lit(0), lambda n, o: n + o["i2"] - o["i1"])
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer > 0, equal / longer)


def collation(script: Column, a: Column, b: Column, least: int = 25, clip: int = 1500) -> Column:
    """The differing stretches of at least ``least`` tokens, the longest first, as (kind, words, first, second): only in
    the first or the second text, or rewritten; texts are clipped for display at ``clip`` characters."""
    said = lambda t, i, j: F.substring(F.array_join(F.slice(t, i + 1, j - i), " "), 1, clip)
    named = F.transform(differing_runs(script, least), lambda o: F.struct(
        (-F.greatest(o["i2"] - o["i1"], o["j2"] - o["j1"])).alias("order"), o["i1"].alias("i1"),
        F.when(o["tag"] == "delete", "only_a").when(o["tag"] == "insert", "only_b").otherwise("replace").alias("kind"),
        said(a, o["i1"], o["i2"]).alias("first"), said(b, o["j1"], o["j2"]).alias("second"),
    ))
    return F.transform(F.array_sort(named), lambda x: F.struct(x["kind"].alias("kind"), (-x["order"]).alias("words"), x["first"].alias("first"), x["second"].alias("second")))
