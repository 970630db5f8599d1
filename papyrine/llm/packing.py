"""Problem 7: documents packed into containers of fixed capacity with as little unused space as possible.

Only sizes decide a packing, and there are at most ``capacity`` of them. So the documents are added up to a histogram
by size (a partial aggregation; at most ``capacity`` rows reach the driver, whatever the corpus), the histogram is
packed there, and each document finds its container by its rank among the documents of its size.

The packing itself: Martello and Toth's dominance reduction fixes small sets of items that some optimal solution is
known to hold (an item with its exact complement; an item nothing fits beside; an item with the largest partner when
every other set beside it is dominated by that partner), again and again until nothing more can be fixed; best fit in
decreasing order packs what is left. Both work on whole classes of equal items, with counts.

A document larger than the capacity is split into full containers and one rest, which is packed like a document; a
document that fits is never split. Ranks come from a window over (size, salt) plus the sizes of the salts before, with
as many salts as the largest class needs, so a size that a third of all documents share is spread over many tasks.

Results at the edges: documents without tokens (null or empty texts) are in no container; equal rows are items of
their own; an empty table gives an empty packing; ties among equal sizes go by key, then by part.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.tokenizer import with_token_counts
from papyrine.session import cut

CAPACITY = 4096
#: A rank window holds about this many items.
CLASS_ROWS = 200_000


class Packing:
    """Groups of equal containers: (number of containers, [(size, items of it in each)])."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: n for s, n in histogram.items() if n > 0}
        self.groups: list[tuple[int, list[tuple[int, int]]]] = []
        self.reduce()
        self.fixed = sum(n for n, _ in self.groups)
        self.best_fit()

    def _take(self, n: int, *sizes: int) -> None:
        counts: dict[int, int] = {}
        for s in sizes:
            counts[s] = counts.get(s, 0) + 1
        self.groups.append((n, list(counts.items())))
        for s, k in counts.items():
            self.left[s] -= n * k
            if not self.left[s]:
                del self.left[s]
                del self.order[bisect_left(self.order, s)]

    def _partner(self, w: int) -> tuple[int, int] | None:
        """(partner or 0, how many containers to fix), if a set of at most two items with w dominates all others."""
        room, left, order = self.capacity - w, self.left, self.order
        if room == 0:
            return 0, left[w]
        own = left[w] - 1
        k = bisect_left(order, room + 1) - 1
        if k >= 0 and order[k] == w and not own:
            k -= 1
        if k < 0:
            return 0, left[w]
        a = order[k]  # the largest item that fits beside w
        count = left[w] // 2 if a == w else min(left[w], left[a])
        if a == room:
            return a, count
        # the sizes of the smallest items besides w: how many fit at most?
        smallest = []
        for s in order:
            smallest += [s] * min(left[s] - (s == w), 3 - len(smallest))
            if len(smallest) == 3:
                break
        if len(smallest) < 2 or smallest[0] + smallest[1] > room:
            return a, count
        if len(smallest) > 2 and sum(smallest) <= room:
            return None
        # two others may fit: the single partner dominates if it is as large as any such pair
        sizes = np.array(order[: bisect_left(order, room)])
        best = 0
        if len(sizes):
            mate = np.searchsorted(sizes, room - sizes, side="right") - 1
            for s, m in zip(sizes.tolist(), mate.tolist(), strict=True):
                while m >= 0:
                    t = int(sizes[m])
                    need = {s: 1}
                    need[t] = need.get(t, 0) + 1
                    if all(left[x] - (x == w) >= c for x, c in need.items()):
                        best = max(best, s + t)
                        break
                    m -= 1
        return (a, 1) if a >= best else None

    def reduce(self) -> None:
        self.order = sorted(self.left)
        changed = True
        while changed:
            changed = False
            for w in sorted(self.left, reverse=True):
                while w in self.left and (found := self._partner(w)):
                    partner, n = found
                    self._take(n, w, *([partner] if partner else []))
                    changed = True

    def best_fit(self) -> None:
        """Best fit decreasing with classes: ``open`` holds (room, group) in order of room."""
        rows: list[list] = []  # [containers, contents]
        room: list[tuple[int, int]] = []
        for s in sorted(self.left, reverse=True):
            n = self.left[s]
            while n:
                at = bisect_left(room, (s, -1))
                if at == len(room):
                    each = self.capacity // s
                    full, rest = divmod(n, each)
                    for count, k in ((full, each), (1 if rest else 0, rest)):
                        if count:
                            rows.append([count, [(s, k)]])
                            insort(room, (self.capacity - k * s, len(rows) - 1))
                    n = 0
                    break
                free, g = room.pop(at)
                count, contents = rows[g]
                each = free // s
                full, rest = divmod(n, each)
                if full >= count:
                    rows[g][1] = [*contents, (s, each)]
                    insort(room, (free - each * s, g))
                    n -= count * each
                    continue
                # the group splits: ``full`` containers take ``each``, one takes the rest, the others stay
                for c, k in ((full, each), (1 if rest else 0, rest)):
                    if c:
                        rows.append([c, [*contents, (s, k)]])
                        insort(room, (free - k * s, len(rows) - 1))
                rows[g][0] = count - full - (1 if rest else 0)
                if rows[g][0]:
                    insort(room, (free, g))
                n = 0
        self.groups += [(n, contents) for n, contents in rows if n]
        self.left = {}

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(size, first rank, first container, items in each container) by size and rank, and the number of containers."""
        rows, ranks, first = [], {}, 0
        for n, contents in self.groups:
            for s, k in contents:
                rows.append((s, ranks.get(s, 0), first, k))
                ranks[s] = ranks.get(s, 0) + n * k
            first += n
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return (*table.T, first)


def items(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, part, size): a document as it is, or cut into full parts and a rest; documents of size 0 are left out."""
    parts = F.ceil(F.col("tokens") / F.lit(capacity)).cast("int")
    return (
        sizes.filter("tokens > 0")
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select(key, "part", F.least(F.lit(capacity), F.col("tokens") - F.col("part").cast("bigint") * capacity).alias("size"))
    )


def pack(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(key, part, size, container) from (key, tokens): every item's container, numbered from 0 without gaps."""
    all_items = cut(items(sizes, key, capacity))
    histogram = {r["size"]: r["n"] for r in all_items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    size, rank, first, each, containers = Packing(histogram, capacity).segments()
    shift = 44  # size and rank in one number; ranks stay below 2**44
    plan = all_items.sparkSession.sparkContext.broadcast(((size << shift) + rank, first, each))

    salts = max(1, -(-max(histogram.values(), default=0) // CLASS_ROWS))
    salted = all_items.withColumn("salt", F.pmod(F.xxhash64(key, "part"), F.lit(salts)))
    per_salt = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = (
        salted.withColumn("own", F.row_number().over(Window.partitionBy("size", "salt").orderBy(key, "part")))
        .join(per_salt.select("size", "salt", before.alias("before")), ["size", "salt"])
        .select(key, "part", "size", (F.col("own") - 1 + F.col("before")).alias("rank"))
    )

    def place(batches):
        starts, first, each = plan.value
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            code = (at[0] << shift) + at[1]
            k = np.searchsorted(starts, code, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(first[k] + (code - starts[k]) // each[k])], [key, "part", "size", "container"])

    return ranked.mapInArrow(place, f"`{key}` {sizes.schema[key].dataType.simpleString()}, part int, size bigint, container bigint")


def pack_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The documents with at least one token, packed by their sizes in tokens of a public tokenizer."""
    return pack(with_token_counts(documents, key, text, path), key, capacity)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, tokens, the least possible number of containers by volume, and the unused share."""
    return packed.agg(
        F.count("*").alias("items"),
        F.coalesce(F.max("container") + 1, F.lit(0)).alias("containers"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"),
    ).select(
        "items",
        "containers",
        "tokens",
        F.ceil(F.col("tokens") / capacity).alias("least"),
        F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).otherwise(0.0).alias("unused"),
    )
