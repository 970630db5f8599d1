import random
from collections import Counter

from papyrine.llm import packing


def containers(items, capacity):
    """The packing of a list of sizes, checked to be one."""
    found = packing.Packing(dict(Counter(items)), capacity)
    placed = Counter()
    for n, contents in found.groups:
        assert n > 0 and sum(s * k for s, k in contents) <= capacity
        for s, k in contents:
            placed[s] += n * k
    assert placed == Counter(items)
    return sum(n for n, _ in found.groups)


def optimum(items, capacity):
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        tried = set()
        for j, b in enumerate(bins):
            if b + items[i] <= capacity and b not in tried:
                tried.add(b)
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
        place(i + 1, [*bins, items[i]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best


def test_near_the_optimum():
    random.seed(1)
    over = 0
    for _ in range(400):
        capacity = random.choice([10, 15, 20])
        items = [random.randint(1, capacity) for _ in range(random.randint(0, 10))]
        over += containers(items, capacity) - optimum(items, capacity)
    assert 0 <= over <= 4


def test_classes_of_equal_items():
    assert containers([50] * 999, 100) == 500 and containers([40] * 7 + [60] * 7, 100) == 7
    assert containers([34] * 10, 100) == 5 and containers([], 100) == 0 and containers([100] * 3, 100) == 3


def test_frame(spark):
    sizes = [(i, n, "x") for i, n in enumerate([0, 1, 25, 7, 7, 7, 10, 3, 3, 9, 1, 1])]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint, size string")
    packing_of = packing.pack(df.select("doc_id", "tokens"), capacity=10).collect()
    fill, parts = Counter(), Counter()
    for r in packing_of:
        fill[r.container] += r["size"]
        parts[r.doc_id] += r["size"]
    assert max(fill.values()) <= 10 and sorted(fill) == list(range(len(fill)))
    assert parts == Counter({i: n for i, n, _ in sizes if n}) and len(packing_of) == 13
    assert sum(1 for r in packing_of if r.doc_id == 2) == 3  # only the one that is larger than a container is split
    assert packing.pack(df.limit(0), capacity=10).count() == 0
    assert packing.fill(packing.pack(df, capacity=10), 10).first().least == 8


def test_hot_size_is_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "CLASS_ROWS", 100)
    df = spark.range(2000).selectExpr("id as doc_id", "if(id % 3 = 0, 6L, 4L) as tokens")
    got = packing.pack(df, capacity=10).groupBy("container").sum("size").collect()
    assert all(r[1] <= 10 for r in got) and len(got) == -(-(667 * 6 + 1333 * 4 - 667 * 10) // 8) + 667


def test_documents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "один два"), (3, "один два"), (4, "x " * 9000)], "doc_id bigint, text string")
    got = packing.pack_documents(df).collect()
    assert Counter(r.doc_id for r in got)[3] == 2 and {r.doc_id for r in got} == {3, 4} and max(r["size"] for r in got) == packing.CAPACITY
