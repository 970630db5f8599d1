"""Work queues: batches, tries, replies, completion."""

from pyspark.sql import functions as F

from papyrine.operators import queue

ITEMS = [(0, "1", "01", "p0", "m", "done"), (1, "1", "01", "p1", "m", "pending"), (2, "1", "01", "p2", "k", "pending"), (3, "1", "01", "p3", "m", "pending"), (4, "1", "02", "p4", "m", "pending"), (5, "1", "01", "p5", "m", "pending"), (6, None, None, "p6", None, "pending")]
SCHEMA = "ord bigint, opis_code string, delo string, path string, model string, status string"


def test_batches(spark):
    q = spark.createDataFrame(ITEMS, SCHEMA)
    got = {r.ord: r.batch for r in queue.batches_of_queue(q, 2).collect()}
    assert got == {1: 1, 3: 1, 2: 2, 4: 4, 5: 5, 6: 6}
    assert [r.ord for r in queue.next_batch(q, 4).collect()] == [1, 3] and [r.ord for r in queue.next_batch(q, 1).collect()] == [1]
    assert queue.next_batch(q.filter("status = 'done'"), 4).count() == queue.batches_of_queue(q.limit(0), 4).count() == 0
    assert [r.ord for r in queue.next_batch(q.filter("ord = 6"), 4).collect()] == [6]


def test_states(spark):
    log = spark.createDataFrame([("a", 1, False, "x"), ("a", 2, None, "y"), ("a", 3, False, "z"), ("b", 1, False, "x"), ("b", 2, True, None), ("c", 1, False, None)], "k string, at int, ok boolean, why string")
    got = {r.k: (r.attempts, r.last_reason, r.status) for r in queue.states(log, "k", F.col("at"), F.col("ok"), "why").collect()}
    assert got == {"a": (3, "z", "refused"), "b": (1, "x", "done"), "c": (1, None, "failed")}


def test_replies(spark, rows):
    q = spark.createDataFrame(ITEMS, SCHEMA)
    replies = spark.createDataFrame([("1", "x"), ("99", "y"), ("no", "z"), (None, "w")], "key string, reply string")
    assert rows(queue.put_back(q, replies).select("ord", "reply")) == [(1, "x")]
    pages = spark.createDataFrame([(1, "001.jpg"), (1, "002.jpg"), (2, "001.jpg"), (3, "009.jpg"), (4, "001.jpg")], "batch int, page string")
    parts = spark.createDataFrame([(1, "data/001.jpg", 2, "late"), (1, "001.jpg", 1, "first"), (2, "reply", 1, "only"), (3, "a", 1, "x"), (3, "b", 2, "y")], "batch int, name string, place int, body string")
    assert rows(queue.by_name(pages, parts)) == [(1, "001.jpg", "first"), (1, "002.jpg", None), (2, "001.jpg", "only"), (3, "009.jpg", None), (4, "001.jpg", None)]


def test_classes_completion_and_jobs(spark, rows):
    q = spark.createDataFrame(ITEMS, SCHEMA)
    classes = spark.createDataFrame([("p1", "typed"), ("p1", "typed"), ("zz", "note")], "path string, class string")
    got = {r.path: r.class_now for r in queue.reclassified(q.withColumn("class", F.lit("hand")), classes).collect()}
    assert len(got) == 7 and got["p1"] == "typed" and got["p2"] == "hand"
    done = {r.delo: (r["items"], r.percent, r.next) for r in queue.completion(q, ["delo"], "ord").collect()}
    assert done["01"] == (5, 20.0, 1) and done["02"] == (1, 0.0, 4)
    jobs = spark.createDataFrame([([1, 2], "open"), ([2, 3], None), ([4], "collected"), (None, "open")], "keys array<bigint>, state string")
    assert rows(queue.busy(jobs)) == [(1,), (2,), (3,)]
    places = spark.createDataFrame([("a", "2", 1), ("a", "1", 2), ("a", "1", 3), ("b", "9", 4)], "d string, o string, n int")
    assert rows(queue.first_place(places, ["d"], "o", ["1", "2"])) == [("a", "1", 2), ("a", "1", 3)]


def test_passes(spark, rows):
    todo = spark.createDataFrame([(1, 0, "partial"), (2, 7, "ok"), (3, -20, None)], "k int, n int, status string")
    attempt = lambda df: df.select("k", (F.col("n") + 1).alias("n"), F.when(F.col("n") + 1 >= 2, "ok").otherwise("partial").alias("status"))
    assert rows(queue.in_passes(todo, attempt, ["k"])) == [(1, 2, "ok"), (2, 7, "ok"), (3, -12, "partial")]
