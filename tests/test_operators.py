import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from papyrine.operators import corpus, index, raster, sequence, similarity, stats


def test_fold_runs(spark):
    source = "a\nx\nx\nx\nx\n\n\n\nb\nb"
    df = spark.createDataFrame([(source,), ("",), ("q",), (None,)], "t string")
    got = [r[0] for r in df.select(sequence.fold_runs(F.col("t"))).collect()]
    assert got == ["a\nx\n[повтор свёрнут: та же строка ещё 3 раз]\n\n\n\nb\nb", "", "q", None]
    again = spark.createDataFrame([(got[0],)], "t string").select(sequence.fold_runs(F.col("t"))).first()[0]
    assert again == got[0]
    runs = sequence.line_runs(spark.createDataFrame([(1, source)], "k int, t string"), "k", "t")
    assert [(r.line, r.n) for r in runs.orderBy("start").collect()] == [("a", 1), ("x", 4), ("", 1), ("", 1), ("", 1), ("b", 2)]


def test_running_and_numbered_with_a_hot_key(spark):
    random.seed(2)
    data = [(i, "hot" if i % 3 else (None if i % 7 == 0 else str(i % 5)), random.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, k string, v int").repartition(7)
    got = {r.id: (r.total, r.n) for r in sequence.numbered(sequence.running(df, ["k"], ["id"], F.col("v"), "total"), ["k"], ["id"]).collect()}
    total, count, want = Counter(), Counter(), {}
    for i, k, v in data:
        total[k] += v
        count[k] += 1
        want[i] = (total[k], count[k])
    assert got == want


def test_streaks_samples_and_prefixes(spark, rows):
    df = spark.createDataFrame([("u", i, int(i in (1, 2, 5, 6, 10))) for i in range(1, 15)], "u string, i int, hit int")
    assert [r.i for r in sequence.streak_stop(df, "u", ["i"], F.col("hit") == 1, 3).orderBy("i").collect()] == list(range(1, 7))
    g = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 3)], "g string, o int")
    assert [(r.g, r.o) for r in sequence.round_robin(g, "g", "o", 4).collect()] == [("a", 1), ("b", 1), ("c", 1), ("a", 2)]
    s = spark.createDataFrame([("k", i, n) for i, n in enumerate([4, 5, 3, 1])], "k string, i int, n int")
    assert [r.i for r in sequence.prefix_by_budget(s, ["k"], ["i"], F.col("n"), 10).orderBy("i").collect()] == [0, 1]
    assert sequence.skip_first(s, ["k"], ["i"], 2).count() == 2
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert rows(sequence.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]


def test_similarity_against_the_standard_library(spark):
    random.seed(5)
    data = [(i, [random.choice("abcde") for _ in range(random.randrange(0, 14))], [random.choice("abcde") for _ in range(random.randrange(0, 14))]) for i in range(60)]
    df = spark.createDataFrame(data, "k int, a array<string>, b array<string>")
    exact = {r.k: r.x for r in df.select("k", similarity.ratio("a", "b").alias("x")).collect()}
    bound = {r.k: r.bound for r in similarity.quick_ratio(df, ["k"], "a", "b").collect()}
    inner = {r.k: r.x for r in df.select("k", similarity.common_tokens(F.col("a"), F.col("b")).alias("x")).collect()}
    run = {r.k: r.run for r in similarity.longest_run(df, ["k"], "a", "b").collect()}
    script = {r.k: r.x for r in df.select("k", similarity.edit_script("a", "b").alias("x")).collect()}
    for k, a, b in data:
        m = SequenceMatcher(None, a, b, False)
        assert abs(exact[k] - m.ratio()) < 1e-12 and abs(bound[k] - m.quick_ratio()) < 1e-12 and exact[k] <= bound[k] + 1e-12
        assert run[k] == m.find_longest_match().size and inner[k] == sum((Counter(a) & Counter(b)).values())
        assert [tuple(o) for o in script[k]] == m.get_opcodes()


def test_best_in_blocks_is_brute_force(spark):
    random.seed(8)
    sheets = [(f, i, [random.choice("abcdefg") for _ in range(random.randrange(0, 9))]) for f in ("x", "y", None) for i in range(14)]
    df = spark.createDataFrame([*sheets, ("x", 90, None), ("z", 91, ["a"])], "f string, i int, w array<string>")
    left, right = df.filter("i % 2 = 0"), df.filter("i % 2 = 1")
    for exact in (True, False):
        for block in (256, 3):
            found = similarity.best_in_blocks(left, right, ["f"], "i", "w", exact=exact, block=block).collect()
            want = {}
            for f, i, w in sheets:
                if i % 2 == 0 and f:
                    score = lambda v, w=w: SequenceMatcher(None, w, v, False).ratio() if exact else SequenceMatcher(None, w, v, False).quick_ratio()  # noqa: B023
                    best = max((score(v), -j) for g, j, v in sheets if g == f and j % 2)
                    if best[0] >= 0.25:
                        want[(f, i)] = (-best[1], round(best[0], 9))
            assert {(r.f, r.a_id): (r.b_id, round(r.ratio, 9)) for r in found} == want
    assert similarity.best_in_blocks(left.limit(0), right, ["f"], "i", "w").count() == 0
    one = similarity.best_in_blocks(df.filter("f = 'x' and i = 2"), df.filter("f = 'y'"), [], "i", "w", least=0.0).first()
    assert one.a_id == 2 and 0 <= one.ratio <= 1


def test_best_block(spark):
    df = spark.createDataFrame([(list("abcd"), list("xxabcdyy")), ([], ["a"]), (["q"], ["a", "b"])], "a array<string>, b array<string>")
    assert [tuple(r.x) for r in df.select(similarity.best_block("a", "b").alias("x")).collect()] == [(1.0, 0.5), (0.0, 0.0), (0.0, 0.5)]


def test_statistics(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    assert df.agg(stats.upper_median("v")).first()[0] == 3
    s = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.5, 1), (0.5, 0), (0.9, 1), (1.2, 1), (None, 1)], "v double, y int")
    assert tuple(stats.stump(s, F.col("v"), F.col("y")).first()) == ("all", 0.45, ">", 5, 6)
    random.seed(3)
    pairs = [(i, random.randrange(9), random.randrange(9)) for i in range(200)]
    got = stats.spearman(spark.createDataFrame(pairs, "i int, a int, b int"), "a", "b", "i").first()
    ra, rb = ({p[0]: k for k, p in enumerate(sorted(pairs, key=lambda p: (p[c], p[0])))} for c in (1, 2))
    d2 = sum((ra[i] - rb[i]) ** 2 for i in ra)
    assert got.n == 200 and abs(got.rho - (1 - 6 * d2 / (200 * (200**2 - 1)))) < 1e-12


def test_index(spark, tmp_path, rows):
    docs = spark.createDataFrame([(1, "Ёлка стоит"), (2, "елка [неразборчиво] лес"), (3, None), (4, "# стоит\nлес"), (5, ""), (6, "дом"), (7, "дом")], "doc_id int, text string")
    kept, stop = index.split_stop_terms(docs)
    assert rows(kept) == [("стоит", 1)] and {r[0] for r in rows(stop)} == {"елка", "лес", "дом"}
    index.write_index(docs, str(tmp_path / "ix"), stop_share=1.0)
    assert rows(index.prefix_search(spark.read.parquet(str(tmp_path / "ix")), "ел")) == [(1,), (2,)]


def test_corpus(spark, rows):
    sheets = spark.createDataFrame([("1", "002", "б"), ("1", "001", "а\n\nв"), ("2", "001", None)], "f string, p string, t string")
    done = corpus.assemble(sheets, ["f"], "p", "t")
    assert rows(corpus.split_sheets(done, ["f"], "document").select("f", "sheet", "text")) == [("1", "001", "а\n\nв"), ("1", "002", "б"), ("2", "001", "[не получено]")]
    strips = spark.createDataFrame([(["a\nb\nc", "B!\nc\nd", "d\ne"],), ([],), (["x", None, "y"],)], "s array<string>")
    assert [r[0] for r in strips.select(corpus.stitch(F.col("s"))).collect()] == ["a\nb\nc\nd\ne", "", "x\ny"]
    flags = spark.createDataFrame([("",), ("[пустой лист]",), ("  Извините, текста нет",), (None,)], "t string").select(*(c.alias(k) for k, c in corpus.reading_flags(F.col("t")).items())).collect()
    assert [tuple(f) for f in flags] == [(True, False, False, False), (False, True, False, False), (False, False, True, False), (True, False, False, False)]


def test_long_readings_without_an_end(spark):
    df = spark.createDataFrame([("слово " * 61 + "конец \n",), ("слово " * 61 + "конец,",), ("слово " * 10 + "конец",), (None,)], "t string")
    assert [r[0] for r in df.select(corpus.reading_flags(F.col("t"))["open_ended"]).collect()] == [True, False, False, False]
    replies = spark.createDataFrame([("да", "STOP"), ("да", "MAX_TOKENS"), (" ", "STOP"), (None, None), ("да", None)], "t string, f string")
    assert [r[0] for r in replies.select(corpus.usable_reply(F.col("t"), F.col("f"))).collect()] == [True, False, False, False, True]


def _page(width=1200, height=500, line=30, letter=12):
    page = np.full((height, width), 250, np.uint8)
    for top in range(20, height - line, line):
        for left in range(40, width - 40, letter):
            page[top : top + 14, left : left + letter // 2] = 10
    return page


def test_raster_bands_and_pitch():
    page = _page()
    ink, contrast = raster.ink_mask(page.astype(float))
    lines = raster.bands(ink)
    assert contrast == 240 and len(lines) == 15 and lines[0] == (20, 34)
    strength, lag = raster.pitch(ink[20:34].mean(axis=0))
    assert lag == 12 and strength > 0.9
    assert raster.pitch(np.zeros(100)) == (0.0, 0) and raster.pitch(np.arange(50.0)) == (0.0, 0)
    got = raster.measure(page)
    assert got["bands"] == 15 and got["ink_cv"] == got["gap_cv"] == got["height_cv"] == 0 and got["pitch_peak"] > 0.9
    assert raster.measure(np.full((50, 50), 7, np.uint8)) is None and raster.measure(page[:60]) is None
    assert raster.page_metrics(page)["regular"] > 0.95 and raster.page_metrics(np.full((5, 5), 9, np.uint8))["lines"] == 0


def test_resized_keeps_means():
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 255, (30, 47)).astype(np.uint8)
    for width in (13, 47, 90):
        out = raster.resized(grey, width)
        assert out.shape == (max(1, int(30 * width / 47)), width) and abs(out.mean() - grey.mean()) < 4
    assert (raster.resized(np.full((9, 9), 5, np.uint8), 4) == 5).all()


def test_strips_cover_a_sheet():
    got = raster.strips(1000)
    assert len(got) == 5 and got[0][0] == 0 and got[-1][1] == 1000 and all(a[1] > b[0] for a, b in zip(got, got[1:], strict=False))
    assert raster.strips(100) == [(0, 100)] and raster.strips(0) == []


def test_streaks_in_a_hot_key(spark, rows):
    data = [("hot", i, i % 5 == 0) for i in range(40)] + [("hot", i, False) for i in range(40, 60)] + [("cold", 1, None), ("cold", 2, True), (None, 1, False)]
    df = spark.createDataFrame(data, "k string, n int, hit boolean")
    kept = sequence.streak_stop(df, "k", ["n"], F.col("hit"), 6)
    assert kept.groupBy("k").count().collect() and sorted((r.k or "", r["count"]) for r in kept.groupBy("k").count().collect()) == [("", 1), ("cold", 2), ("hot", 36)]


def test_crawl_ends_in_cycles(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("c", "c"), (None, "z")], "p string, n string")
    start = spark.createDataFrame([("a",)], "n string")
    assert rows(sequence.crawl(start, edges, ["n"], ["p"])) == [("a",), ("b",), ("c",)]
    assert rows(sequence.crawl(start.limit(0), edges, ["n"], ["p"])) == []


def test_raster(spark):
    page = np.full((120, 200), 250, np.uint8)
    for top in range(5, 115, 12):
        for left in range(10, 190, 8):
            page[top : top + 6, left : left + 4] = 10
    df = spark.createDataFrame([(120, 200, bytearray(page.tobytes())), (2, 2, bytearray(b"\0\0\0\0")), (None, 1, None)], "h int, w int, c binary")
    got = df.select(raster.features("h", "w", "c").alias("f")).select("f.*").collect()
    assert got[0].bands == 10 and got[0].ink_cv < 0.1 and got[1].bands is None and got[2].bands is None
    jpeg = spark.createDataFrame([(bytearray(b"\xff\xd8\xff" + b"0" * 2000 + b"\xff\xd9"),), (bytearray(b"\xff\xd8\xff"),), (None,)], "c binary")
    assert [r[0] for r in jpeg.select(raster.is_jpeg(F.col("c"))).collect()] == [True, False, False]
    assert [r[0] for r in spark.createDataFrame([(None,), (0.5,), (0.81,)], "v double").select(raster.page_class(F.col("v"))).collect()] == ["note", "typed", "hand"]
