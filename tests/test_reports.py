"""Reports on readings over small frames whose figures are known."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from papyrine.operators import reports

WORDS = [f"{a}{b}{c}" for a in ("ба", "во", "ги", "де", "жу") for b in ("ра", "ло", "ми", "не") for c in ("та", "со", "ки")]


def _text(rng, n=50):
    words = [rng.choice(WORDS) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="module")
def measured(spark):
    rng = random.Random(5)
    typed = {f: _text(rng, 60) for f in ("01", "02")}
    hand = {f: " ".join(w if rng.random() < 0.7 else rng.choice(WORDS) for w in t.split()) for f, t in typed.items()}
    mark = lambda t: " ".join(w + "[?]" * (i % 10 == 0) for i, w in enumerate(t.split()))
    data = [(10 * k + 1, "1", f, f"h{f}", "old", mark(hand[f])) for k, f in enumerate(hand)] + [(10 * k + 2, "1", f, f"t{f}", "old", t) for k, (f, t) in enumerate(typed.items())]
    data += [(10 * k + 3, "1", f, f"o{f}", "old", _text(rng, 60)) for k, f in enumerate(hand)]
    data += [(101, "1", "01", "h01", "new", mark(typed["01"])), (102, "1", "02", "h02", None, mark(" ".join(hand["02"].split()[:55] + ["ещё"] * 5)))]
    data += [(5, "1", "01", "h9", "old", "мало слов"), (6, "1", "03", "h7", "old", None), data[0]]
    classes = spark.createDataFrame([(p, "hand") for p in ("h01", "h02", "h9", "h7")] + [(p, "typed") for p in ("t01", "t02", "o01", "o02")], "path string, class string")
    readings = spark.createDataFrame(data, "reading_id bigint, opis_code string, delo string, path string, model string, text string")
    return reports.sheets(readings, classes).cache(), typed


def test_calibration(measured):
    df, _ = measured
    pairs = reports.calibration(df, "reading_id < 100")
    got = {r.hand: r for r in pairs.collect()}
    assert {k: v.typed for k, v in got.items()} == {1: 2, 11: 12} and all(0.5 < r.ratio < 0.95 and r.longest_run >= 2 for r in got.values())
    figures = reports.calibration_figures(pairs).first()
    assert figures.pairs == figures.files == 2 and figures.best >= figures.middle >= figures.worst
    assert reports.calibration_figures(pairs.limit(0)).first().pairs == 0


def test_calibration_against_truth(spark, measured):
    df, typed = measured
    published = spark.createDataFrame([("1", f, ["начало"] * 30 + t.split() + ["конец"] * 30) for f, t in typed.items()], "opis_code string, delo string, tokens array<string>")
    rows = reports.calibration_against_truth(reports.calibration(df, "reading_id < 100"), df, published)
    got = {r.hand: r for r in rows.collect()}
    assert set(got) == {1, 11} and all(abs(r.acc_hand - r.agree) < 0.2 and r.acc_typed > 0.8 for r in got.values())
    figures = reports.truth_figures(rows).first()
    assert figures.n == 2 and figures.rho is None and reports.truth_figures(rows.limit(0)).first().n == 0


def test_model_comparison(measured):
    df, _ = measured
    rows = {r.path: r for r in reports.model_comparison(df).collect()}
    assert set(rows) == {"h01", "h02"} and rows["h01"].agree_old is None  # the new reading is the typed page itself
    assert rows["h02"].agree_old > rows["h02"].agree_new and rows["h02"].model_new is None
    figures = reports.comparison_figures(reports.model_comparison(df)).first()
    assert (figures.n, figures.compared, figures.wins) == (2, 1, 0) and figures.gain < 0


def test_ab_and_measurements(spark, measured):
    df, _ = measured
    rows = reports.ab_rows(reports.calibration(df, "reading_id < 100"), df.filter("model = 'new'"), df.filter("reading_id < 100"), reports.typed(df)).collect()
    assert [(r.path, r.agree_cheap) for r in rows] == [("h01", 1.0)] and rows[0].agree_strong < 1
    table = spark.createDataFrame([("b", "x", 0.2, 10, 0.1, 1), ("a", "x", 0.4, 20, None, 2), ("a", "y", 0.6, 30, 0.3, 3), ("b", "x", 0.8, 10, 0.1, 4)], "model string, stratum string, agreement double, words int, uncertain double, place int")
    got = [(r.model, r.x, r.y, r.sheets, r.mean_words) for r in reports.measurement_table(table, ["x", "y"]).collect()]
    assert got == [("b", 0.8, None, 2, 10.0), ("a", 0.4, 0.6, 2, 25.0)]


def test_titles_and_validation(spark):
    published = spark.createDataFrame([(1, "вне земли"), (2, "ничего общего"), (3, "")], "id bigint, title string")
    files = spark.createDataFrame([(7, "вне земле"), (8, "вне земли"), (9, "аэростат")], "id bigint, title string")
    matches = reports.title_matches(published, files)
    assert [(r.published, r.file, r.title_match) for r in matches.collect()] == [(1, 8, 1.0)]
    text = " ".join(WORDS)
    ours, theirs = spark.createDataFrame([(8, "## Лист 1\n" + text.replace("та", "тѣ"))], "id bigint, text string"), spark.createDataFrame([(1, text.replace("та", "те") + " " + text)], "id bigint, text string")
    row = reports.against_published(matches, ours, theirs).first()
    assert row.words_folded == 1.0 > row.words_raw and row.coverage == 0.5
    assert [(r.same_edition, r.n) for r in reports.validation_figures(reports.against_published(matches, ours, theirs)).collect()] == [(True, 1)]


def test_titles_are_searched_once_each(spark, monkeypatch):
    """Titles that recur are joined or searched once, not for each row; matches are those of every title with every file."""
    rng = random.Random(7)
    titles = sorted({f"{rng.choice(WORDS)} {rng.choice(WORDS)}" for _ in range(40)})
    bent = lambda t: t.replace("а", "о", 1) if rng.random() < 0.3 else t
    files = [(i, bent(rng.choice(titles))) for i in rng.sample(range(1000), 300)] + [(None, titles[0]), (1000, ""), (1001, None)]
    published = [(i, bent(rng.choice(titles))) for i in range(400)] + [(None, titles[0]), (400, ""), (401, None), (402, "щщщ")]
    searched = []
    whole = reports.similarity.best_in_blocks
    monkeypatch.setattr(reports.similarity, "best_in_blocks", lambda q, r, *a, **k: searched.append((q.count(), r.count())) or whole(q, r, *a, **k))
    kind = "id bigint, title string"
    got = {r.published: (r.file, r.title_match) for r in reports.title_matches(spark.createDataFrame(published, kind), spark.createDataFrame(files, kind)).collect()}
    held = sorted((i, t) for i, t in files if i is not None and t)
    want = {}
    for i, t in published:
        if i is not None and t:
            ratio, file = max(((SequenceMatcher(None, t, u, False).ratio(), -k) for k, u in held))
            want |= {i: (-file, round(ratio, 2))} if ratio >= reports.LEAST_TITLE else {}
    assert got == want and {m < 1 for _, m in got.values()} == {True, False}
    distinct = {t for _, t in held}
    assert set(searched) == {(len({t for _, t in published if t} - distinct), len(distinct))}


def test_published_texts_are_paired_before_they_are_worked_on(spark):
    """Python gets texts, not arrays of words, and only those of pairs."""
    matches = spark.createDataFrame([(1, 8, 1.0), (2, 8, 0.8), (3, 9, 0.9), (4, 8, 0.8), (5, 7, 0.8)], "published bigint, file bigint, title_match double")
    ours = spark.createDataFrame([(8, "Снѣгъ идётъ  давно, и лес молчит"), (9, "нет пары"), (7, "**поле**")], "id bigint, text string")
    theirs = spark.createDataFrame([(1, "снег идет давно и лес молчит"), (2, "# заглавие\n[?]"), (4, "лес молчит и снег идет давно а потом перестает"), (5, "слово"), (6, "без пары")], "id bigint, text string")
    scored = reports.against_published(matches, ours, theirs)
    got = sorted(tuple(r) for r in scored.collect())
    assert got == [(1, 8, 1.0, 6, 6, 1.0, 0.667, 1.0), (2, 8, 0.8, 6, 0, 0.0, 0.0, 0.0), (4, 8, 0.8, 6, 9, 0.667, 0.333, 0.5), (5, 7, 0.8, 0, 1, 0.0, 0.0, 0.0)]
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.rindex("ArrowEvalPython") < plan.index("Join ")


def test_score_collation_and_rendering(spark):
    df = spark.createDataFrame([("Домъ, снѣгъ [?] и лес", "дом снег и поле"), ("", "а")], "a string, b string")
    got = df.select(*(c.alias(k) for k, c in reports.score(F.col("a"), F.col("b"), fold=True).items())).collect()
    assert (got[0].words_ours, got[0].words_pub, got[0].words, got[0].differences) == (4, 4, 0.75, 1) and got[1].words == 0.0
    pairs = spark.createDataFrame([(list("abcdefgh"), list("abXYZfgh")), (list("ab"), list("xy")), ([], [])], "a_w array<string>, b_w array<string>")
    rows = reports.resolved(pairs, F.lit(0.5), least=2).collect()
    assert rows[0].observed == 0.625 and [(d.kind, d.words, d.first, d.second) for d in rows[0].differences] == [("replace", 3, "c d e", "X Y Z")]
    assert rows[1].observed == 0 and rows[1].differences is None and rows[2].observed is None
    table = spark.createDataFrame([(2, "б"), (1, "а")], "n int, v string")
    assert {r.lang: r.document for r in reports.rendered(table, {"en": "%d %s", "ru": "№%d %s"}, ["n", "v"], ["n"], {"en": "Head\n"}).collect()} == {"en": "Head\n1 а\n2 б", "ru": "№1 а\n№2 б"}
