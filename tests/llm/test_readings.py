"""The operators on sheets over small frames: whole runs, and the cases at the edges."""

import random

import pytest

from papyrine.llm import repetition, scan_noise, truncation

SCHEMA = "reading_id bigint, model string, page string, text string, words string, evidence string"
WORDS = ["медный", "плоский", "верный", "тонкий", "сложный", "далёкий", "старый", "полный", "новый", "опытный"]
THINGS = ["маятник", "барометр", "термометр", "рычаг", "снаряд", "прибор", "вопрос", "поток", "журнал", "доклад"]


def sentence(rng):
    return f"{rng.choice(WORDS).capitalize()} {rng.choice(THINGS)} {rng.randrange(10, 99)} раз заменяет {rng.choice(WORDS)} {rng.choice(THINGS)} без потери."


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(4)
    data, cut, repeated = [], set(), set()
    for i in range(400):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(3, 14)))
        model = "limited" if i % 2 else None
        if model and len(text) > 300:
            text = text[:300]
            if not text.endswith("."):
                cut.add(i)
        elif i % 40 == 0:
            text = text[: len(text) // 2].rstrip(". ") + " и"
            cut.add(i)
        elif i % 40 == 2:
            s = sentence(rng)
            text = f"{text} {' '.join([s] * 30)}"
            repeated.add(i)
        data.append((i, model, "003", text, None, "x"))
    data += [data[0], (1000, "limited", "001", None, None, None), (1001, None, None, "", None, None), (1002, "limited", "x", " \n", None, None), (None, None, None, "текст", None, None)]
    return spark.createDataFrame(data, SCHEMA), cut, repeated


def test_truncated(readings, rows):
    df, cut, _ = readings
    assert {r[0] for r in truncation.truncated(df).collect()} == cut
    report = {r.model: r for r in truncation.truncation_by_source(df).collect()}
    assert report["limited"].readings == 202 and report["limited"].at_limit > 50 and report[None].at_limit == 0
    found = truncation.limits(truncation.endings(df)).filter("unit = 'chars' and limit is not null").collect()
    assert [(r.source, r.limit) for r in found] == [("limited", 300)] and found[0].posterior > 0.9
    assert truncation.truncated(df.limit(0)).count() == 0


def test_censored_fit_finds_the_uncut_lengths():
    import numpy as np
    import pandas as pd

    z = np.exp(np.random.default_rng(1).normal(6.0, 0.5, 20_000)).round()
    z = np.minimum(z, 500)
    length, n = np.unique(z, return_counts=True)
    got = truncation._fit(pd.DataFrame({"source": "s", "unit": "chars", "length": length, "n": n, "candidate": length == 500})).iloc[1]
    assert abs(got.mu - 6.0) < 0.03 and abs(got.sigma - 0.5) < 0.03 and got.posterior > 0.95


def test_repeating(readings):
    df, _, repeated = readings
    assert {r[0] for r in repetition.repeating(df).collect()} == repeated
    assert repetition.repetition(df).filter("share is null").count() == 3
    assert repetition.repeating(df.limit(0)).count() == 0


def test_noise(spark, rows):
    rng = random.Random(6)
    data = [(i, "m", "004", " ".join(sentence(rng) for _ in range(12)), None, None) for i in range(120)]
    noisy = "Фонд 314. Опись 1. Дело 144\nМедный маягник заменяет вер-\nный термометр. Тонкий ры-\n5\nчаг и ста-\nрый до\xad\nнлад без потери.\n5"
    data += [(500, "m", "004", noisy, None, None), (500, "m", "004", noisy, None, None), (501, None, None, None, None, None), (502, "m", None, "", None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    found = rows(scan_noise.noisy_lines(df))
    assert found == [(500, 1, "header"), (500, 2, "hyphen"), (500, 2, "misread"), (500, 3, "hyphen") if (500, 3, "hyphen") in found else (500, 5, "hyphen"), *found[4:]]
    assert {(500, 5, "hyphen"), (500, 6, "hyphen"), (500, 7, "misread"), (500, 8, "page_number")} <= set(found) and {f[0] for f in found} == {500}
    fixes = {r.wrong: r.right for r in scan_noise.corrections(scan_noise.word_counts(df)).collect()}
    assert fixes == {"маягник": "маятник", "донлад": "доклад"}
    text = {r.reading_id: r.repaired for r in scan_noise.repaired(df).collect()}
    assert text[500].startswith("Медный маятник заменяет верный термометр.") and "старый доклад без потери." in text[500] and text[501] is None and text[502] == ""
    assert scan_noise.noisy_lines(df.limit(0)).count() == 0 and scan_noise.repaired(df.limit(0)).count() == 0


def test_repair_word():
    assert [scan_noise.repair_word(w, {"маягник": "маятник"}) for w in ("Маягник", "МАЯГНИК", "тpос", "так0й", "va1ve", "1905", "дом")] == ["Маятник", "МАЯТНИК", "трос", "такой", "valve", "1905", "дом"]


def test_anagram_hash(spark):
    df = spark.createDataFrame([("аб",), ("ба",), ("",)], "w string")
    got = [r[0] for r in df.select(scan_noise.anagram_hash("w")).collect()]
    assert got == [ord("а") ** 5 + ord("б") ** 5] * 2 + [0]


def test_signs_for_letters_are_mended(spark):
    """A word with one of the signs for a letter is mended to the most frequent word that fits, also over a line end."""
    plain = "Землю держит известный маятник. Der leichte Wagen rollt."
    data = [(i, "m", "004", plain, None, None) for i in range(5)] + [(9, "m", "004", "Мачта маячник.", None, None)]
    data.append((10, "m", "004", "Зем#ю держит и$вестный ма^тник, изве\\т-\nный МАЯТ%ИК и не|нак. Der le!chte Wag|n и зем#ю", None, None))
    df = spark.createDataFrame(data, SCHEMA)
    text = {r.reading_id: r.repaired for r in scan_noise.repaired(df).collect()}
    assert text[10] == "Землю держит известный маятник, известный МАЯТНИК и не|нак. Der leichte Wagen и землю" and text[0] == plain
    assert {tuple(r) for r in scan_noise.noisy_lines(df).collect()} == {(10, 1, "misread"), (10, 1, "hyphen"), (10, 2, "misread")}


def test_letters_beside_a_misreading_that_shows_itself(spark):
    """A word misread letter for letter is mended though its only line has another misreading."""
    data = [(i, "m", "004", "Точный маятник держит такой груз. " * 5 + "Верный конец.", None, None) for i in range(20)]
    data.append((100, "m", "004", "Точный маягник держит так0й груз. Верный конец.", None, None))
    df = spark.createDataFrame(data, SCHEMA)
    assert {r.reading_id: r.repaired for r in scan_noise.repaired(df).collect()}[100] == "Точный маятник держит такой груз. Верный конец."


def test_one_passage_of_ten_words_said_twice():
    """The only repetition is one passage of exactly ten words that is no sentence and no line."""
    text = "Утром медный маятник над старым столом держит тонкий верный груз без потери снова потом медный маятник над старым столом держит тонкий верный груз без остатка."
    assert repetition.shares(text)[1] == 10 / 25


def test_one_cut_among_many(spark):
    """A source that hardly ever cuts does not lose its one cut reading."""
    rng = random.Random(8)
    data = [(i, "clean", "003", " ".join(sentence(rng) for _ in range(rng.randrange(2, 5))), None, None) for i in range(3000)]
    data.append((5000, "clean", "003", sentence(rng) + " Медный маятник и", None, None))
    df = spark.createDataFrame(data, SCHEMA)
    assert [r[0] for r in truncation.truncated(df).collect()] == [5000]


def test_the_fit_decides_where_the_ending_does_not(spark):
    """Readings that end in an illegible place after no stop: cut at the field limit, whole elsewhere."""
    rng = random.Random(9)
    data, at_limit, elsewhere = [], set(), set()
    mark = " [неразборчиво]"
    for i in range(900):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(3, 12)))
        if len(text) > 400:
            text = text[:400]
            if i % 6 == 0:
                text = text[: 400 - len(mark)].rstrip(". ")
                text += "н" * (400 - len(mark) - len(text)) + mark
                at_limit.add(i)
        elif i % 6 == 0:
            text = text.rstrip(".") + mark
            elsewhere.add(i)
        data.append((i, "limited", "003", text, None, None))
    df = spark.createDataFrame(data, SCHEMA)
    found = {r[0] for r in truncation.truncated(df).collect()}
    assert len(at_limit) > 20 < len(elsewhere) and at_limit <= found and not elsewhere & found
    unfitted = {r[0] for r in truncation.truncation(df, fitted=False).filter("is_cut").collect()}
    assert (at_limit <= unfitted) == (elsewhere <= unfitted)  # without the fit the two are told apart no more


def test_titles_in_wordings_of_their_own(spark):
    """A line at the top of many sheets of one file is a running title, whatever it says; elsewhere it is body."""
    from papyrine.llm import titles

    rng = random.Random(10)
    body = lambda: "\n".join(sentence(rng) for _ in range(4))
    data = [(i, "m", f"{i + 1:03}", f"Дневник опытов {i + 1}\n{body()}\nК. Мельцов", "1", "0007") for i in range(12)]
    data += [(100 + i, "m", f"{i + 1:03}", f"{'Дневник опытов' if i == 3 else 'Начало главы ' + chr(1072 + i)}\n{body()}", "1", "0008") for i in range(12)]
    data += [(200, "m", "001", None, "1", "0007"), (201, None, None, "Дневник опытов\nДа.", None, None)]
    df = spark.createDataFrame(data, "reading_id bigint, model string, page string, text string, opis_code string, delo string")
    found = titles.running_titles(df).collect()
    assert [(r.opis_code, r.delo, r.titles) for r in found] == [("1", "0007", ["дневникопытов"])]
    noisy = {(r.reading_id, r.line_no) for r in scan_noise.noisy_lines(df).filter("kind = 'header'").collect()}
    assert noisy == {(i, 1) for i in range(12)}
    mended = {r.reading_id: r.repaired for r in scan_noise.repaired(df).collect()}
    assert not any("Дневник" in mended[i] for i in range(12)) and "Дневник" in mended[103] and mended[200] is None
    assert titles.running_titles(df.limit(0)).count() == 0
    assert titles.with_titles(df.select("reading_id", "text"), ["reading_id"]).filter("titles is not null").count() == 0


def test_hyphens_signs_and_other_scripts(spark, rows):
    """Hyphens of broken words are kept by counts; stray Latin letters are mended; words of other scripts do no harm."""
    plain = "Кое-кто вышел из-за стола. Тонкий рычаг держит груз в доме с окном."
    data = [(i, "m", "004", f"{plain} {plain}", None, None) for i in range(30)]
    data += [(100, "m", "004", "Он вышел из-\nза стола и кое-\nкто видел тон-\nкий рычаг.", None, None), (101, "m", "004", "中文字 한국어 𐍈𐌰𐌽 рычаг.", None, None)]
    data += [(102, "m", "004", "Тонкий рычаг держит груз в доме c окном.", None, None), (103, "m", "004", "Тонкий ры^аг стоит.", None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    expected = {100: "Он вышел из-за стола и кое-кто видел тонкий рычаг.", 101: "中文字 한국어 𐍈𐌰𐌽 рычаг.", 102: "Тонкий рычаг держит груз в доме с окном.", 103: "Тонкий рычаг стоит."}
    for shared in (1000, 0):  # corrections shared with the tasks, and joined
        got = {r.reading_id: r.repaired for r in scan_noise.repaired(df.unionByName(df.filter("reading_id = 100")), shared).collect()}
        assert {k: got[k] for k in expected} == expected and len(got) == 34
    assert (102, 1, "misread") in rows(scan_noise.noisy_lines(df))


def test_confusions_that_the_corpus_shows(spark):
    """A pair of letters that no list knows is learned from the rare words that show it."""
    words = [f"{a}ж{b}ный" for a in ("бума", "доро", "кни", "стра") for b in ("ост", "ел")]
    counts = [(w, 4000) for w in words] + [(w.replace("ж", "х"), 3) for w in words[:6]] + [("中文字中文字", 9)]
    frame = spark.createDataFrame(counts, "word string, n bigint")
    fixes = {r.wrong: r.right for r in scan_noise.corrections(frame).collect()}
    assert fixes == {w.replace("ж", "х"): w for w in words[:6]}


def test_files_of_other_types_and_extra_columns(spark):
    """Inventory and file may be numbers; columns named like those of the operators do no harm."""
    data = [(i, 1, 7, "m", f"{i + 1:03}", f"Дневник опытов {i + 1}\nМедный рычаг держит груз.\nДа.", ["x"], "y", 3) for i in range(6)]
    df = spark.createDataFrame(data, "reading_id int, opis_code int, delo int, model string, page string, text string, titles array<string>, words string, n int")
    assert scan_noise.noisy_lines(df).filter("kind = 'header'").count() == 6
    assert scan_noise.repaired(df).count() == 6 and repetition.repeating(df).count() == 0 and truncation.truncated(df).count() == 0
