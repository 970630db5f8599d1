import pytest

from papyrine.llm import repetition, scan_noise, sheets, truncation

HEAD = "Фонд 314. Опись 1. Дело 144"
SENTENCE = "Вѣсъ меднаго шара равенъ {} пудовъ, что въ равной мѣре меньше прежнего."


def kinds(text, page=None):
    return sheets.kinds(text.split("\n"), page)


def test_titles_and_page_numbers():
    assert kinds(f"{HEAD}\n[5]\nтекстъ", 4) == ["header", "page_number", ""]
    assert kinds("7   Фoнд 314. 0пись 1a. Дело 25a\nтекст\n- 7 -", 6) == ["header", "", "page_number"]
    for title in (HEAD.upper(), f"* {HEAD} *", f"{HEAD}      12", "Тонкий брус. Часть IV", "Записки кружка «Камера», вып. 3", "СЖАТОЕ КОЛЕСО", "С Ж А Т О Е   К О Л Е С О", "Т о н к и й   б р у с .   Ч а с т ь   I V"):
        assert kinds(f"первая строка,\n{title}\nи вторая.")[1] == "header", title
    assert kinds("Глава XII. Гладкий термометр\nтекст")[0] == ""
    assert kinds("ПОЛНЫЙ СНАРЯД ПОГЛОЩАЕТ\nБЫСТРОЕ СЕЧЕНИЕ\nтекст")[:2] == ["", ""]


def test_sums_are_no_page_numbers():
    assert kinds(f"текст.\n325\n121\n{HEAD}\n899\nИтого 1345\n12", 11) == ["", "sum", "sum", "header", "sum", "sum", "page_number"]
    assert kinds("текст\n325\n121", 11) == ["", "", ""]


@pytest.mark.parametrize(
    "text,evidence",
    [
        ("Всё кончено.", "finished"), ("Да.\nВсё кон", "unfinished"), ("Да. Всё кон\nчил\n— 12 —", "unfinished"), (f"Всё кончено.\n{HEAD}", "finished"),
        ("| а | б |\n| 1 | 2 |", "finished"), ("| а | б |\n| 1 |", "unfinished"), ("| а | б |\n| 1 | 2", "unfinished"), ("Слово [неразбо", "unfinished"),
        ("Да.\n10\n20\nИтого 30", "finished"), ("Да.\n100\n200\nИтого 30", "unfinished"), ("Да.\n100\n20", "unfinished"), ("Да.\nЕ. Мольцевъ", "finished"),
        ("Да.\n15 октября 1915 г. Заречинск", "finished"), ("Да.\n15 октября 19", "unfinished"), ("Папка вторая", "finished"), ("[пустой лист]", "finished"),
        ("Да.\n[рисунок: шар]", "finished"), ("сталь безъ перемены[?]", "unfinished"), ("конецъ�", "unfinished"),
    ],
)
def test_endings(text, evidence):
    assert (truncation.ending(text, 11)[2] == "finished") == (evidence == "finished")


def test_endings_of_nothing():
    assert truncation.ending(None) is truncation.ending("") is truncation.ending(" \n") is truncation.ending(HEAD) is None


def test_broken_lines():
    lines = ["Тяжё-", HEAD, "лая лодка -", "малая сила опис=", "ать", "Объ-", "Этомъ ме\xad"]
    assert scan_noise.joins(lines, sheets.kinds(lines)) == {0: 2, 3: 4}


def test_direct_misreadings():
    lines = ["так0й дом", "пo#ле сна", "с%арядъ", "тpос", "M1 и M2", "в 1905 году", "обычный текст", "15-й, № 7", "weak va1ve", "подвижна|", "| 1 | 2 |", "по-прежнему"]
    assert scan_noise.direct_misreadings(lines, [""] * len(lines)) == {0, 1, 2, 3, 8}


def test_body_words_are_words_of():
    text = f"Тяжё-\n{HEAD}\nлая л0дка, ста#ый\nноваго вопро-\nса и сжат-\nый"
    sheet, noisy, _ = scan_noise._sheet(text, "001")
    assert noisy and scan_noise.body_words(*sheet) == ["тяжёлая", "новаго", "вопроса", "и", "сжатый"]
    assert sorted(scan_noise.body_words(*sheet)) == sorted(w for *_, w in scan_noise.words_of(*sheet))


def test_shares():
    a, b = SENTENCE.format("двадцати"), "Такимъ образомъ, далёкій шаръ нагреваетъ не только новую лампу, но и камеру."
    c = "Объ этомъ писалъ Кремлюкъ, что въ равной мѣре меньше прежнего стало."
    assert repetition.shares(f"{a} {b} {c}")[1] == 0.0
    n, share, *_ = repetition.shares(f"{a}\n1. {b}\n2) {b.upper()}\n№ 3 {b.replace(' не', '  не[?]')}\n")
    assert n == 48 and share == 0.5
    wrapped = b.replace("только", "толь-\nко").replace("лампу, ", "лампу,\n")
    assert repetition.shares(f"{HEAD}\n{a} {wrapped}\n{b}\n5", 4)[1] == pytest.approx(12 / 36)
    assert repetition.shares("на высоте; " * 9)[1] > 0.8
    assert repetition.shares("| 1 | 1 |\n" * 20 + a)[1] == 0.0
    assert repetition.shares(None)[1] is repetition.shares(" \n")[1] is None
    # the words of marks count, the mark of doubt does not
    assert repetition.shares("[пустой лист]")[:2] == (2, 0.0)
    assert repetition.shares("[на полях: [неразборчиво]]\n" * 40)[1] > 0.9
    assert repetition.shares(f"{a} {b}[?] [?] [?]")[1] == 0.0


def test_first_look_agrees_with_the_exact_search():
    import random

    import numpy as np

    rng = random.Random(7)
    texts = []
    for _ in range(300):
        words = [rng.choice("абвгдежзик") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))]
        cut = rng.randrange(len(words))
        texts.append(" ".join(words + words[cut:] * rng.randrange(0, 3)))
    together = repetition.measure(texts, [None] * len(texts))
    for text, got in zip(texts, together, strict=True):
        words = repetition.units(text)[0]
        index = {}
        codes = np.array([index.setdefault(w, len(index)) for w in words])
        marked = np.zeros((2, len(words)), bool)
        repetition._passages(codes, marked[0])
        repetition._loops(codes, marked[1])
        assert got[4:6] == tuple((np.count_nonzero(marked, axis=1) / len(words)).tolist())


def test_functions_can_be_outvoted():
    code = lambda votes: sum(v * 3**k for k, v in enumerate(votes))
    for_it, against = code([1] * 7), code([2] * 7)
    model = repetition.RepetitionModel({for_it: 60, against: 900, code([2, 2, 1, 1, 1, 1, 1]): 30, code([2, 0, 2, 2, 2, 1, 2]): 10})
    assert model.posterior(for_it) > 0.99 > 0.01 > model.posterior(against)
    assert model.posterior(code([2, 2, 1, 1, 1, 1, 1])) > 0.9  # no copies of sentences and lines, but all else
    assert model.posterior(code([2, 1, 2, 2, 2, 2, 2])) < 0.5  # one function alone
