import datetime as dt

from pyspark.sql import functions as F

from papyrine.functions import parse, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()[0]


def test_fold_and_tokens(spark):
    fold = lambda s: one(spark, s, lambda c: F.trim(text.fold_orthography(c)))
    assert [fold(s) for s in ("полетъ", "полетъ,", "Ѳеодоръ", "какъ-то", "—", "ё_ж")] == ["полет", "полетъ", "феодор", "какъ то", "", "е_ж"]
    assert one(spark, "Онъ [вставка: тамъ] ~~былъ~~ какъ-то[?] [неразборчиво]", text.word_tokens) == ["он", "какъ то"]
    assert one(spark, "x [вставка: [неразборчиво]] y", text.clean_markup) == "x ] y"
    assert one(spark, None, text.word_tokens) is None


def test_rates(spark):
    assert one(spark, "слово " * 29 + "[?]", lambda c: text.uncertainty(c, 31)) is None
    assert one(spark, "слово " * 47 + "а[?] б[?] [неразборчиво]", text.uncertainty) == 0.06
    assert one(spark, "", text.uncertainty_or_zero) == 0.0
    assert one(spark, "домъ " * 30, text.archaisation) == 1.0


def test_normalize_and_html(spark):
    assert one(spark, "## Лист 1\nПре-\nкрасный «Ёж»", lambda c: text.normalize_text(c)) == "прекрасный еж"
    assert one(spark, "Домъ", lambda c: text.normalize_text(c, True)) == "дом"
    assert one(spark, "<p>a&nbsp;<b>b</b></p><script>x<y</script>&amp;", text.strip_blocks) == "a b &"
    assert one(spark, " а <b>б</b>\n", text.strip_html) == "а б"


def test_names_and_numbers(spark):
    name = 'Чертёж "Пустота", 2-й вариант Вид материала: чертёж Способ воспроизведения:  Языки: русский'
    got = spark.createDataFrame([(name,)], "v string").select(*(c.alias(k) for k, c in parse.name_fields(F.col("v")).items())).first().asDict()
    assert got == {"title": 'Чертёж "Пустота", 2-й вариант', "material": "чертёж", "reproduction": "", "language": "русский"}
    assert [one(spark, v, parse.pad_number) for v in ("033", "585а", "123456")] == ["0033", "0585а", "123456"]
    assert [one(spark, v, parse.strip_zeros) for v in ("0033", "000", "0145а")] == ["33", "0", "145а"]
    assert one(spark, name, parse.variant_number) == 2 and one(spark, name, parse.quoted_work) == "пустота"
    assert one(spark, "письмо, Статья,  ,синее", lambda c: parse.gloss(c, "материал")) == "letter, article, синее"
    assert one(spark, "003-006", parse.expand_pages) == ["003", "004", "005", "006"] and one(spark, "3, 12", parse.expand_pages) == ["003", "012"]
    assert one(spark, "/a b/ж?", parse.percent_encode) == "/a%20b/%D0%B6?"


def test_partial_dates(spark):
    def parts(raw):
        ymd, p = parse.partial_date(F.col("v"))
        r = spark.createDataFrame([(raw,)], "v string").select(ymd.alias("a"), p.alias("p")).first()
        return r.a, r.p

    assert parts("19.10.1920") == ([1920, 10, 19], 3)
    assert parts("март 1932 г.") == ([1932, 3, 0], 2)
    assert parts("июль 1924 г. - 8.06.1926") == ([1924, 7, 0], 2)
    assert parts("1932 г.") == ([1932, 0, 0], 1) and parts("нет") == (None, None)
    df = spark.sql("select array(1920, 9, 1) a, 3 pa, array(1920, 10, 19) b, 3 pb, array(1932, 3, 0) c, 2 pc, array(1932, 0, 0) d, 1 pd")
    r = df.select(*(parse.earlier_at_common_precision(*(F.col(x) for x in q)) for q in (("a", "pa", "b", "pb"), ("c", "pc", "d", "pd")))).first()
    assert tuple(r) == (True, False)
    y = spark.createDataFrame([("[июнь 1925 г.]",), ("июль 1924 г. - 8.06.1926",), ("",)], "v string").select(*(c.alias(k) for k, c in parse.year_range(F.col("v")).items())).collect()
    assert [tuple(x) for x in y] == [(1925, 1925, True), (1924, 1926, False), (None, None, False)]


def test_reset_time(spark):
    df = spark.createDataFrame([("resets 1am", dt.datetime(2024, 1, 1, 0, 34)), ("resets 11am", dt.datetime(2024, 1, 1, 0, 34)), ("no", dt.datetime(2024, 1, 1))], "r string, t timestamp_ntz")
    assert [x[0] for x in df.select(parse.seconds_until(F.col("r"), F.col("t"))).collect()] == [1620, 0, 0]


def test_claims_and_titles(spark):
    df = spark.createDataFrame([("В фонде 12 дел. Всего 12 дел, а не 15 дел {x}", 12)], "t string, n int")
    r = df.select(text.contradictions(F.col("t"), r"(\d+) дел", F.col("n")), text.states(F.col("t"), F.lit("всего  12 ДЕЛ")), text.balanced(F.col("t"))).first()
    assert tuple(r) == (["15"], True, True)
    assert [one(spark, v, parse.clean_title) for v in ('Письмо "Шар: чертёж", 2-й вариант', "Отчёт (копия). Вид материала: отчёт")] == ["шар чертеж", "отчет копия"]
    keys = [tuple(spark.createDataFrame([(v,)], "v string").select(*parse.order_keys(F.col("v")).values()).first()) for v in ("2", "145", "145а", "146")]
    assert sorted(range(4), key=lambda i: keys[i][0]) == [0, 1, 3, 2] and sorted(range(4), key=lambda i: keys[i][1]) == [0, 1, 2, 3]


def test_page_fields(spark):
    html = '<div>Название:  "Шар &amp; <b>диск</b>"  Крайние даты: 1911</div><a href="/CArchive/pageimages/314\\4_0144а/002.jpg"><img src=\'/CArchive/pageimages/314\\4_0144а/001.JPG\'><a href="/CArchive/pageimages/314\\4_0144а/002.jpg">'
    df = spark.createDataFrame([(html,), ("<p>нет</p>",), (None,)], "h string").select(*(c.alias(k) for k, c in parse.page_fields(F.col("h")).items()))
    a, b, c = df.collect()
    assert (a.name, a.opis_code, a.delo_no) == ("Шар &amp; диск", "4", "0144а") and a.links == ["/pageimages/314%5C4_0144а/002.jpg", "/pageimages/314%5C4_0144а/001.JPG"]
    assert (b.name, b.opis_code, b.links) == ("", None, []) and c.links is None


def test_small_predicates_and_formats(spark):
    df = spark.createDataFrame([("12", 1234567, 1, 8), ("1а", 5, 0, 0), ("", None, 3, 8), (None, 0, None, 8)], "t string, n bigint, a int, b int")
    got = df.select(parse.is_number(F.col("t")), parse.thousands(F.col("n")), parse.percent(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, "1,234,567", "12%"), (False, "5", None), (False, None, "38%"), (False, "0", None)]
    titles = spark.createDataFrame([("О РАКЕТЕ", "On a rocket"), ("Письмо", "Письмо"), ("Вне  Земли", ""), (None, None)], "r string, e string")
    got = titles.select(parse.on_topic(F.col("r")), parse.has_all(F.col("r"), "П", "сьмо"), parse.translated(F.col("r"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (False, True, False), (True, False, False), (False, False, False)]
    both = spark.createDataFrame([("a " * 30, "x"), ("a b", "x"), (None, "x")], "a string, b string")
    assert [r[0][:1] for r in both.select(parse.first_long_enough(F.col("a"), F.col("b"))).collect()] == ["a", "x", "x"]


def test_blocks_and_entities(spark):
    html = 'a<script>x</script> <span class="pagenum q">7</span>&#1041;&#x42F;&nbsp;&amp;lt; <sup id="k" class="reference">[1]</sup>b<table><tr>t</table>'
    assert one(spark, html, text.strip_blocks) == "a БЯ &lt; b" and one(spark, None, text.strip_blocks) is None


def test_index_leaves_field_lines_out(spark):
    assert one(spark, "**Название:** рецензия\nтекст ёлка\n> легенда\n## Лист 1", text.index_terms) == ["текст", "елка"]
