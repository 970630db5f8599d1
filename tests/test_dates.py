import pytest

from papyrine.operators import dates

CASES = [
    ("19.10.1920", "1920-10-19", "1920-10-19", False),
    ("1914-11-17", "1914-11-17", "1914-11-17", False),
    ("25/10/1922", "1922-10-25", "1922-10-25", False),
    ("18.II.1923", "1923-02-18", "1923-02-18", False),
    ("21 Августа 1918 года", "1918-08-21", "1918-08-21", False),
    ("16 Apr 1902", "1902-04-16", "1902-04-16", False),
    ("1906, апр. 28", "1906-04-28", "1906-04-28", False),
    ("1929, август", "1929-08-01", "1929-08-31", False),
    ("февраль 1916 г.", "1916-02-01", "1916-02-29", False),
    ("03.1899", "1899-03-01", "1899-03-31", False),
    ("1932-07", "1932-07-01", "1932-07-31", False),
    ("1904-07 гг.", "1904-01-01", "1907-12-31", False),
    ("1899–02 гг.", "1899-01-01", "1902-12-31", False),
    ("1920-е гг.", "1920-01-01", "1929-12-31", False),
    ("2-я пол. 1921 г.", "1921-07-01", "1921-12-31", False),
    ("III кв. 1899 г.", "1899-07-01", "1899-09-30", False),
    ("май-июль 1908 г.", "1908-05-01", "1908-07-31", False),
    ("22—26 января 1917 г.", "1917-01-22", "1917-01-26", False),
    ("31.VIII–7.IX.1927", "1927-08-31", "1927-09-07", False),
    ("с 23.09.1924 по 10.10.1925", "1924-09-23", "1925-10-10", False),
    ("декабрь 1895 г. - 26.01.1896", "1895-12-01", "1896-01-26", False),
    ("23.10.1881 ст. ст.", "1881-11-04", "1881-11-04", False),
    ("29.02.1900 ст. ст.", "1900-03-13", "1900-03-13", False),
    ("30.03.1885 н. ст.", "1885-03-30", "1885-03-30", False),
    ("9/21 октября 1895", "1895-10-21", "1895-10-21", False),
    ("25 (7) ноября 1917 г.", "1917-11-07", "1917-11-07", False),
    ("27.08 (9.09).1908", "1908-09-09", "1908-09-09", False),
    ("25.12 (7.01).1908", "1909-01-07", "1909-01-07", False),
    ("1933-09-25T05:21:00Z", "1933-09-25T05:21:00Z", "1933-09-25T05:21:00Z", False),
    ("25.12.1935 14:30 МСК", "1935-12-25T11:30:00Z", "1935-12-25T11:30:00Z", False),
    ("1.01.1932, 1 ч. 05 мин.", "1931-12-31T22:05:00Z", "1931-12-31T22:05:00Z", False),
    ("11.2.1934, 14 Uhr 34 MEZ", "1934-02-11T13:34:00Z", "1934-02-11T13:34:00Z", False),
    ("Jun 16, 1933 12:50 AM EDT", "1933-06-16T04:50:00Z", "1933-06-16T04:50:00Z", False),
    ("1935-02-09T12:43:00+05:30", "1935-02-09T07:13:00Z", "1935-02-09T07:13:00Z", False),
    ("[19 Feb 1927?]", "1927-02-19", "1927-02-19", True),
    ("ок. Май 1914", "1914-05-01", "1914-05-31", True),
    ("1908 год (датируется по содержанию)", "1908-01-01", "1908-12-31", True),
    (" 19\xa0марта 1922 г. ", "1922-03-19", "1922-03-19", False),
    ("31.02.1920", None, None, False),
    ("без даты", None, None, False),
    ("", None, None, False),
    (None, None, None, False),
]


@pytest.mark.parametrize("raw,starts,ends,marked", CASES)
def test_parse(raw, starts, ends, marked):
    assert dates.parse_dates(raw)[:3] == (starts, ends, marked)


def test_old_style_matches_the_calendar_shift():
    for year, shift in ((1850, 12), (1910, 13), (1700, 11)):
        assert (dates.julian(year, 3, 2) - __import__("datetime").date(year, 3, 2)).days == shift
    with pytest.raises(ValueError):
        dates.julian(1901, 2, 29)


def test_region_by_its_own_rules_and_dictionary_grows(spark, tmp_path):
    df = spark.createDataFrame([(1, "1932-07-05 12:01 America/New_York", None), (2, "1932-11-05 12:01 America/New_York", True)], "portal_id int, dates_raw string, conjectural boolean")
    got = {r.portal_id: (r.starts, r.conj) for r in dates.dated_cards(df, str(tmp_path)).collect()}
    assert got == {1: ("1932-07-05T16:01:00Z", 0), 2: ("1932-11-05T17:01:00Z", 1)}
    dictionary = dates.DateDictionary(spark, str(tmp_path))
    assert dictionary.read().count() == 2
    dates.dated_cards(df.unionByName(spark.createDataFrame([(3, "1909", False)], df.schema)), str(tmp_path))
    assert dictionary.read().count() == 3


def test_nulls_duplicates_and_clashing_names(spark, tmp_path, rows):
    schema = "portal_id int, dates_raw string, conjectural boolean, starts string, marked string, raw string, source string"
    data = [(1, "1909", None, "x", "y", "z", "s"), (1, "1909", None, "x", "y", "z", "s"), (2, None, True, "x", None, None, None), (None, "1910", None, None, None, None, None)]
    df = spark.createDataFrame(data, schema)
    assert rows(dates.dated_cards(df, str(tmp_path))) == [(1, "1909-01-01", "1909-12-31", 0)]
    kept = dates.with_dates(df, folder=str(tmp_path))
    assert kept.count() == 4 and {"marked", "raw", "source"} <= set(kept.columns)
    assert dates.dated_cards(df.limit(0), str(tmp_path)).count() == 0


def test_dictionary_is_in_parts_and_grows_only_by_what_is_new(spark, tmp_path):
    import glob

    df = spark.createDataFrame([(1, "1909", None), (2, "1910", None)], "portal_id int, dates_raw string, conjectural boolean")
    files = lambda: glob.glob(f"{tmp_path}/*/part=*/*.parquet")
    dates.with_dates(df, source="a", folder=str(tmp_path)).count()
    before = len(files())
    dates.with_dates(df, source="a", folder=str(tmp_path)).count()
    assert len(files()) == before
    dates.with_dates(df, source="b", zone="UTC", folder=str(tmp_path)).count()
    dictionary = dates.DateDictionary(spark, str(tmp_path))
    assert dictionary.read().count() == 4 and dictionary.read("a", "МСК").count() == 2 and dictionary.read("none", "UTC").count() == 0
    dates.with_dates(df.unionByName(spark.createDataFrame([(3, "1911", None)], df.schema)), source="a", folder=str(tmp_path)).count()
    dictionary.compact()
    assert len(files()) == 2 and dictionary.read().count() == 5
