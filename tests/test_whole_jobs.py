"""Queries that must do their whole job: every row that holds a case, whatever else the row holds."""

import datetime as dt

from papyrine.operators import corpus
from papyrine.plans import queries as core


def test_year_range_reads_every_text(spark, rows, tmp_path):
    texts = ["март 1932 г.", "[1925-1926 гг.]", "1911, 1913", "Крайние даты: 5.06.1901 (10:30)", "1899", "в1925г", "без даты", None]
    spark.createDataFrame(list(enumerate(texts)), "portal_id int, dates_raw string").write.parquet(str(tmp_path / "delo_dates.parquet"))
    got = {r.portal_id: (r.year_from, r.year_to, r.bracketed) for r in core.queries()["year_range"](spark, str(tmp_path)).collect()}
    assert got == {0: (1932, 1932, False), 1: (1925, 1926, True), 2: (1911, 1913, False), 3: (1901, 1901, False), 4: (1899, 1899, False), 5: (None, None, False), 6: (None, None, False)}


def test_file_documents_are_whole_and_headed(spark):
    at = [dt.datetime(2025, 1, d) for d in range(1, 4)]
    readings = [
        (1, "1", "0144", "001", "done", at[0], "старое"), (2, "1", "0144", "001", "done", at[1], "первый"), (3, "1", "0144", "001", "done", at[2], None),
        (4, "1", "0144", "002", "done", at[0], None), (5, "1", "0144", "003", "done", at[0], " \n"), (6, "1", "0144", "500", "done", at[0], "последний"),
        (6, "1", "0144", "500", "done", at[0], "последний"), (7, "2", "0007", "001", "done", at[0], "есть"), (8, "2", "0007", "002", "failed", at[0], None),
        (9, "3", "0008", "001", "done", at[0], "без карточки"),
    ]
    name = 'Письмо "Шар" Вид материала: письмо Способ воспроизведения: копия Крайние даты: 1925 г.'
    cards = [("Опись 1", "1", "0144", 5, name, at[1]), ("Опись 1", "1", "0144", 5, "Старое", at[0]), ("Опись 2", "2", "0007", 6, None, at[0])]
    r = spark.createDataFrame(readings, "reading_id bigint, opis_code string, delo string, page string, status string, read_at timestamp, text string")
    k = spark.createDataFrame(cards, "opis string, opis_code string, delo string, portal_id int, name string, fetched_at timestamp")
    got = {(x.opis_code, x.delo, x.volume): x for x in corpus.file_documents(r, k).collect()}
    assert set(got) == {("1", "0144", 0), ("1", "0144", 1), ("3", "0008", 0)}
    first, second, bare = (got[k] for k in sorted(got))
    assert first.portal_id == 5 and first.sheets == 3 and second.sheets == 1 and bare.portal_id is None
    head, body = first.document.split("\n\n---\n\n", 1)
    assert head.startswith('# Опись 1, дело 144\n\n**Название:** Письмо "Шар"\n**Вид материала:** письмо\n**Способ воспроизведения:** копия\n**Крайние даты:** 1925 г\n**Сканов:** 4\n**Источник:** карточка 5\n')
    assert body == "## Лист 001\n\nпервый\n\n---\n\n## Лист 002\n\n[не получено]\n\n---\n\n## Лист 003\n\n[пустой лист]"
    assert bare.document.startswith("# Опись 3, дело 8\n") and bare.document.endswith("## Лист 001\n\nбез карточки")
    assert corpus.file_documents(r.limit(0), k).count() == 0


def test_every_published_title_is_searched(spark, tmp_path):
    day = dt.datetime(2025, 1, 1)
    save = lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    ids = [19, 20, 21, 33]
    save("title_en", [(i, f'Письмо "шар номер {i}"') for i in ids], "portal_id int, title_ru string")
    save("catalog", [(i, f'Письмо "шар номер {i}" Вид материала: письмо', 1, "ok", day) for i in ids], "portal_id int, name string, pages int, status string, fetched_at timestamp")
    text = "шар поднимается над полем и летит далеко за реку"
    save("documents", [(i, i, text) for i in ids], "doc_id bigint, portal_id int, text string")
    got = {r.published: (r.file, r.title_match) for r in core.queries()["best_titles"](spark, str(tmp_path)).collect()}
    assert got == {i: (i, 1.0) for i in ids}
    assert [tuple(r) for r in core.queries()["corpus_validation"](spark, str(tmp_path)).collect()] == [(True, 4, 1.0, 1.0)]
