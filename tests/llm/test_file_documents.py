"""Files as documents, their cards' addresses brought into one form first."""

import datetime as dt

from papyrine.llm import queries as llm


def test_file_documents_are_whole_and_headed(spark, tmp_path):
    at = [dt.datetime(2025, 1, d) for d in range(1, 4)]
    readings = [
        (1, "1", "0144", "001", "done", at[0], "старое"), (2, "1", "0144", "001", "done", at[1], "первый"), (3, "1", "0144", "001", "done", at[2], None),
        (4, "1", "0144", "002", "done", at[0], None), (5, "1", "0144", "003", "done", at[0], " \n"), (6, "1", "0144", "500", "done", at[0], "последний"),
        (6, "1", "0144", "500", "done", at[0], "последний"), (7, "2", "0007", "001", "done", at[0], "есть"), (8, "2", "0007", "002", "failed", at[0], None),
        (9, "3", "0008", "001", "done", at[0], "без карточки"),
    ]
    name = 'Письмо "Шар" Вид материала: письмо Способ воспроизведения: копия Крайние даты: 1925 г.'
    cards = [("Опись 1", "l", "O144", 5, name, at[1]), ("Опись 1", "1", "0144", 5, "Старое", at[0]), ("Опись 2", "2", "0007", 6, None, at[0])]
    spark.createDataFrame(readings, "reading_id bigint, opis_code string, delo string, page string, status string, read_at timestamp, text string").write.parquet(str(tmp_path / "transcripts_raw.parquet"))
    spark.createDataFrame(cards, "opis string, opis_code string, delo string, portal_id int, name string, fetched_at timestamp").write.parquet(str(tmp_path / "catalog.parquet"))
    got = {(r.opis_code, r.delo, r.volume): r for r in llm.queries()["file_documents"](spark, str(tmp_path)).collect()}
    assert set(got) == {("1", "0144", 0), ("1", "0144", 1), ("3", "0008", 0)}
    first, second, bare = (got[k] for k in sorted(got))
    assert first.portal_id == 5 and first.sheets == 3 and second.sheets == 1 and bare.portal_id is None
    head, body = first.document.split("\n\n---\n\n", 1)
    assert head.startswith('# Опись 1, дело 144\n\n**Название:** Письмо "Шар"\n**Вид материала:** письмо\n**Способ воспроизведения:** копия\n**Крайние даты:** 1925 г\n**Сканов:** 4\n**Источник:** карточка 5\n')
    assert body == "## Лист 001\n\nпервый\n\n---\n\n## Лист 002\n\n[не получено]\n\n---\n\n## Лист 003\n\n[пустой лист]"
    assert bare.document.startswith("# Опись 3, дело 8\n") and bare.document.endswith("## Лист 001\n\nбез карточки")
