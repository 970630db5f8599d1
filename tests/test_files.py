import json
import uuid

from pyspark.sql import functions as F

from papyrine.sources import files
from papyrine.streaming import sheets


def test_readers(spark, tmp_path, rows):
    (tmp_path / "c.csv").write_text("delo,name\n0033,\n0585а,\"a, b\"\n")
    assert rows(files.read_csv(spark, str(tmp_path / "c.csv"), "delo string, name string")) == [("0033", None), ("0585а", "a, b")]
    assert files.read_csv(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    (tmp_path / "q.json").write_text(json.dumps({"items": [{"page": "1"}, {"page": "2"}]}, indent=1))
    assert rows(files.read_items(spark, str(tmp_path / "q.json"), "struct<page:string>")) == [(0, "1"), (1, "2")]
    reply = {"key": "7", "response": {"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": "a"}, {}, {"text": "b"}]}}]}}
    (tmp_path / "r.jsonl").write_text(json.dumps(reply) + "\n" + json.dumps({"key": "8"}) + "\n")
    assert rows(files.read_replies(spark, str(tmp_path / "r.jsonl"))) == [("7", "STOP", "ab"), ("8", None, None)]
    (tmp_path / "t" / "x").mkdir(parents=True)
    (tmp_path / "t" / "x" / "001.txt").write_text("a\nb")
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "t")).collect()] == ["a\nb"]
    (tmp_path / "c" / "opis_1а" / "delo_0007").mkdir(parents=True)
    (tmp_path / "c" / "opis_1а" / "delo_0007.md").write_text("# Дело")
    (tmp_path / "c" / "opis_1а" / "delo_0007" / "002.txt").write_text("б")
    (tmp_path / "c" / "opis_1а" / "delo_0007" / "003.txt").write_text("")
    assert rows(files.read_corpus(spark, str(tmp_path / "c"))) == [("1а", "0007", "# Дело")]
    assert rows(files.already_done(spark, str(tmp_path / "c"))) == [("data/opis_1а/delo_0007/002.jpg",)]
    assert files.list_files(spark, str(tmp_path / "t"), "*.txt").select("size").first()[0] == 3


def test_replies(spark):
    df = spark.createDataFrame([("=== a ===\nx\n=== b ===\ny\nz\n", "1. один\n2) два"), ("none", "1. a\n3. b"), (None, None)], "r string, n string")
    got = df.select(files.split_reply(F.col("r")), files.numbered_lines(F.col("n"))).collect()
    assert [tuple(x) for x in got[0][0]] == [("a", "x"), ("b", "y\nz")] and got[1][0] == [] and got[0][1] == ["один", "два"] and got[1][1] is None and got[2][1] is None


def test_rewrite_shards_and_stream(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    make = lambda data: spark.createDataFrame(data, "k int, v string, at int")
    files.rewrite_keyed(spark, path, make([(1, "a", 1), (2, "b", 1)]), ["k"], "at")
    assert rows(files.rewrite_keyed(spark, path, make([(2, "c", 2), (2, "d", 3)]), ["k"], "at")) == [(1, "a", 1), (2, "d", 3)]
    files.write_shards(make([(1, "a", 1), (2, "b", 1)]), str(tmp_path / "s"), "k")
    files.write_shards(make([(2, "z", 1)]), str(tmp_path / "s"), "k")
    assert rows(spark.read.parquet(str(tmp_path / "s")).select("v")) == [("a",), ("z",)]
    assert files.as_json_document(make([(1, 'q"', None)]), ["k", "v", "at"]).first()[0] in ('[1,"q\\"",null]', '["1","q\\"",null]')
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    name = f"test-{uuid.uuid4().hex}"  # progress is kept by name in the shared folder, which outlives a session
    for batch in ([(1, "a", 1)], [(1, "b", 2), (3, "c", 1)]):
        make(batch).write.mode("append").parquet(source)
        sheets.ingest(spark, source, "k int, v string, at int", table, ["k"], "at", name).awaitTermination()
    assert rows(files.KeyedTable(spark, table, ["k"], "at").read()) == [(1, "b", 2), (3, "c", 1)]


def _make(spark, data):
    return spark.createDataFrame(data, "k int, v string, at int")


def test_late_older_rows_do_not_win(spark, tmp_path, rows):
    table = files.KeyedTable(spark, str(tmp_path / "t"), ["k"], "at", parts=4)
    assert table.read() is None
    table.upsert(_make(spark, [(1, "new", 5), (2, "b", 1), (None, "n", 1)]))
    assert rows(table.upsert(_make(spark, [(1, "old", 2), (1, "none", None), (None, "m", 2)]))) == [(1, "new", 5), (2, "b", 1), (None, "m", 2)]
    assert rows(table.upsert(_make(spark, []))) == [(1, "new", 5), (2, "b", 1), (None, "m", 2)]


def test_keyed_table_keeps_other_columns(spark, tmp_path, rows):
    """Columns named like helpers stay; the one name that is taken is refused."""
    import pytest

    df = spark.createDataFrame([(1, "a", 1, 7)], "k int, _rn string, at int, part_no int")
    table = files.KeyedTable(spark, str(tmp_path / "t"), ["k"], "at")
    assert sorted(table.upsert(df).columns) == ["_rn", "at", "k", "part_no"]
    with pytest.raises(ValueError):
        table.upsert(df.withColumnRenamed("part_no", files.PART))


def test_a_run_that_dies_leaves_the_table(spark, tmp_path, rows):
    import os
    import shutil

    path = str(tmp_path / "t")
    table = files.KeyedTable(spark, path, ["k"], "at", parts=4)
    table.upsert(_make(spark, [(k, "a", 1) for k in range(8)]))
    before = rows(table.read())
    table.upsert(_make(spark, [(k, "b", 2) for k in range(8)]))
    newest = sorted(n for n in os.listdir(path) if n.startswith("v"))[-1]
    # a version whose writing did not end: no mark of success, parts missing
    os.remove(f"{path}/{newest}/_SUCCESS")
    shutil.rmtree(next(f"{path}/{newest}/{n}" for n in os.listdir(f"{path}/{newest}") if n.startswith(files.PART)))
    assert rows(table.read()) == before
    assert rows(table.upsert(_make(spark, [(k, "b", 2) for k in range(8)]))) == [(k, "b", 2) for k in range(8)]


def test_only_touched_parts_are_written(spark, tmp_path):
    import os

    path = str(tmp_path / "t")
    table = files.KeyedTable(spark, path, ["k"], "at", parts=16)
    for at in range(5):
        table.upsert(_make(spark, [(k, "a", at) for k in (range(50) if at == 0 else [7])]))
    versions = sorted(n for n in os.listdir(path) if n.startswith("v"))
    parts = lambda v: sum(n.startswith(files.PART) for n in os.listdir(f"{path}/{v}"))
    assert parts(versions[0]) > 8 and parts(versions[-1]) == 1 and len(versions) == 3 and table.read().count() == 50


def test_sinks(spark, tmp_path, rows):
    path = lambda n: str(tmp_path / n)
    df = _make(spark, [(1, "a", 1), (2, 'b "q", c', None)])
    assert files.append_new(spark, path("a"), df, ["k"]).count() == 2
    assert rows(files.append_new(spark, path("a"), _make(spark, [(2, "x", 9), (3, "c", 1), (3, "c", 1), (None, "n", 1)]), ["k"]).select("k")) == [(1,), (2,), (3,), (None,)]
    assert files.append_new(spark, path("a"), _make(spark, [(None, "n", 1)]), ["k"]).count() == 4
    files.write_csv(df, path("c"))
    assert rows(files.read_csv(spark, path("c"), "k int, v string, at int")) == rows(df)
    files.write_json_document(df, path("j"), fond="314")
    assert json.loads(spark.read.text(path("j")).first()[0]) == {"fond": "314", "items": [{"k": 1, "v": "a", "at": 1}, {"k": 2, "v": 'b "q", c'}]}
    lines = spark.createDataFrame([("m", i, "x" * 10) for i in range(10)] + [("n", 1, "y" * 500)], "model string, i int, t string")
    written = files.write_json_lines(lines, path("l"), ["model"], ["i"], 100)
    assert sorted((r.model, r.i) for r in written.collect()) == [("m", 0), ("m", 1), ("n", 1)] and spark.read.text(path("l")).count() == 3
    files.write_texts(lines, path("s"), ["model"], "t")
    assert spark.read.text(path("s")).filter("model = 'm'").count() == 10
    assert files.backup_if_absent(spark, path("a"), path("b")) and not files.backup_if_absent(spark, path("a"), path("b")) and not files.backup_if_absent(spark, path("none"), path("z"))
    assert spark.read.parquet(path("b")).count() == 4


def test_images_are_decoded(spark, tmp_path):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rgb = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)]
    raw = b"".join(b"\0" + bytes(rgb[2 * y]) + bytes(rgb[2 * y + 1]) for y in range(2))
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "001.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (tmp_path / "x" / "002.jpg").write_bytes(b"no image")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_images(spark, str(tmp_path / "x")).collect()}
    assert (got["001.png"].height, got["001.png"].width, list(got["001.png"].content)) == (2, 2, [76, 150, 29, 255])
    assert got["002.jpg"].height is None and got["002.jpg"].content is None
