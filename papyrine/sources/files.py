"""File sources and sinks: CSV, JSON, JSON lines, text trees, scan listings; keyed rewriting and sharded output."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.parse import corpus_path, scan_path
from papyrine.operators.sequence import latest, prefix_by_budget
from papyrine.session import cut


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header by an explicit schema (no inference: numbers keep their zeros); a missing file is an
    empty table, an empty value null."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The items of a JSON document {items: [...]}, the place of each as ``id``."""
    df = spark.read.schema(f"items array<{item}>").option("multiLine", True).json(path)
    return df.select(F.posexplode("items").alias("id", "item")).select("id", "item.*")


REPLY = "key string, response struct<candidates:array<struct<finishReason:string,content:struct<parts:array<struct<text:string>>>>>>"


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """(key, finish, text) of JSON lines of replies; missing levels give nulls, the parts of a text are joined."""
    df = spark.read.schema(REPLY).json(path)
    first = F.try_element_at(F.col("response.candidates"), F.lit(1))
    parts = F.transform(first["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit("")))
    return df.select("key", first["finishReason"].alias("finish"), F.array_join(parts, "").alias("text"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text) of a tree of text files, whole."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, size, changed) of a tree of files; their content is not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(opis_code, delo, text) of a tree of Markdown documents, opis_X/delo_NNNN.md each."""
    return read_texts(spark, path, "*.md").select(*(c.alias(k) for k, c in corpus_path(F.col("path")).items()), "text")


def already_done(spark: SparkSession, path: str) -> DataFrame:
    """(path): the scans whose sheet stands in a tree of texts (opis_X/delo_NNNN/PPP.txt), from its listing alone."""
    sheets = list_files(spark, path, "*.txt").filter("size > 0")
    page = F.regexp_extract("path", r"/([^/]+)\.txt$", 1)
    return sheets.withColumns(corpus_path(F.col("path"))).filter("opis_code is not null").select(scan_path(F.col("opis_code"), F.col("delo"), page).alias("path")).distinct()


def split_reply(text: Column) -> Column:
    """The parts of a reply set off by '=== NAME ===' lines, as an array of (name, body)."""
    head = r"(?m)^=== (.+?) ===\s*$"
    names = F.regexp_extract_all(text, F.lit(head), F.lit(1))
    bodies = F.transform(F.slice(F.split(text, head, -1), F.lit(2), F.size(names)), lambda b: F.trim(b))
    return F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), F.trim(b, F.lit("\n ")).alias("body")))


def numbered_lines(text: Column) -> Column:
    """A reply of numbered lines as an array in order; null unless the numbers are exactly 1 to n."""
    kept = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\d+[.)]\s*\S"))
    numbers = F.transform(kept, lambda x: F.regexp_extract(x, r"^\s*(\d+)", 1).try_cast("int"))
    values = F.transform(kept, lambda x: F.regexp_extract(x, r"^\s*\d+[.)]\s*(.+?)\s*$", 1))
    return F.when((F.size(kept) > 0) & (numbers == F.sequence(F.lit(1), F.greatest(F.size(kept), F.lit(1)))), values)


#: The column by which keyed tables are divided into folders.
PART = "papyrine_part"


class KeyedTable:
    """A Parquet table with one row for each key, the last by ``order``, in hashed parts, each in a folder of versions.

    ``upsert`` rewrites only the parts that hold keys of the new rows. A version of a part is written under a name of its
    own and counts once its ``_SUCCESS`` is there; readers take the newest version that counts. So a run that dies
    at any point leaves each part as it was, or renewed, and running it again renews the rest. Older versions than the
    one before the newest are removed. One writer at a time.

    Rows of equal key and order count as delivered twice; of different rows with an equal order any one is kept. A row
    without an order is older than every other. The old rows of a key take part: a late older row does not win.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, parts: int = 64):
        self.spark, self.path, self.keys, self.order, self.parts = spark, path, list(keys), order, parts
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, str]]:
        """(version, folder) of those that count, the newest first."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        found = [(int(n[1:]), f"{self.path}/{n}") for n in names if n[:1] == "v" and n[1:].isdigit()]
        return sorted((x for x in found if exists(self.spark, f"{x[1]}/_SUCCESS")), reverse=True)

    def _where(self) -> dict[int, str]:
        """The folder in which each part stands, in the newest version that has it."""
        where: dict[int, str] = {}
        for _, folder in self._versions():
            for status in self._fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder)):
                name = status.getPath().getName()
                if name.startswith(f"{PART}="):
                    where.setdefault(int(name[len(PART) + 1 :]), f"{folder}/{name}")
        return where

    def read(self) -> DataFrame | None:
        """The table, or null if nothing was ever written."""
        where = self._where()
        return self.spark.read.parquet(*where.values()) if where else None

    def upsert(self, new: DataFrame) -> DataFrame:
        if PART in new.columns:
            raise ValueError(f"a keyed table has no column {PART}")
        number = F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")
        fresh = cut(new.withColumn(PART, number))
        touched = {r[0] for r in fresh.select(PART).distinct().collect()}  # at most ``parts``
        where = self._where()
        old = [p for k, p in where.items() if k in touched]
        merged = fresh
        if old:
            merged = fresh.unionByName(self.spark.read.parquet(*old).withColumn(PART, number))
        if touched:
            versions = self._versions()
            version = f"{self.path}/v{(versions[0][0] if versions else 0) + 1:010d}"
            last = latest(merged, self.keys, F.col(self.order).desc_nulls_last())
            last.repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(version)
            self._remove_old()
        return self.read() if where or touched else new.limit(0)

    def _remove_old(self) -> None:
        versions = self._versions()
        used = {p.rsplit("/", 1)[0] for p in self._where().values()} | {folder for _, folder in versions[:2]}
        for _, folder in versions:
            if folder not in used:
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def rewrite_keyed(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The keyed table at ``path`` after an upsert of ``new``: of all rows of a key, old and new, the last by ``order``."""
    return KeyedTable(spark, path, keys, order).upsert(new)


def append_new(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows whose key the Parquet table at ``path`` does not have yet, so that a run that was broken off can be
    started again. Of rows of one key in ``rows`` any one is added; a null key is a key like any other."""
    new = rows.dropDuplicates(keys)
    if exists(spark, path):
        have = spark.read.parquet(path).select(*(F.col(k).alias(f"__{k}") for k in keys))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        new = new.join(have, same, "left_anti")
    cut(new).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV table with a header, nulls as empty values; Spark's commit leaves the old table or the new one."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, escape='"', emptyValue="", **spaces).csv(path)


def write_json_document(df: DataFrame, path: str, **header: str) -> None:
    """One JSON document {header..., items: [...]} of a table that fits one value, such as a queue or an export."""
    head = [F.lit(v).alias(k) for k, v in header.items()]
    df.agg(F.collect_list(F.struct(*df.columns)).alias("items")).select(F.to_json(F.struct(*head, "items")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str, keys: list[str], order: list[str], budget: int) -> DataFrame:
    """JSON lines of the rows of each key up to a budget of bytes; returns the rows written, with their ``bytes``.

    Lines are taken in ``order`` until the first that would pass the budget; the first one is always written."""
    lines = df.withColumn("__line", F.to_json(F.struct(*df.columns))).withColumn("bytes", F.octet_length("__line") + 1)
    kept = cut(prefix_by_budget(lines, keys, order, F.col("bytes"), budget))
    kept.select(*keys, F.col("__line").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)
    return kept.drop("__line", "running")


def write_texts(df: DataFrame, path: str, folders: list[str], text: str) -> None:
    """Texts by folder (inventory and file, say), many in one file: one line of JSON for each, so that millions of
    sheets are not millions of files."""
    rest = [c for c in df.columns if c not in folders]
    assert text in rest
    df.select(*folders, F.to_json(F.struct(*rest)).alias("value")).write.mode("overwrite").partitionBy(*folders).text(path)


def backup_if_absent(spark: SparkSession, path: str, backup: str) -> bool:
    """Copies a table once: the first state is kept, whatever is written later. Whether it was copied now."""
    if exists(spark, f"{backup}/_SUCCESS") or not exists(spark, path):
        return False
    spark.read.parquet(path).write.mode("overwrite").parquet(backup)
    return True


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, content) of a tree of images, decoded to grey levels, one byte a pixel; files that are no
    readable image have nulls."""
    image = spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.*")

    @F.pandas_udf("binary")
    def grey(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for h, w, n, d in zip(height, width, channels, data, strict=True):
            if h is None or h <= 0 or n not in (1, 3, 4):
                out.append(None)
                continue
            pixels = np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(n)).astype(float)
            # blue, green, red, by their share of luminance
            level = pixels[:, :, 0] if n == 1 else pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])
            out.append(np.clip(np.rint(level), 0, 255).astype(np.uint8).tobytes())
        return pd.Series(out, dtype=object)

    ok = F.col("height") > 0
    return image.select(F.col("origin").alias("path"), F.when(ok, F.col("height")).alias("height"), F.when(ok, F.col("width")).alias("width"), grey("height", "width", "nChannels", "data").alias("content"))


def write_shards(df: DataFrame, path: str, shard: str) -> None:
    """A table in one folder for each shard; only the shards that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)


def as_json_document(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON text for each row: an array of the row's values in the order of ``columns``, as a compact table has them."""
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(F.regexp_replace(F.to_json(F.array(F.col(c))), r"^\[|\]$", ""), F.lit("null")) for c in columns)), F.lit("]")).alias("row"))
