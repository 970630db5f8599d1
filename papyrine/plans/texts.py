"""Named queries on text functions, replies, and sources and sinks: what is written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import parse, text
from papyrine.plans.registry import CARDS, WS, distinct, query
from papyrine.session import shared_dir
from papyrine.sources import files
from papyrine.sources.tables import table

_MARKS = "|".join(text.STRIPPED_MARKS)


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{WS}]+', ' ', 'g'), ' ')"


def _fold(c: str) -> str:
    plain = f"translate(regexp_replace(lower({c}), 'ъ(\\s|$)', '\\1', 'g'), '{text.FOLD_FROM}', '{text.FOLD_TO}')"
    return f"regexp_replace({plain}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}{WS}]', ' ', 'g')"


_CLEAN = _squeeze(
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '~~[^\\n]*?~~', ' ', 'g'), '\\[({_MARKS})[^\\]]*\\]', ' ', 'g'), '\\[неразборчиво[^\\]]*\\]', ' ', 'g'), '\\[\\?\\]', '', 'g')"
)
_READ = "r as (select distinct reading_id, text from transcripts_raw where text is not null)"


def _texts(spark, sf):
    return table(spark, sf, "transcripts_raw", "reading_id", "text").filter("text is not null")


@query(f"with {_READ} select reading_id, md5({_CLEAN}) clean from r")
def clean_markup(spark, sf):
    """Readings without editorial marks."""
    return _texts(spark, sf).select("reading_id", F.md5(text.clean_markup(F.col("text"))).alias("clean")).distinct()


@query(f"with {_READ} select reading_id, md5({_fold('text')}) folded from r")
def fold_orthography(spark, sf):
    return _texts(spark, sf).select("reading_id", F.md5(text.fold_orthography(F.col("text"))).alias("folded")).distinct()


@query(f"with {_READ}, w as (select reading_id, list_filter(list_transform(string_split({_CLEAN}, ' '), lambda w: trim({_fold('w')}, ' ')), lambda w: w <> '') ws from r) select reading_id, len(ws) words, md5(array_to_string(ws, '|')) tokens from w")
def word_tokens(spark, sf):
    """Folded words of every reading, in order."""
    w = _texts(spark, sf).select("reading_id", text.word_tokens(F.col("text")).alias("ws"))
    return w.select("reading_id", F.size("ws").cast("bigint").alias("words"), F.md5(F.array_join("ws", "|")).alias("tokens")).distinct()


@query("select doc_id, len(regexp_extract_all(text, '\\(')) = len(regexp_extract_all(text, '\\)')) balanced from documents where text is not null")
def balanced_texts(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").filter("text is not null").select("doc_id", text.balanced(F.col("text"), "(", ")").alias("balanced"))


_HTML = """'<script type="x">' || status || '</script><h1>' || replace(name, '"', '&quot;') || '</h1> <sup class="reference">[1]</sup><table><tr>' || opis || '</table>&nbsp;&mdash; <b>' || delo || '</b>'"""


@query(f"""with {CARDS}, h as (select portal_id, {_HTML} html from c where name is not null) select portal_id, {_squeeze("regexp_replace(html, '<[^>]+>', ' ', 'g')")} stripped,
{_squeeze("replace(replace(replace(" + _squeeze("regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<table[^>]*>.*?</table>|<sup[^>]*reference[^>]*>.*?</sup>', ' ', 'g'), '<[^>]+>', ' ', 'g')") + ", '&nbsp;', ' '), '&quot;', '\"'), '&mdash;', '—')")} "plain" from h""")
def html_texts(spark, sf):
    """Pages in HTML made of cards, without their tags, and without what is no text."""
    from papyrine.plans.registry import cards

    h = cards(spark, sf).filter("name is not null").select("portal_id", F.expr(_HTML).alias("html"))
    return h.select("portal_id", text.strip_html(F.col("html")).alias("stripped"), text.strip_blocks(F.col("html")).alias("plain"))


@query("select distinct opis_code, replace(replace(url_encode('data/opis_' || opis_code || '/delo 1?x=ы'), '%2F', '/'), '%3F', '?') as partly, replace(replace(replace(url_encode('data/opis_' || opis_code || '/delo 1?x=ы'), '%2F', '/'), '%3F', '?'), '%3D', '=') encoded from transcripts_raw where opis_code is not null")
def encoded_paths(spark, sf):
    """Addresses as parts of a URL, with two sets of signs that stay."""
    path = F.concat(F.lit("data/opis_"), "opis_code", F.lit("/delo 1?x=ы"))
    d = distinct(spark, sf, "transcripts_raw", "opis_code").filter("opis_code is not null")
    return d.select("opis_code", parse.percent_encode(path, "/?").alias("partly"), parse.percent_encode(path).alias("encoded"))


@query("with f as (select opis_code, delo, min(page) a, max(page) b from transcripts_raw where page is not null group by 1, 2) select opis_code, delo, md5(array_to_string(list_transform(range(a::int, b::int + 1), lambda n: lpad(n::varchar, 3, '0')), ',')) pages, len(range(a::int, b::int + 1)) n from f")
def page_ranges(spark, sf):
    """All pages from the first to the last one that a file has."""
    f = table(spark, sf, "transcripts_raw", "opis_code", "delo", "page").filter("page is not null").groupBy("opis_code", "delo").agg(F.concat(F.min("page"), F.lit("-"), F.max("page")).alias("spec"))
    pages = parse.expand_pages(F.col("spec"))
    return f.select("opis_code", "delo", F.md5(F.array_join(pages, ",")).alias("pages"), F.size(pages).cast("bigint").alias("n"))


@query("with x as (select distinct reading_id, reading_id // 4 batch, path, trim(text, chr(10) || ' ') text from transcripts_raw where text is not null and path is not null and not contains(text, '===')), y as (select batch, unnest(list(struct_pack(name := path, body := text) order by reading_id)) part, unnest(range(1, count(*) + 1)) place from x group by batch) select batch, place, part.name as \"name\", md5(part.body) body from y")
def reply_split(spark, sf):
    """Replies of up to four sheets, set off by lines with their names, split again."""
    x = table(spark, sf, "transcripts_raw", "reading_id", "path", "text").filter("text is not null and path is not null and not contains(text, '===')").dropDuplicates(["reading_id"])
    x = x.select("reading_id", F.floor(F.col("reading_id") / 4).alias("batch"), F.concat(F.lit("=== "), "path", F.lit(" ===\n"), "text", F.lit("\n")).alias("part"))
    replies = x.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reading_id", "part"))), lambda p: p["part"]), "").alias("reply"))
    parts = replies.select("batch", F.posexplode(files.split_reply(F.col("reply"))).alias("i", "p"))
    return parts.select("batch", (F.col("i") + 1).cast("bigint").alias("place"), F.col("p.name").alias("name"), F.md5("p.body").alias("body"))


@query("with x as (select distinct portal_id, portal_id // 40 batch, title_en from title_en where title_en <> '' and portal_id is not null), y as (select *, row_number() over (partition by batch order by portal_id) n, count(*) over (partition by batch) size from x) select batch, count(*) lines, md5(string_agg(trim(title_en, ' '), '|' order by n)) body from y group by 1, size having size < 39")
def numbered_replies(spark, sf):
    """Numbered replies of up to forty lines read back; where a number is missing, the whole reply is refused. Batches of
    thirty-nine lines and more are sent without their first line, so they are."""
    x = distinct(spark, sf, "title_en", "portal_id", "title_en").filter("title_en <> '' and portal_id is not null").withColumn("batch", F.floor(F.col("portal_id") / 40))
    g = x.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("portal_id", "title_en"))).alias("xs"))
    lines = F.transform("xs", lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t["title_en"]))
    sent = F.when(F.size("xs") < 39, lines).otherwise(F.slice(lines, F.lit(2), F.size("xs")))
    got = g.select("batch", files.numbered_lines(F.array_join(sent, "\n")).alias("got")).filter("got is not null")
    return got.select("batch", F.size("got").cast("bigint").alias("lines"), F.md5(F.array_join("got", "|")).alias("body"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}"


_FIELDS = "portal_id int, opis_code string, delo string, name string, pages int, status string"


@query(f"with {CARDS} select portal_id, opis_code, delo, name, pages, status from c")
def csv_roundtrip(spark, sf):
    """The cards as a CSV table and back, by an explicit schema: zeros, quotes and commas stay."""
    from papyrine.plans.registry import cards

    path = _folder(spark)
    files.write_csv(cards(spark, sf).select(*(f.split()[0] for f in _FIELDS.split(", "))), path)
    return files.read_csv(spark, path, _FIELDS)


@query("select reading_id::varchar as key, case when text is null then null when status = 'done' then 'STOP' else 'MAX_TOKENS' end finish, case when text is not null then md5(text) end body from (select distinct reading_id, status, text from transcripts_raw)")
def reply_roundtrip(spark, sf):
    """Replies as JSON lines and back; one without a text has no candidate at all, and texts come in two parts."""
    r = table(spark, sf, "transcripts_raw", "reading_id", "status", "text").distinct()
    half = F.floor(F.length("text") / 2).cast("int")
    part = lambda c: F.struct(c.alias("text"))
    parts = F.array(part(F.substr("text", F.lit(1), half)), part(F.substr("text", half + 1)))
    candidate = F.struct(F.when(F.col("status") == "done", "STOP").otherwise("MAX_TOKENS").alias("finishReason"), F.struct(parts.alias("parts")).alias("content"))
    line = F.struct(F.col("reading_id").cast("string").alias("key"), F.struct(F.when(F.col("text").isNotNull(), F.array(candidate)).alias("candidates")).alias("response"))
    path = _folder(spark)
    r.select(F.to_json(line).alias("value")).write.text(path)
    return files.read_replies(spark, path).select("key", "finish", F.when(F.col("finish").isNotNull(), F.md5("text")).alias("body"))


def _late_first(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "catalog", "portal_id", "opis_code", "delo", "fetched_at").distinct()
    latest = c.groupBy("portal_id").agg(F.max("fetched_at").alias("fetched_at"))
    newest = c.join(latest, ["portal_id", "fetched_at"]).dropDuplicates(["portal_id"])
    return newest, c


@query("select portal_id, max(fetched_at) fetched_at from catalog group by 1")
def keyed_roundtrip(spark, sf):
    """A keyed table to which the newest states come first and all states after them: older rows do not win."""
    newest, everything = _late_first(spark, sf)
    path = _folder(spark)
    files.rewrite_keyed(spark, path, newest, ["portal_id"], "fetched_at")
    return files.rewrite_keyed(spark, path, everything, ["portal_id"], "fetched_at").select("portal_id", "fetched_at")


@query("select portal_id, count(*) n from (select portal_id from catalog union select portal_id from title_en) group by 1")
def append_roundtrip(spark, sf):
    """A table of the translated cards to which all cards are added: no key comes twice."""
    keys = distinct(spark, sf, "catalog", "portal_id")
    path = _folder(spark)
    files.append_new(spark, path, distinct(spark, sf, "title_en", "portal_id"), ["portal_id"])
    return files.append_new(spark, path, keys, ["portal_id"]).groupBy("portal_id").agg(F.count("*").alias("n"))


@query("select opis_code shard, count(*) n from (select distinct opis_code, portal_id from catalog where opis_code is not null) group by 1")
def shards_roundtrip(spark, sf):
    """A table in one folder for each inventory, of which some are replaced."""
    c = distinct(spark, sf, "catalog", "opis_code", "portal_id").filter("opis_code is not null").select(F.hex("opis_code").alias("shard"), "opis_code", "portal_id")
    path = _folder(spark)
    files.write_shards(c.unionByName(c), path, "shard")
    files.write_shards(c, path, "shard")
    return spark.read.parquet(path).groupBy(F.col("opis_code").alias("shard")).agg(F.count("*").alias("n"))


@query("with l as (select opis_code, reading_id, strlen(text) as size from (select distinct opis_code, reading_id, text from transcripts_raw where text is not null and opis_code is not null)) select opis_code, count(*) n from (select opis_code, reading_id, size, sum(size) over (partition by opis_code order by reading_id) running from l) where running <= 20000 or running = size group by 1")
def budget_files(spark, sf):
    """How many readings of each inventory fit a job file of twenty thousand bytes of text."""
    from papyrine.operators import sequence

    r = table(spark, sf, "transcripts_raw", "opis_code", "reading_id", "text").filter("text is not null and opis_code is not null")
    r = r.select("opis_code", "reading_id", F.octet_length("text").alias("size")).distinct()
    return sequence.prefix_by_budget(r, ["opis_code"], ["reading_id"], F.col("size"), 20_000).groupBy("opis_code").agg(F.count("*").alias("n"))
