"""Named queries on the catalogue: page parsing, titles, lists in order, vocabularies, totals and the report on dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import parse, text
from papyrine.functions.vocabulary import GLOSSES
from papyrine.operators import index, queue, sequence, stats
from papyrine.plans.queries import _VARIANTS, STARTS, TITLE_SQL, _pairs, starts, variants
from papyrine.plans.queries import _DOC_TERMS as DOC_TERMS
from papyrine.plans.queries import _PAIRS as PAIRS
from papyrine.plans.registry import CARDS, COUNT_WORDS, WS, cards, distinct, query
from papyrine.sources.tables import table

# A page in the shape of the portal's, made of a card: label, name, scans with one of them twice.
_HTML = """'<div><b>Название:</b>  "' || name || '" <i>Крайние даты</i></div><img src="/CArchive/pageimages/314\\' || opis_code || '_' || delo || '/001.jpg"><img src="/CArchive/pageimages/314\\' || opis_code || '_' || delo || '/002.JPG"><img src="/CArchive/pageimages/314\\' || opis_code || '_' || delo || '/001.jpg">'"""


@query(f"""with {CARDS}, h as (select portal_id, {_HTML} html from c where name is not null), x as (select portal_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[{WS}]+', ' ', 'g') t, list_distinct(regexp_extract_all(html, '(?i)/pageimages/[^"''> ]+?\\.jpg')) l, regexp_extract(html, '/pageimages/[^/\\\\ ]*\\\\([^/\\\\"''> ]+)/', 1) code from h)
select portal_id, trim(trim(trim(regexp_extract(t, 'Название: *(.+?)(?:Крайние даты|Количество (?:дел|листов)|Даты|$)', 1), ' '), '"'), ' ') "name", case when contains(code, '_') then string_split(code, '_')[1] end opis_code, case when contains(code, '_') then regexp_replace(code, '^[^_]*_', '') end delo_no, array_to_string(list_sort(list_transform(l, lambda x: replace(x, '\\', '%5C'))), ' ') links from x""")
def page_fields(spark, sf):
    html = F.expr(_HTML.replace("\\", "\\\\"))
    got = cards(spark, sf).filter("name is not null").select("portal_id", html.alias("html"))
    return got.select("portal_id", *(c.alias(k) for k, c in parse.page_fields(F.col("html")).items())).withColumn("links", F.array_join(F.array_sort("links"), " "))


@query(f"with {CARDS} select portal_id, 'https://archive.example/card/' || portal_id url from c")
def source_urls(spark, sf):
    return cards(spark, sf).select("portal_id", parse.source_url("https://archive.example/card", F.col("portal_id")).alias("url"))


_GLOSS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in GLOSSES["материал"].items()) + "}"


@query(f"select distinct material, array_to_string(list_transform(list_filter(list_transform(string_split(material, ','), lambda t: trim(t, ' ')), lambda t: t <> ''), lambda t: coalesce(map_extract({_GLOSS}, t)[1], map_extract({_GLOSS}, lower(t))[1], t)), ', ') gloss from delo_dates where material <> ''")
def vocabulary_map(spark, sf):
    """The values that occur, each once, with their gloss."""
    d = distinct(spark, sf, "delo_dates", "material").filter("material <> ''")
    return d.select("material", parse.gloss(F.col("material"), "материал").alias("gloss")).orderBy("material")


@query(f"with {CARDS} select opis_code, format('{{:,}}', count(*)) cards, format('{{:,}}', coalesce(sum(pages), 0)::bigint) pages, round_even(count_if(status = 'ok') * 100 / count(*), 0)::int || '%' complete from c group by 1")
def formatted_totals(spark, sf):
    g = cards(spark, sf).groupBy("opis_code").agg(F.count("*").alias("n"), F.coalesce(F.sum("pages"), F.lit(0)).alias("p"), F.count_if(F.col("status") == "ok").alias("ok"))
    return g.select("opis_code", parse.thousands(F.col("n")).alias("cards"), parse.thousands(F.col("p")).alias("pages"), parse.percent(F.col("ok"), F.col("n")).alias("complete"))


@query("select opis_code, count_if(coalesce(regexp_matches(delo, '^[0-9]+$'), false)) numbers, count_if(not coalesce(regexp_matches(delo, '^[0-9]+$'), false)) others from (select distinct portal_id, opis_code, delo from catalog) group by 1")
def valid_numbers(spark, sf):
    ok = parse.is_number(F.col("delo"))
    return distinct(spark, sf, "catalog", "portal_id", "opis_code", "delo").groupBy("opis_code").agg(F.count_if(ok).alias("numbers"), F.count_if(~ok).alias("others"))


_LABELS = "Вид материала:|Способ воспроизведения:|Языки:|Язык:|Крайние даты:"
_PRIORITY = f"""{CARDS}, p as (select portal_id, opis_code, delo, coalesce(pages, 0) pages, trim(regexp_split_to_array(name, '{_LABELS}')[1], ' .;') title from c), l as (select *, row_number() over (order by pages desc, portal_id) place from p where coalesce(regexp_matches(title, '(?i){parse.TOPICS}'), false))"""


def _priority(spark, sf):
    title = parse.name_fields(F.col("name"))["title"]
    listed = cards(spark, sf).select("portal_id", "opis_code", "delo", F.coalesce("pages", F.lit(0)).alias("pages"), title.alias("title")).filter(parse.on_topic(F.col("title")))
    # by falling number of pages, then by card
    return sequence.numbered(listed.withColumn("_down", -F.col("pages")), [], ["_down", "portal_id"], "place").drop("_down")


@query(f"with {_PRIORITY} select place, portal_id, pages, title from l")
def priority_list(spark, sf):
    """The cards on one of the topics, those with most pages first."""
    return _priority(spark, sf).select("place", "portal_id", "pages", "title").orderBy("place")


@query(f"with {_PRIORITY} select l.place, c.portal_id from l join c on c.opis_code = l.opis_code and regexp_replace(c.delo, '^0+(.)', '\\1') = regexp_replace(l.delo, '^0+(.)', '\\1')")
def priority_files(spark, sf):
    """The cards of each listed address, its number compared without zeros, in the order of the list."""
    listed = _priority(spark, sf).select("place", "opis_code", parse.strip_zeros(F.col("delo")).alias("number"))
    found = cards(spark, sf).select("portal_id", "opis_code", parse.strip_zeros(F.col("delo")).alias("number"))
    return listed.join(found, ["opis_code", "number"]).select("place", "portal_id").orderBy("place", "portal_id")


@query(f"with {CARDS}, {STARTS} select ymd[1] y, ymd[2] m, count(*) n, max(count(*)) over () / sum(count(*)) over () peak_share from c join s using (portal_id) where contains(name, 'вариант') and contains(name, 'Расчёт') and p >= 2 group by 1, 2")
def topic_months(spark, sf):
    """Cards whose name has both parts, by month; dates that know only a year are left out. With the share of the peak."""
    from pyspark.sql import Window

    named = cards(spark, sf).filter(parse.has_all(F.col("name"), "вариант", "Расчёт")).select("portal_id")
    m = named.join(starts(spark, sf).filter("p >= 2"), "portal_id").groupBy(F.col("ymd")[0].alias("y"), F.col("ymd")[1].alias("m")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # a few hundred months at most
    return m.withColumn("peak_share", F.max("n").over(whole) / F.sum("n").over(whole))


@query("select count(*) n, count_if(coalesce(title_en <> '' and title_en is distinct from title_ru, false)) translated from (select distinct portal_id, title_ru, title_en from title_en)")
def translated_titles(spark, sf):
    t = distinct(spark, sf, "title_en", "portal_id", "title_ru", "title_en")
    return t.agg(F.count("*").alias("n"), F.count_if(parse.translated(F.col("title_ru"), F.col("title_en"))).alias("translated"))


@query(f"with {CARDS}, r as (select distinct opis_code, delo from transcripts_raw where status = 'done') select opis_code, delo, portal_id, coalesce(pages, 0) pages from r join c using (opis_code, delo)")
def read_files(spark, sf):
    """Files that have a reading, with their cards."""
    r = table(spark, sf, "transcripts_raw", "opis_code", "delo", "status").filter("status = 'done'").select("opis_code", "delo").distinct()
    return r.join(cards(spark, sf).select("opis_code", "delo", "portal_id", F.coalesce("pages", F.lit(0)).alias("pages")), ["opis_code", "delo"])


@query(f"with {CARDS}, r as (select distinct opis_code, delo from transcripts_raw where status = 'done') select 'opis_' || opis_code || '/delo_' || delo address, portal_id, {TITLE_SQL} title from r join c using (opis_code, delo) where name is not null")
def transcribed_titles(spark, sf):
    """The address of each file with a reading, and its title for comparison, in order."""
    r = table(spark, sf, "transcripts_raw", "opis_code", "delo", "status").filter("status = 'done'").select("opis_code", "delo").distinct()
    named = r.join(cards(spark, sf).filter("name is not null").select("opis_code", "delo", "portal_id", "name"), ["opis_code", "delo"])
    return named.select(F.concat(F.lit("opis_"), "opis_code", F.lit("/delo_"), "delo").alias("address"), "portal_id", parse.clean_title(F.col("name")).alias("title")).orderBy("address", "portal_id")


@query(f"select d.doc_id, md5(case when {COUNT_WORDS} >= 30 then text else title_ru end) chosen from documents d left join (select distinct portal_id, title_ru from title_en) t using (portal_id)")
def text_fallback(spark, sf):
    """A document's text if it has thirty words, else the title of its card."""
    d = table(spark, sf, "documents", "doc_id", "portal_id", "text").join(distinct(spark, sf, "title_en", "portal_id", "title_ru"), "portal_id", "left")
    return d.select("doc_id", F.md5(parse.first_long_enough(F.col("text"), F.col("title_ru"))).alias("chosen"))


@query("with r as (select distinct delo, page, opis_code, list_position(['1', '1а', '2', '3', '4'], opis_code) k from transcripts_raw) select delo, page, opis_code from r where k > 0 qualify k = min(k) over (partition by delo, page)")
def first_inventory(spark, sf):
    """For each number and page the first inventory, in a fixed order, that has it."""
    return queue.first_place(distinct(spark, sf, "transcripts_raw", "delo", "page", "opis_code"), ["delo", "page"], "opis_code", ["1", "1а", "2", "3", "4"])


@query(f"with {PAIRS}, b as (select a_reading_id, b_reading_id, bound, greatest(len(a_w), len(b_w)) longer from q) (select 'best' list, * from b order by bound desc, a_reading_id, b_reading_id limit 8) union all (select 'worst', * from b order by bound, a_reading_id, b_reading_id limit 4) union all (select 'longest', * from b order by longer desc, a_reading_id, b_reading_id limit 4)")
def extreme_pairs(spark, sf):
    """The eight most alike pairs of readings, the four least alike ones, and the four longest."""
    from papyrine.operators import similarity

    ids = ["a_reading_id", "b_reading_id"]
    b = similarity.quick_ratio(_pairs(spark, sf), ids, "a_w", "b_w").select(*ids, "bound", F.greatest(F.size("a_w"), F.size("b_w")).cast("bigint").alias("longer"))
    top = lambda name, first, n: b.orderBy(first, *ids).limit(n).select(F.lit(name).alias("list"), *b.columns)
    return top("best", F.desc("bound"), 8).unionByName(top("worst", F.asc("bound"), 4)).unionByName(top("longest", F.desc("longer"), 4))


@query("select key, row_number() over (order by key::bigint) place from (select distinct portal_id::varchar as key from delo_dates where portal_id is not null)")
def numeric_order(spark, sf):
    """Keys that are numbers written as texts, in the order of the numbers."""
    keys = distinct(spark, sf, "delo_dates", "portal_id").filter("portal_id is not null").select(F.col("portal_id").cast("string").alias("key"))
    return sequence.numbered(keys.withColumn("_n", F.col("key").cast("bigint")), [], ["_n"], "place").drop("_n")


@query("(select portal_id, 'either' found from (select portal_id from delo_dates union select portal_id from title_en)) union all (select portal_id, 'only_dated' from (select portal_id from delo_dates except select portal_id from title_en))")
def key_sets(spark, sf):
    """The keys of either table, and those of the first one only."""
    a, b = distinct(spark, sf, "delo_dates", "portal_id"), distinct(spark, sf, "title_en", "portal_id")
    either, only = a.union(b).distinct(), a.exceptAll(b)
    return either.withColumn("found", F.lit("either")).unionByName(only.withColumn("found", F.lit("only_dated")))


@query(f"with {DOC_TERMS}, s as (select unicode(term) shard, sum(strlen(term) + 8 * df)::bigint bytes from k group by 1) select count(*) shards, percentile_disc(0.5) within group (order by bytes desc) middle, max(bytes) largest, sum(bytes)::bigint total from s")
def shard_sizes(spark, sf):
    """Sizes of the index's shards: a term's bytes and eight for each document."""
    kept, _ = index.split_stop_terms(table(spark, sf, "documents", "doc_id", "text"))
    sizes = kept.groupBy(F.ascii("term").alias("shard")).agg(F.sum(F.octet_length("term") + 8 * F.col("df")).alias("bytes"))
    return sizes.agg(F.count("*").alias("shards"), stats.upper_median("bytes").alias("middle"), F.max("bytes").alias("largest"), F.sum("bytes").alias("total"))


_MEASURED = f"""r as (select distinct reading_id, path, coalesce(model, '') model, {COUNT_WORDS} words, case when {COUNT_WORDS} >= 30 then (len(regexp_extract_all(text, '\\[\\?\\]')) + len(regexp_extract_all(text, '\\[неразборчиво'))) / {COUNT_WORDS} end doubt from transcripts_raw where text is not null), m as (select r.*, class from r join (select distinct path, class from page_classes) using (path))"""


def _measured(spark, sf):
    c = F.col("text")
    r = table(spark, sf, "transcripts_raw", "reading_id", "path", "model", "text").filter("text is not null")
    r = r.select("reading_id", "path", F.coalesce("model", F.lit("")).alias("model"), text.spaced_words(c).cast("bigint").alias("words"), text.uncertainty(c).alias("doubt")).distinct()
    return r.join(distinct(spark, sf, "page_classes", "path", "class"), "path")


@query(f"with {_MEASURED} select class, count(*) n, percentile_disc(0.5) within group (order by words desc) words, percentile_disc(0.5) within group (order by doubt desc) doubt from m group by 1")
def class_medians(spark, sf):
    """Upper medians of words and of doubt by class; short readings have no doubt and count for words only."""
    return _measured(spark, sf).groupBy("class").agg(F.count("*").alias("n"), stats.upper_median("words").alias("words"), stats.upper_median("doubt").alias("doubt"))


@query(f"with {_MEASURED} select model, count(*) n, percentile_disc(0.5) within group (order by words desc) filter (class = 'hand') hand, percentile_disc(0.5) within group (order by words desc) filter (class = 'typed') typed, avg(words) mean_words, avg(doubt) mean_doubt, min(reading_id) first_seen from m group by 1")
def model_pivot(spark, sf):
    """For each model the upper median of words by class, and means; in order of first appearance."""
    when = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY words DESC) FILTER (WHERE class = '{c}')")
    return _measured(spark, sf).groupBy("model").agg(F.count("*").alias("n"), when("hand").alias("hand"), when("typed").alias("typed"), F.avg("words").alias("mean_words"), F.avg("doubt").alias("mean_doubt"), F.min("reading_id").alias("first_seen")).orderBy("first_seen")


@query(f"""with {_VARIANTS}, d as (select portal_id, year_from, coalesce(pages, 0) pages from c join (select distinct portal_id, year_from from delo_dates) using (portal_id)),
g as (select work, count(*) n, min({{'o': coalesce(variant, 9), 'id': portal_id, 'conj': conj, 'p': p, 'ymd': ymd}}) a, max({{'o': coalesce(variant, 9), 'id': portal_id, 'conj': conj, 'p': p, 'ymd': ymd}}) b from v group by 1)
select 'files' measure, count(*)::double as "value" from d union all select 'dated', count(year_from) from d union all select 'sheets', sum(pages) from d union all select 'first_year', min(year_from) from d union all select 'last_year', max(year_from) from d union all select 'late', count_if(year_from >= 1932) from d union all select 'late_sheets', coalesce(sum(pages) filter (year_from >= 1932), 0) from d
union all select 'works', count_if(n >= 2) from g union all select 'pairs', count_if(n = 2) from g union all select 'conflicts', count_if(n = 2 and coalesce(not a.conj and not b.conj and b.ymd[1:least(a.p, b.p)] < a.ymd[1:least(a.p, b.p)], false)) from g""")
def dates_report(spark, sf):
    """The figures of the report on dates: coverage, span, late files, works in variants, and pairs of variants whose
    firm dates contradict their order."""
    from papyrine.plans.queries import variant_order

    d = distinct(spark, sf, "delo_dates", "portal_id", "year_from").join(cards(spark, sf).select("portal_id", F.coalesce("pages", F.lit(0)).alias("pages")), "portal_id")
    late = F.col("year_from") >= 1932
    figures = {"files": F.count("*"), "dated": F.count("year_from"), "sheets": F.sum("pages"), "first_year": F.min("year_from"), "last_year": F.max("year_from"), "late": F.count_if(late), "late_sheets": F.coalesce(F.sum(F.when(late, F.col("pages"))), F.lit(0))}
    one = d.agg(*(v.cast("double").alias(k) for k, v in figures.items()))
    works = variants(spark, sf).groupBy("work").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") >= 2).cast("double").alias("works"))
    pairs = variant_order(spark, sf).agg(F.count("*").cast("double").alias("pairs"), F.count_if("conflict").cast("double").alias("conflicts"))
    tall = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in df.columns))).alias("x")).select("x.*")
    return tall(one).unionByName(tall(works)).unionByName(tall(pairs))


@query(f"""with {CARDS}, t as (select distinct portal_id, title_en from title_en), d as (select distinct portal_id, material, year_from from delo_dates), m as (select regexp_extract(path, '{parse.SCAN_PATH}', 1) opis_code, regexp_extract(path, '{parse.SCAN_PATH}', 2) delo, round_even(count_if(class = 'hand') * 100 / count(*), 0)::int hand from (select distinct path, class from page_classes) group by 1, 2)
select portal_id, c.opis_code, c.delo, coalesce(title_en, '') title_en, array_to_string(list_transform(list_filter(list_transform(string_split(coalesce(material, ''), ','), lambda t: trim(t, ' ')), lambda t: t <> ''), lambda t: coalesce(map_extract({_GLOSS}, t)[1], map_extract({_GLOSS}, lower(t))[1], t)), ', ') material, coalesce(year_from, -1) year_from, coalesce(m.hand, -1) hand from c left join t using (portal_id) left join d using (portal_id) left join m on m.opis_code = c.opis_code and m.delo = c.delo""")
def site_catalogue(spark, sf):
    """Every card with its English title, glossed material, year and share of handwriting, defaults where these lack, in
    the order of inventory and number."""
    mix = stats.mix(distinct(spark, sf, "page_classes", "path", "class").withColumns(parse.path_parts(F.col("path"))), ["path_opis", "path_delo"], F.col("class") == "hand")
    mix = mix.select(F.col("path_opis").alias("opis_code"), F.col("path_delo").alias("delo"), F.col("percent").alias("hand"))
    c = cards(spark, sf).select("portal_id", "opis_code", "delo").join(distinct(spark, sf, "title_en", "portal_id", "title_en"), "portal_id", "left")
    c = c.join(distinct(spark, sf, "delo_dates", "portal_id", "material", "year_from"), "portal_id", "left").join(mix, ["opis_code", "delo"], "left")
    done = c.select("portal_id", "opis_code", "delo", F.coalesce("title_en", F.lit("")).alias("title_en"), parse.gloss(F.coalesce("material", F.lit("")), "материал").alias("material"), F.coalesce("year_from", F.lit(-1)).alias("year_from"), F.coalesce("hand", F.lit(-1)).alias("hand"))
    return done.orderBy("opis_code", parse.order_keys(F.col("delo"))["as_number"], "delo", "portal_id")


@query("with x as (select distinct portal_id, dates_raw, year_from, list_distinct(regexp_extract_all(dates_raw, '(1[89][0-9][0-9])')) ys from delo_dates where dates_raw is not null and year_from is not null) select count(*) n, count_if(contains(dates_raw, year_from::varchar)) stated, count_if(len(list_filter(ys, lambda y: y <> year_from::varchar)) > 0) contradicted from x")
def year_claims(spark, sf):
    """Stated years against the texts they come from: how many texts hold theirs, how many hold another year too."""
    d = distinct(spark, sf, "delo_dates", "portal_id", "dates_raw", "year_from").filter("dates_raw is not null and year_from is not null")
    year = F.col("year_from").cast("string")
    others = text.contradictions(F.col("dates_raw"), "(1[89][0-9][0-9])", year)
    return d.agg(F.count("*").alias("n"), F.count_if(text.states(F.col("dates_raw"), year)).alias("stated"), F.count_if(F.size(others) > 0).alias("contradicted"))
