"""Named queries of the core over the driver's tables, each with the SQL that gives the same rows.

Rows delivered twice are equal in every column and count once: queries take the columns they need and make those
distinct by the table's key, so that texts are not shuffled where numbers will do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import parse, text
from papyrine.functions.vocabulary import GLOSSES
from papyrine.operators import corpus, dates, index, raster, sequence, similarity, stats
from papyrine.plans.registry import CARDS as _CARDS
from papyrine.plans.registry import COUNT_WORDS as _COUNT_WORDS
from papyrine.plans.registry import QUERIES, SQL, WS, Query, query
from papyrine.plans.registry import cards as _cards
from papyrine.plans.registry import distinct as _d
from papyrine.session import cut, join_small
from papyrine.sources.tables import table

_TERMS = f"regexp_extract_all(regexp_replace(lower(text), '(?m){text.INDEX_MARKUP}', ' ', 'g'), '[а-яёa-z]{{3,}}')"
_DOC_TERMS = f"t as (select distinct doc_id, replace(w, 'ё', 'е') term from (select doc_id, unnest({_TERMS}) w from documents)), f as (select term, count(*) df from t group by term), k as (select * from f where df <= 0.25 * (select count(*) from documents))"


# --- dates (problem 4) ------------------------------------------------------------------------------------------


@query()
def p4_found(spark, sf):
    return dates.dated_cards(table(spark, sf, "delo_dates"))


@query()
def p4_dates(spark, sf):
    return dates.with_dates(table(spark, sf, "delo_dates")).select("portal_id", "dates_raw", "conjectural", "starts", "ends", "conj").distinct()


# --- full-text index --------------------------------------------------------------------------------------------


@query(f"with {_DOC_TERMS} select term, df from k")
def index_terms(spark, sf):
    return index.split_stop_terms(table(spark, sf, "documents", "doc_id", "text"))[0]


@query(f"with {_DOC_TERMS} select term, df, length(term) letters from f where df > 0.25 * (select count(*) from documents)")
def index_stop_terms(spark, sf):
    return index.split_stop_terms(table(spark, sf, "documents", "doc_id", "text"))[1].withColumn("letters", F.length("term")).orderBy("letters", "term")


@query(f"with {_DOC_TERMS} select term, k.df, doc_id // 100000 as block, string_agg(doc_id::varchar, ',' order by doc_id) docs from t join k using (term) group by term, k.df, doc_id // 100000")
def index_postings(spark, sf):
    return index.postings(table(spark, sf, "documents", "doc_id", "text")).select("term", "df", "block", F.array_join(F.col("docs").cast("array<string>"), ",").alias("docs"))


@query(f"with {_DOC_TERMS} select unicode(term) shard, count(*) terms, sum(df)::bigint postings, max(df) longest from k group by 1")
def index_shards(spark, sf):
    kept, _ = index.split_stop_terms(table(spark, sf, "documents", "doc_id", "text"))
    return kept.groupBy(F.ascii("term").alias("shard")).agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("longest"))


@query(f"with {_DOC_TERMS} select distinct doc_id from t join k using (term) where term like 'стекл%'")
def prefix_search(spark, sf):
    return index.prefix_search(index.postings(table(spark, sf, "documents", "doc_id", "text")), "стекл")


# --- rates and marks --------------------------------------------------------------------------------------------


@query(f"""select doc_id, case when {_COUNT_WORDS} >= 30 then (len(regexp_extract_all(text, '[ѣіѳѵѢІѲѴ]')) + len(regexp_extract_all(text, '[ъЪ]([^\\p{{L}}\\p{{N}}_]|$)'))) / {_COUNT_WORDS} end rate from documents""")
def archaisation_rate(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.archaisation(F.col("text")).alias("rate"))


@query(f"""with u as (select distinct reading_id, {_COUNT_WORDS} n, len(regexp_extract_all(text, '\\[\\?\\]')) + len(regexp_extract_all(text, '\\[неразборчиво')) m from transcripts_raw where text is not null)
select reading_id, case when n >= 30 then m / n end rate, case when n > 0 then m / n else 0.0 end rate_or_zero from u""")
def uncertainty_rate(spark, sf):
    c = F.col("text")
    return table(spark, sf, "transcripts_raw", "reading_id", "text").filter("text is not null").select("reading_id", text.uncertainty(c).alias("rate"), text.uncertainty_or_zero(c).alias("rate_or_zero")).distinct()


@query("""select doc_id, len(regexp_extract_all(text, '(?m)^## Лист ')) sheets, len(regexp_extract_all(text, '\\[\\?\\]')) doubts, len(regexp_extract_all(text, '\\[неразборчиво')) illegible, len(regexp_extract_all(text, '~~.+?~~')) struck from documents where text is not null""")
def mark_counts(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").filter("text is not null").select("doc_id", *(v.cast("bigint").alias(k) for k, v in text.mark_counts(F.col("text")).items()))


# --- runs of lines ----------------------------------------------------------------------------------------------

_LINES = """l as (select reading_id, pos, lines[pos] line from (select reading_id, string_split(text, chr(10)) lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) pos from (select distinct reading_id, text from transcripts_raw where text is not null))),
s as (select *, case when trim(line) = '' or line is distinct from lag(line) over (partition by reading_id order by pos) then 1 else 0 end fresh from l),
g as (select *, sum(fresh) over (partition by reading_id order by pos) run from s),
r as (select reading_id, run, min(pos) pos, any_value(line) line, count(*) n from g group by reading_id, run)"""


@query(f"""with {_LINES} select reading_id, md5(string_agg(case when n >= 3 then line || chr(10) || '[повтор свёрнут: та же строка ещё ' || (n - 1) || ' раз]' when n = 2 then line || chr(10) || line else line end, chr(10) order by pos)) folded from r group by reading_id""")
def loop_fold(spark, sf):
    return table(spark, sf, "transcripts_raw", "reading_id", "text").filter("text is not null").select("reading_id", F.md5(sequence.fold_runs(F.col("text"))).alias("folded")).distinct()


@query(f"""with {_LINES} select count(distinct reading_id) readings, sum(n - 1)::bigint dropped, sum((n - 1) * (len(regexp_extract_all(line, '\\[\\?\\]')) + len(regexp_extract_all(line, '\\[неразборчиво'))))::bigint marks_lost from r where n >= 3""")
def loop_report(spark, sf):
    """Readings with folded runs, and the lines and the marks of doubt that the folding takes out."""
    folded = sequence.fold_runs(F.col("text"))
    size = lambda c: F.size(F.split(c, "\n", -1))
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    markers = count(folded, r"\[повтор свёрнут") - count("text", r"\[повтор свёрнут")
    doubts = sum((count("text", p) - count(folded, p) for p in (r"\[\?\]", r"\[неразборчиво")), F.lit(0))
    r = table(spark, sf, "transcripts_raw", "reading_id", "text").filter("text is not null").select("reading_id", (size(F.col("text")) - size(folded) + markers).alias("dropped"), doubts.alias("lost")).distinct()
    return r.filter("dropped > 0").agg(F.count("*").alias("readings"), F.sum("dropped").alias("dropped"), F.sum("lost").alias("marks_lost"))


# --- documents of sheets ----------------------------------------------------------------------------------------

_SHEETS = """s as (select opis_code, delo, page, text from (select *, row_number() over (partition by opis_code, delo, page order by read_at desc, reading_id desc) k from (select distinct reading_id, opis_code, delo, page, read_at, text from transcripts_raw where status = 'done' and text is not null)) where k = 1)"""


def _sheets(spark, sf):
    """The last reading of every sheet that has one, and the volume it is in: 500 sheets of a file at most."""
    rows = table(spark, sf, "transcripts_raw", "reading_id", "opis_code", "delo", "page", "read_at", "status", "text").filter("status = 'done' and text is not null")
    last = rows.groupBy("opis_code", "delo", "page").agg(F.max_by("text", F.struct("read_at", "reading_id")).alias("text"))
    return last.withColumn("volume", F.floor(F.col("page").cast("int") / 500))


_FIELD = "case when trim(regexp_extract(name, '{0}\\s*(.*?)\\s*(" + "|".join(parse.NAME_LABELS) + "|$)', 1), ' .;') <> '' then '**{1}:** ' || trim(regexp_extract(name, '{0}\\s*(.*?)\\s*(" + "|".join(parse.NAME_LABELS) + "|$)', 1), ' .;') end"
_TITLE = "trim(regexp_split_to_array(name, '" + "|".join(parse.NAME_LABELS) + "')[1], ' .;')"


@query(f"""with s as (select distinct reading_id, opis_code, delo, page, status, read_at, text from transcripts_raw),
g as (select opis_code, delo, page, max((status = 'done')::int) d from s group by all), f as (select opis_code, delo, count(*) scans from g group by 1, 2 having sum(d) >= count(*)),
l as (select opis_code, delo, page, text from s where status = 'done' qualify row_number() over (partition by opis_code, delo, page order by (text is not null) desc, read_at desc, reading_id desc) = 1),
b as (select opis_code, delo, page::int // 500 as volume, count(*) sheets, string_agg('## Лист ' || page || chr(10) || chr(10) || case when text is null then '[не получено]' when regexp_matches(text, '^[{WS}]*$') then '[пустой лист]' else text end, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page) body from l join f using (opis_code, delo) group by 1, 2, 3),
k as (select * from catalog qualify row_number() over (partition by opis_code, delo order by fetched_at desc, portal_id desc) = 1),
h as (select f.opis_code, f.delo, portal_id, concat_ws(chr(10), '# ' || coalesce(opis, 'Опись ' || f.opis_code) || ', дело ' || regexp_replace(f.delo, '^0+(.)', '\\1'), '', case when {_TITLE} <> '' then '**Название:** ' || {_TITLE} end, {_FIELD.format('Вид материала:', 'Вид материала')}, {_FIELD.format('Способ воспроизведения:', 'Способ воспроизведения')}, {_FIELD.format('Языки?:', 'Языки')}, {_FIELD.format('Крайние даты:', 'Крайние даты')}, '**Сканов:** ' || scans, '**Источник:** карточка ' || portal_id) || chr(10) || chr(10) || '> Машинная транскрипция. Экспертная выверка не проводилась. Орфография оригинала сохранена.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) head from f left join k using (opis_code, delo))
select opis_code, delo, volume, portal_id, sheets, md5(head || body) document from b join h using (opis_code, delo)""")
def doc_assemble(spark, sf):
    """Complete files as documents in volumes of 500 sheets, each under the particulars of its address's newest card."""
    cards_ = table(spark, sf, "catalog", "opis_code", "delo", "portal_id", "opis", "name", "fetched_at")
    done = corpus.file_documents(table(spark, sf, "transcripts_raw"), cards_)
    return done.withColumn("document", F.md5("document"))


@query(f"""with {_SHEETS} select opis_code, delo, page sheet, md5(regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')) body from s""")
def sheet_roundtrip(spark, sf):
    done = corpus.assemble(_sheets(spark, sf), ["opis_code", "delo", "volume"], "page", "text")
    return corpus.split_sheets(done, ["opis_code", "delo", "volume"], "document").select("opis_code", "delo", "sheet", F.md5("text").alias("body"))


@query(f"""with {_SHEETS} select opis_code, delo, page, length(text) chars from (select *, row_number() over (partition by opis_code, delo order by page) k from s) where k > 2""")
def skip_cover(spark, sf):
    narrow = _sheets(spark, sf).select("opis_code", "delo", "page", F.length("text").alias("chars"))
    return sequence.skip_first(narrow, ["opis_code", "delo"], ["page"], 2)


@query("""with c as (select distinct opis_code, delo, page from transcripts_raw where status = 'done'), e as (select distinct opis_code, delo, page from transcripts_raw)
select opis_code, delo, count(c.page) done, count(*) expected from e left join c using (opis_code, delo, page) group by 1, 2 having count(c.page) >= count(*)""")
def complete_files(spark, sf):
    pages = table(spark, sf, "transcripts_raw", "opis_code", "delo", "page", "status").groupBy("opis_code", "delo", "page").agg(F.max((F.col("status") == "done").cast("int")).alias("d"))
    files = pages.groupBy("opis_code", "delo").agg(F.sum("d").alias("done"), F.count("*").alias("expected"))
    return corpus.complete_only(files, "done", "expected")


@query(f"""with {_SHEETS}, n as (select opis_code, delo, page, page::int k, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) x from s),
p as (select a.opis_code, a.delo, a.page, a.x, b.x y from n a join n b on a.opis_code = b.opis_code and a.delo = b.delo and a.k + 1 = b.k),
o as (select opis_code, delo, page, list_max(list_filter([1, 2, 3, 4, 5, 6], lambda k: len(x) >= k and len(y) >= k and x[len(x) - k + 1:] = y[:k] and array_to_string(y[:k], '') <> '')) lines from p) select * from o where lines > 0""")
def stitch_overlap(spark, sf):
    """How many lines the bottom of each sheet shares with the top of the next one: an equi-join on the page after."""
    s = _sheets(spark, sf)
    above = s.select("opis_code", "delo", "page", (F.col("page").cast("int") + 1).alias("k"), F.col("text").alias("above"))
    below = s.select("opis_code", "delo", F.col("page").cast("int").alias("k"), F.col("text").alias("below"))
    return above.join(below, ["opis_code", "delo", "k"]).select("opis_code", "delo", "page", corpus.overlap(F.col("above"), F.col("below")).alias("lines")).filter("lines > 0")


@query(f"""with r as (select distinct reading_id, text, trim(text, ' ') t, {_COUNT_WORDS} n, right(regexp_replace(text, '[{WS}]+$', ''), 1) e from transcripts_raw)
select count(*) readings, count_if(t is null or t = '') is_empty, count_if(t = '[пустой лист]') declared_empty, count_if(regexp_matches(text, '(?i)^\\s*({corpus.EXCUSE})')) excuse, count_if(n > 60 and strpos('{corpus.CLOSING.replace("'", "''")}', e) = 0) open_ended from r""")
def qa_flags(spark, sf):
    flags = corpus.reading_flags(F.col("text"))
    r = table(spark, sf, "transcripts_raw", "reading_id", "text").select("reading_id", *(v.alias(k) for k, v in flags.items())).distinct()
    return r.agg(F.count("*").alias("readings"), *(F.count_if(k).alias(k) for k in flags))


# --- similarity of two readings of a sheet -----------------------------------------------------------------------

_PAIRS = """r as (select distinct reading_id, path, opis_code, delo, regexp_extract_all(lower(text), '[а-яёѣіѳѵa-z]+') w from transcripts_raw where text is not null and path is not null),
p as (select a.reading_id a_reading_id, b.reading_id b_reading_id, a.opis_code, a.delo, a.w a_w, b.w b_w from r a join r b on a.path = b.path and a.reading_id < b.reading_id),
ca as (select a_reading_id, b_reading_id, w, count(*) n from (select a_reading_id, b_reading_id, unnest(a_w) w from p) group by all),
cb as (select a_reading_id, b_reading_id, w, count(*) n from (select a_reading_id, b_reading_id, unnest(b_w) w from p) group by all),
m as (select a_reading_id, b_reading_id, sum(least(ca.n, cb.n)) common from ca join cb using (a_reading_id, b_reading_id, w) group by 1, 2),
q as (select p.*, coalesce(common, 0)::bigint common, case when len(a_w) + len(b_w) = 0 then 1.0 else 2.0 * coalesce(common, 0) / (len(a_w) + len(b_w)) end bound from p left join m using (a_reading_id, b_reading_id))"""


def _pairs(spark, sf):
    """Two readings of a path as tokens. The paths that were read more than once come from narrow columns; only their
    readings are divided into words and shuffled."""
    narrow = table(spark, sf, "transcripts_raw", "reading_id", "path", "text").filter("text is not null and path is not null").select("reading_id", "path")
    twice = narrow.groupBy("path").agg((F.max("reading_id") > F.min("reading_id")).alias("twice")).filter("twice").select("path")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[а-яёѣіѳѵa-z]+"), F.lit(0))
    r = table(spark, sf, "transcripts_raw", "reading_id", "path", "opis_code", "delo", "text").filter("text is not null")
    r = join_small(r, cut(twice), ["path"], "left_semi")
    r = r.select("reading_id", "path", "opis_code", "delo", words.alias("w")).dropDuplicates(["reading_id"])
    p = similarity.pairs(r, "path", "reading_id", "opis_code", "delo", "w")
    return p.select("a_reading_id", "b_reading_id", F.col("a_opis_code").alias("opis_code"), F.col("a_delo").alias("delo"), "a_w", "b_w")


_KEY = ["a_reading_id", "b_reading_id"]


@query(f"with {_PAIRS} select a_reading_id, b_reading_id, common, bound from q")
def quick_ratio_pairs(spark, sf):
    return similarity.quick_ratio(_pairs(spark, sf), _KEY, "a_w", "b_w").select(*_KEY, "common", "bound")


@query(f"""with {_PAIRS}, x as (select a_reading_id, b_reading_id, unnest(a_w) w, unnest(range(len(a_w))) i from p), y as (select a_reading_id, b_reading_id, unnest(b_w) w, unnest(range(len(b_w))) j from p),
d as (select a_reading_id, b_reading_id, i, i - j d from x join y using (a_reading_id, b_reading_id, w)), e as (select *, i - row_number() over (partition by a_reading_id, b_reading_id, d order by i) g from d),
n as (select a_reading_id, b_reading_id, max(n) run from (select a_reading_id, b_reading_id, count(*) n from e group by a_reading_id, b_reading_id, d, g) group by 1, 2)
select a_reading_id, b_reading_id, coalesce(run, 0)::bigint run from p left join n using (a_reading_id, b_reading_id)""")
def longest_run_pairs(spark, sf):
    return similarity.longest_run(_pairs(spark, sf), _KEY, "a_w", "b_w")


@query()
def exact_ratio_pairs(spark, sf):
    return _pairs(spark, sf).select(*_KEY, similarity.ratio("a_w", "b_w").alias("ratio"))


@query()
def edit_script_tags(spark, sf):
    ops = _pairs(spark, sf).select(F.explode(similarity.edit_script("a_w", "b_w")).alias("o"))
    return ops.groupBy(F.col("o.tag").alias("tag")).agg(F.count("*").alias("n"), F.sum(F.expr("greatest(o.i2 - o.i1, o.j2 - o.j1)")).alias("tokens"))


@query()
def best_block_pairs(spark, sf):
    return _pairs(spark, sf).select(*_KEY, similarity.best_block("a_w", "b_w").alias("x")).select(*_KEY, "x.*")


@query()
def best_window_pairs(spark, sf):
    return _pairs(spark, sf).select(*_KEY, similarity.best_window("a_w", "b_w").alias("ratio"))


@query(f"with {_PAIRS} select count(*) pairs, count(distinct (opis_code, delo)) files, min(bound) least, percentile_disc(0.5) within group (order by bound desc) middle, max(bound) most, count_if(bound >= 0.6) high from q")
def calibration_report(spark, sf):
    q = similarity.quick_ratio(_pairs(spark, sf), _KEY, "a_w", "b_w")
    return q.agg(F.count("*").alias("pairs"), F.countDistinct("opis_code", "delo").alias("files"), F.min("bound").alias("least"), stats.upper_median("bound").alias("middle"), F.max("bound").alias("most"), F.count_if(F.col("bound") >= 0.6).alias("high"))


@query(f"with {_PAIRS}, a as (select percentile_disc(0.5) within group (order by bound desc) floor from q), o as (select opis_code, delo, percentile_disc(0.5) within group (order by bound desc) floor, count(*) n from q group by 1, 2) select opis_code, delo, case when n >= 3 then o.floor else a.floor end floor, n from o cross join a")
def noise_floor(spark, sf):
    """Each file's upper median of its own pairs, with fewer than three of them that of all pairs (one number)."""
    q = similarity.quick_ratio(_pairs(spark, sf), _KEY, "a_w", "b_w").select("opis_code", "delo", "bound")
    own = q.groupBy("opis_code", "delo").agg(stats.upper_median("bound").alias("own"), F.count("*").alias("n"))
    every = q.agg(stats.upper_median("bound").alias("all"))
    return own.join(F.broadcast(every)).select("opis_code", "delo", F.when(F.col("n") >= 3, F.col("own")).otherwise(F.col("all")).alias("floor"), "n")


@query(f"with {_PAIRS}, f as (select percentile_disc(0.5) within group (order by bound desc) floor from q) select a_reading_id, b_reading_id, bound from q, f where bound > floor")
def resolving_gate(spark, sf):
    q = similarity.quick_ratio(_pairs(spark, sf), _KEY, "a_w", "b_w").select(*_KEY, "bound")
    return q.join(F.broadcast(q.agg(stats.upper_median("bound").alias("floor")))).filter("bound > floor").drop("floor")


@query(f"with {_PAIRS} select bound >= 0.6 high, count(*) n, percentile_disc(0.5) within group (order by common desc) middle from q group by 1")
def high_low_split(spark, sf):
    q = similarity.quick_ratio(_pairs(spark, sf), _KEY, "a_w", "b_w")
    return q.groupBy((F.col("bound") >= 0.6).alias("high")).agg(F.count("*").alias("n"), stats.upper_median("common").alias("middle"))


@query(f"with {_PAIRS} select count(*) n, count_if(len(a_w) > len(b_w)) wins_a, count_if(len(a_w) < len(b_w)) wins_b, count_if(len(a_w) = len(b_w)) draws, percentile_disc(0.5) within group (order by len(a_w) - len(b_w) desc) median_difference from p")
def win_rate(spark, sf):
    return stats.wins(_pairs(spark, sf).select(F.size("a_w").cast("bigint").alias("a"), F.size("b_w").cast("bigint").alias("b")), "a", "b")


# --- statistics -------------------------------------------------------------------------------------------------


@query(f"""with m as (select doc_id, length(text) c, {_COUNT_WORDS} w from documents where text is not null), r as (select row_number() over (order by c, doc_id) a, row_number() over (order by w, doc_id) b from m)
select count(*) n, 1 - 6 * sum((a - b) * (a - b))::double / (count(*) * (count(*)::double * count(*) - 1)) rho from r""")
def spearman_positional(spark, sf):
    m = table(spark, sf, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.length("text").alias("c"), text.spaced_words(F.col("text")).alias("w"))
    return stats.spearman(m, "c", "w", "doc_id")


_FEATURES = f"""m as (select d.doc_id, (label = 'prose')::int y, length(text)::double chars, {_COUNT_WORDS}::double words, len(regexp_extract_all(text, '[.!?]'))::double stops from documents d join doc_labels using (doc_id) where text is not null),
v as (select doc_id, y, 'chars' feature, chars v from m union all select doc_id, y, 'words', words from m union all select doc_id, y, 'stops', stops from m)"""
_STUMP = """g as (select feature, v, sum(y) p, count(*) c from {0} group by 1, 2),
h as (select *, lead(v) over w nxt, sum(p) over w pl, sum(c) over w cl, sum(p) over (partition by feature) pa, sum(c) over (partition by feature) n from g window w as (partition by feature order by v)),
k as (select feature, n, (v + nxt) / 2 cut, (cl - pl) + (pa - pl) above from h where nxt is not null),
s as (select feature, n, cut, '>' sense, above correct from k union all select feature, n, cut, '<', n - above from k),
b as (select * from s qualify row_number() over (partition by feature order by correct desc, cut, sense desc) = 1)"""


def _features(spark, sf):
    c = F.col("text")
    m = table(spark, sf, "documents", "doc_id", "text").filter("text is not null").join(table(spark, sf, "doc_labels"), "doc_id")
    m = m.select("doc_id", (F.col("label") == "prose").cast("int").alias("y"), F.length(c).cast("double").alias("chars"), text.spaced_words(c).cast("double").alias("words"), F.regexp_count(c, F.lit("[.!?]")).cast("double").alias("stops"))
    return m.select("doc_id", "y", F.expr("stack(3, 'chars', chars, 'words', words, 'stops', stops) as (feature, v)"))


@query(f"with {_FEATURES}, {_STUMP.format('v')} select feature, cut, sense, correct::bigint correct, n::bigint n from b")
def stump_fit(spark, sf):
    return stats.stump(_features(spark, sf), F.col("v"), F.col("y"), "feature").withColumnRenamed("by", "feature")


@query(f"""with {_FEATURES}, tr as (select * from v where ('0x' || right(md5(doc_id::varchar), 1))::int % 2 = 0), te as (select * from v where ('0x' || right(md5(doc_id::varchar), 1))::int % 2 = 1), {_STUMP.format('tr')}
select feature, count(*) held_out, count_if((case when sense = '>' then te.v > cut else te.v <= cut end) = (y = 1)) hits, sum(y)::bigint positive from te join b using (feature) group by 1""")
def stump_leaderboard(spark, sf):
    split = _features(spark, sf).withColumn("half", sequence.half(F.col("doc_id").cast("string")))
    best = stats.stump(split.filter("half = 0"), F.col("v"), F.col("y"), "feature").select(F.col("by").alias("feature"), "cut", "sense")
    called = F.when(F.col("sense") == ">", F.col("v") > F.col("cut")).otherwise(F.col("v") <= F.col("cut"))
    return split.filter("half = 1").join(best, "feature").groupBy("feature").agg(F.count("*").alias("held_out"), F.count_if(called == (F.col("y") == 1)).alias("hits"), F.sum("y").alias("positive"))


@query("select ('0x' || right(md5(path), 1))::int % 2 as half, count(*) n from (select distinct path from page_classes) group by 1")
def hash_split(spark, sf):
    return _d(spark, sf, "page_classes", "path").groupBy(sequence.half(F.col("path")).alias("half")).agg(F.count("*").alias("n"))


@query(f"with {_CARDS} select (year_from // 10) * 10 bucket, count(*) n, sum(coalesce(pages, 0))::bigint total, count(*) / sum(count(*)) over () share from (select distinct portal_id, year_from from delo_dates where year_from is not null) join c using (portal_id) group by 1")
def decade_histogram(spark, sf):
    """Dated files and their sheets by decade; dates without a card are left out."""
    dated = _d(spark, sf, "delo_dates", "portal_id", "year_from").filter("year_from is not null").join(_cards(spark, sf).select("portal_id", F.coalesce("pages", F.lit(0)).alias("pages")), "portal_id")
    return stats.histogram(dated, (F.floor(F.col("year_from") / 10) * 10).cast("int"), "pages")


@query("select count(*) n, count_if(year_from >= 1925) late, count_if(year_from >= 1925) / count(*) share from (select distinct portal_id, year_from from delo_dates where year_from is not null)")
def late_share(spark, sf):
    d = _d(spark, sf, "delo_dates", "portal_id", "year_from").filter("year_from is not null")
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("year_from") >= 1925).alias("late"), stats.share(F.col("year_from") >= 1925).alias("share"))


@query("with m as (select year(o_orderdate)::int y, month(o_orderdate)::int m, count(*) n from orders group by 1, 2) select y, m, n, n / max(n) over (partition by y) of_peak from m")
def month_histogram(spark, sf):
    from pyspark.sql import Window

    m = table(spark, sf, "orders", "o_orderdate").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    return m.withColumn("of_peak", F.col("n") / F.max("n").over(Window.partitionBy("y")))


@query("select o_orderpriority, min(o_orderdate) earliest, max(o_orderdate) latest, count(*) n from orders group by 1")
def minmax_by_group(spark, sf):
    return table(spark, sf, "orders", "o_orderpriority", "o_orderdate").groupBy("o_orderpriority").agg(F.min("o_orderdate").alias("earliest"), F.max("o_orderdate").alias("latest"), F.count("*").alias("n"))


_PATH = parse.SCAN_PATH


@query(f"select regexp_extract(path, '{_PATH}', 1) path_opis, regexp_extract(path, '{_PATH}', 2) path_delo, count(*) n, round_even(count_if(class = 'hand') * 100 / count(*), 0)::int percent from (select distinct path, class from page_classes) group by 1, 2")
def group_mix_share(spark, sf):
    p = _d(spark, sf, "page_classes", "path", "class")
    return stats.mix(p.withColumns(parse.path_parts(F.col("path"))), ["path_opis", "path_delo"], F.col("class") == "hand")


@query("select coalesce(model, '') model, status, count(*) n from (select distinct reading_id, model, status from transcripts_raw) group by 1, 2")
def counts_by_class(spark, sf):
    return _d(spark, sf, "transcripts_raw", "reading_id", "model", "status").groupBy(F.coalesce("model", F.lit("")).alias("model"), "status").agg(F.count("*").alias("n"))


@query("select l_returnflag, percentile_disc(0.5) within group (order by l_quantity desc) filter (l_linestatus = 'F') f_quantity, percentile_disc(0.5) within group (order by l_quantity desc) filter (l_linestatus = 'O') o_quantity, count_if(l_linestatus = 'F') f_n, count_if(l_linestatus = 'O') o_n from lineitem group by 1")
def pivot_medians(spark, sf):
    p = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(stats.upper_median("l_quantity").alias("quantity"), F.count("l_quantity").alias("n"))
    return p.select("l_returnflag", F.col("F_quantity").alias("f_quantity"), F.col("O_quantity").alias("o_quantity"), F.coalesce("F_n", F.lit(0)).alias("f_n"), F.coalesce("O_n", F.lit(0)).alias("o_n"))


@query("select o_orderstatus, percentile_disc(0.5) within group (order by o_totalprice desc) upper, median(o_totalprice) middle from orders group by 1")
def true_vs_upper_median(spark, sf):
    return table(spark, sf, "orders", "o_orderstatus", "o_totalprice").groupBy("o_orderstatus").agg(stats.upper_median("o_totalprice").alias("upper"), F.median("o_totalprice").alias("middle"))


# --- joins ------------------------------------------------------------------------------------------------------

@query(f"with {_CARDS} select portal_id, opis, opis_code, delo, name, pages, status, fetched_at from c")
def upsert_latest(spark, sf):
    return _cards(spark, sf).select("portal_id", "opis", "opis_code", "delo", "name", "pages", "status", "fetched_at")


@query(f"with {_CARDS} select c.portal_id, c.pages, d.dates_raw, d.year_from, d.material from c join (select distinct portal_id, dates_raw, year_from, material from delo_dates) d using (portal_id)")
def inner_catalog(spark, sf):
    return _cards(spark, sf).select("portal_id", "pages").join(_d(spark, sf, "delo_dates", "portal_id", "dates_raw", "year_from", "material"), "portal_id")


@query(f"with {_CARDS} select c.portal_id, coalesce(t.title_en, '') title_en, coalesce(d.material, '') material, coalesce(d.year_from, -1) year_from from c left join (select distinct portal_id, title_en from title_en) t using (portal_id) left join (select distinct portal_id, material, year_from from delo_dates) d using (portal_id)")
def star_lookup(spark, sf):
    t, d = _d(spark, sf, "title_en", "portal_id", "title_en"), _d(spark, sf, "delo_dates", "portal_id", "material", "year_from")
    return _cards(spark, sf).select("portal_id").join(t, "portal_id", "left").join(d, "portal_id", "left").select("portal_id", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in (("title_en", ""), ("material", ""), ("year_from", -1))))


@query("select r.path, coalesce(p.class, 'hand') class, p.path is null as unknown from (select distinct path from transcripts_raw) r left join (select distinct path, class from page_classes) p using (path)")
def left_default(spark, sf):
    p = _d(spark, sf, "page_classes", "path", "class").withColumn("known", F.lit(True))
    return _d(spark, sf, "transcripts_raw", "path").join(p, "path", "left").select("path", F.coalesce("class", F.lit("hand")).alias("class"), F.col("known").isNull().alias("unknown"))


@query("select distinct portal_id from catalog where portal_id not in (select portal_id from title_en)")
def todo_anti(spark, sf):
    return _d(spark, sf, "catalog", "portal_id").join(_d(spark, sf, "title_en", "portal_id"), "portal_id", "left_anti")


@query("select distinct t.path, t.path in (select path from transcripts_raw where status = 'done') done from transcripts_raw t")
def done_flag(spark, sf):
    return table(spark, sf, "transcripts_raw", "path", "status").groupBy("path").agg(F.max(F.col("status") == "done").alias("done"))


@query("select n_name, count(*) lines, count(distinct o_orderkey) orders, sum(l_quantity) quantity from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def multiway_join(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_quantity").join(table(spark, sf, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = table(spark, sf, "customer", "c_custkey", "c_nationkey").join(table(spark, sf, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return lines.join(named, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count("*").alias("lines"), F.countDistinct("o_orderkey").alias("orders"), F.sum("l_quantity").alias("quantity"))


@query(f"with {_CARDS} select coalesce(o.subject, 'opis ' || c.opis_code) subject, count(*) cards, sum(pages)::bigint pages from c left join opis_names o using (opis_code) group by 1")
def inventory_totals(spark, sf):
    """Cards and sheets by inventory; codes that no inventory has, such as those in other signs, keep a label of their own."""
    named = _cards(spark, sf).join(table(spark, sf, "opis_names", "opis_code", "subject"), "opis_code", "left")
    return named.groupBy(parse.inventory_label(F.col("subject"), F.col("opis_code")).alias("subject")).agg(F.count("*").alias("cards"), F.sum("pages").alias("pages"))


@query("with old as (select event_id, event_type, value from events where value < 50), new as (select event_id, 'click' event_type, value from events where event_type = 'view' and value >= 50) select * from old where event_type not in (select event_type from new) union all select * from new")
def replace_label(spark, sf):
    e = table(spark, sf, "events", "event_id", "event_type", "value")
    return sequence.replace_by_label(e.filter("value < 50"), e.filter("event_type = 'view' and value >= 50").withColumn("event_type", F.lit("click")), "event_type")


# --- sequences --------------------------------------------------------------------------------------------------


@query("""with s as (select *, sum(hit) over w isl, row_number() over w n from (select event_id, user_id, ts, (event_type = 'purchase')::int hit from events) window w as (partition by user_id order by ts, event_id)),
g as (select user_id, isl, count(*) len, min(n) start from s where hit = 0 group by 1, 2), x as (select user_id, min(start) stop from g where len >= 10 group by 1)
select event_id, s.user_id from s left join x using (user_id) where stop is null or n < stop""")
def miss_stop(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type")
    return sequence.streak_stop(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", 10).select("event_id", "user_id")


@query("select doc_id, source, turn from (select doc_id, source, row_number() over (partition by source order by doc_id) turn from documents) order by turn, source, doc_id limit 100")
def round_robin_sample(spark, sf):
    return sequence.round_robin(table(spark, sf, "documents", "doc_id", "source"), "source", "doc_id", 100)


@query("""with a as (select * from (select source, min(doc_id) doc_id from documents where n_chars >= 1000 group by 1) order by doc_id limit 10),
b as (select * from (select source, min(doc_id) doc_id from documents where n_chars < 500 and source not in (select source from a) group by 1) order by doc_id limit 10)
select *, 'long' band from a union all select *, 'short' from b""")
def stratified_sample(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source", "n_chars")
    return sequence.stratified(d, "source", "doc_id", [("long", F.col("n_chars") >= 1000, 10), ("short", F.col("n_chars") < 500, 10)]).select("source", "doc_id", "band")


@query("select doc_id, coalesce(lang, '') lang, (row_number() over (partition by coalesce(lang, '') order by doc_id) - 1) // 40 as batch from documents")
def batch_chunks(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "lang").withColumn("lang", F.coalesce("lang", F.lit("")))
    return sequence.batches(d, ["lang"], ["doc_id"], 40)


@query("select doc_id, source, running from (select doc_id, source, n_chars, sum(coalesce(n_chars, 0)) over (partition by source order by doc_id)::bigint running from documents) where running <= 5000 or running = coalesce(n_chars, 0)")
def byte_prefix(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source", "n_chars")
    return sequence.prefix_by_budget(d, ["source"], ["doc_id"], F.coalesce("n_chars", F.lit(0)), 5000).select("doc_id", "source", "running")


@query("select doc_id, source from documents order by md5('42:' || doc_id), doc_id limit 50")
def seeded_sample(spark, sf):
    return sequence.seeded_sample(table(spark, sf, "documents", "doc_id", "source"), "doc_id", 50)


# --- fields -----------------------------------------------------------------------------------------------------


@query("""select distinct portal_id, name, trim(regexp_split_to_array(name, 'Вид материала:|Способ воспроизведения:|Языки:|Язык:|Крайние даты:')[1], ' .;') title,
trim(regexp_extract(name, 'Вид материала:\\s*(.*?)\\s*(Вид материала:|Способ воспроизведения:|Языки:|Язык:|Крайние даты:|$)', 1), ' .;') material,
trim(regexp_extract(name, 'Способ воспроизведения:\\s*(.*?)\\s*(Вид материала:|Способ воспроизведения:|Языки:|Язык:|Крайние даты:|$)', 1), ' .;') reproduction,
trim(regexp_extract(name, 'Языки?:\\s*(.*?)\\s*(Вид материала:|Способ воспроизведения:|Языки:|Язык:|Крайние даты:|$)', 1), ' .;') "language" from catalog where name is not null""")
def name_fields(spark, sf):
    d = table(spark, sf, "catalog", "portal_id", "name").filter("name is not null")
    return d.withColumns(parse.name_fields(F.col("name"))).distinct()


# DuckDB's \b knows ASCII letters only: signs become two spaces, of which each year takes one at either side.
@query("""with x as (select distinct portal_id, dates_raw, list_transform(regexp_extract_all(regexp_replace(dates_raw, '[^\\p{L}\\p{M}\\p{N}_]', '  ', 'g'), '(?:^| )(1[89][0-9]{2})(?: |$)', 1), lambda y: y::int) ys from delo_dates where dates_raw is not null)
select portal_id, dates_raw, list_min(ys) year_from, list_max(ys) year_to, contains(dates_raw, '[') bracketed from x""")
def year_range(spark, sf):
    d = table(spark, sf, "delo_dates", "portal_id", "dates_raw").filter("dates_raw is not null")
    return d.withColumns(parse.year_range(F.col("dates_raw"))).distinct()


# The start of a date, in an engine without look-behind: signs around a word are matched along with it.
_B = r"[^\p{L}\p{M}\p{N}_]"
_STEMS = " ".join(f"when regexp_matches(lower(h), '(^|{_B}){stem}[а-я]*({_B}|$)') then {n}" for stem, n in parse.MONTHS)
STARTS = f"""x as (select distinct portal_id, dates_raw, coalesce(conjectural, false) conj, string_split(trim(dates_raw, ' '), '-')[1] h from delo_dates where dates_raw is not null),
y as (select *, regexp_extract(h, '(?:^|{_B})(\\d{{1,2}})\\.(\\d{{1,2}})\\.(1[89]\\d\\d)', ['d', 'm', 'y']) a, try_cast(regexp_extract(h, '(?:^|{_B})(1[89]\\d\\d)', 1) as int) y, case {_STEMS} else 0 end m from x),
s as (select portal_id, dates_raw, conj, case when a.y <> '' then [try_cast(a.y as int), try_cast(a.m as int), try_cast(a.d as int)] when y is not null then [y, m, 0] end ymd, case when a.y <> '' then 3 when y is not null and m > 0 then 2 when y is not null then 1 end p from y)"""


def starts(spark, sf):
    """(portal_id, dates_raw, conj, ymd, p) of the distinct dates."""
    ymd, precision = parse.partial_date(F.col("dates_raw"))
    d = table(spark, sf, "delo_dates", "portal_id", "dates_raw", "conjectural").filter("dates_raw is not null").withColumn("conj", F.coalesce("conjectural", F.lit(False)))
    return d.select("portal_id", "dates_raw", "conj", ymd.alias("ymd"), precision.alias("p")).distinct()


@query(f"""with {STARTS} select distinct portal_id, dates_raw, array_to_string(ymd, '-') ymd, p "precision" from s""")
def partial_date(spark, sf):
    return starts(spark, sf).select("portal_id", "dates_raw", F.array_join(F.col("ymd").cast("array<string>"), "-").alias("ymd"), F.col("p").alias("precision")).distinct()


# Cards of variants of a work, with their dates.
_VARIANTS = f"""{_CARDS}, {STARTS}, v as (select portal_id, replace(lower(trim(regexp_extract(name, '{parse.QUOTED}', 1), ' ')), 'ё', 'е') work, try_cast(regexp_extract(name, '(\\d)-й вариант', 1) as int) variant, conj, ymd, p from c join s using (portal_id) where contains(lower(name), 'вариант') and regexp_extract(name, '{parse.QUOTED}', 1) <> '')"""


def variants(spark, sf):
    """(portal_id, work, variant, conj, ymd, p) of the dated cards that say that they are a variant of a work."""
    named = _cards(spark, sf).filter(F.contains(F.lower("name"), F.lit("вариант"))).select("portal_id", parse.quoted_work(F.col("name")).alias("work"), parse.variant_number(F.col("name")).alias("variant"))
    return named.filter("work is not null").join(starts(spark, sf).drop("dates_raw"), "portal_id")


@query(f"""with {_VARIANTS} select work, count(*) cards, array_to_string(list_sort(list_distinct(list(coalesce(variant, 9)))), ',') variants from v group by 1 having count(*) >= 2""")
def variant_groups(spark, sf):
    """Works with several variants and the numbers of these; a variant without a number comes last, as 9."""
    numbers = F.sort_array(F.collect_set(F.coalesce("variant", F.lit(9))))  # one digit each
    return variants(spark, sf).groupBy("work").agg(F.count("*").alias("cards"), F.array_join(numbers.cast("array<string>"), ",").alias("variants")).filter("cards >= 2")


@query(f"select distinct path, regexp_extract(path, '{_PATH}', 1) path_opis, regexp_extract(path, '{_PATH}', 2) path_delo, regexp_extract(path, '{_PATH}', 3) path_page from page_classes")
def path_parts(spark, sf):
    return _d(spark, sf, "page_classes", "path").withColumns(parse.path_parts(F.col("path")))


@query("select distinct reading_id, 'data/opis_' || opis_code || '/delo_' || delo || '/' || page || '.jpg' = path same from transcripts_raw")
def scan_path_check(spark, sf):
    return table(spark, sf, "transcripts_raw", "reading_id", "opis_code", "delo", "page", "path").select("reading_id", (parse.scan_path(F.col("opis_code"), F.col("delo"), F.col("page")) == F.col("path")).alias("same")).distinct()


@query("""select distinct delo, regexp_replace(delo, '^0+(.)', '\\1') stripped, case when length(regexp_extract(delo, '^0*(\\d+)', 1)) < 4 then lpad(regexp_extract(delo, '^0*(\\d+)', 1), 4, '0') else regexp_extract(delo, '^0*(\\d+)', 1) end || regexp_extract(delo, '^\\d+(.*)$', 1) padded from transcripts_raw where delo is not null""")
def zero_pad_key(spark, sf):
    d = _d(spark, sf, "transcripts_raw", "delo").filter("delo is not null")
    return d.select("delo", parse.strip_zeros(F.col("delo")).alias("stripped"), parse.pad_number(parse.strip_zeros(F.col("delo"))).alias("padded"))


_GLOSS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in GLOSSES["материал"].items()) + "}"


@query(f"select distinct portal_id, material, array_to_string(list_transform(list_filter(list_transform(string_split(material, ','), lambda t: trim(t, ' ')), lambda t: t <> ''), lambda t: coalesce(element_at({_GLOSS}, t)[1], element_at({_GLOSS}, lower(t))[1], t)), ', ') gloss from delo_dates where material is not null".replace("element_at(", "map_extract("))
def gloss_values(spark, sf):
    return _d(spark, sf, "delo_dates", "portal_id", "material").filter("material is not null").withColumn("gloss", parse.gloss(F.col("material"), "материал"))


@query("select event_id, json_extract_string(props, '$.k')::int k from events")
def json_items(spark, sf):
    return table(spark, sf, "events", "event_id", "props").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""with recursive e as (select 'region' parent_kind, r_regionkey::bigint parent, 'nation' kind, n_nationkey::bigint id from region join nation on r_regionkey = n_regionkey union all select 'nation', n_nationkey, 'supplier', s_suppkey from nation join supplier on n_nationkey = s_nationkey union all select 'nation', n_nationkey, 'region', n_regionkey from nation union all select 'nation', n_nationkey, 'customer', c_custkey from nation join customer on n_nationkey = c_nationkey),
t as (select 'region' kind, min(r_regionkey)::bigint id from region union select e.kind, e.id from t join e on e.parent_kind = t.kind and e.parent = t.id where e.kind <> 'customer') select kind, count(*) n from t group by 1""")
def category_crawl(spark, sf):
    """Everything that can be reached from the first region, members of one kind left out; nations lead back to their
    region, so the edges have cycles."""
    edge = lambda df, pk, p, k, i: df.select(F.lit(pk).alias("parent_kind"), F.col(p).cast("bigint").alias("parent"), F.lit(k).alias("kind"), F.col(i).cast("bigint").alias("id"))
    nation = table(spark, sf, "nation")
    edges = edge(nation, "region", "n_regionkey", "nation", "n_nationkey").unionByName(edge(nation, "nation", "n_nationkey", "region", "n_regionkey"))
    edges = edges.unionByName(edge(table(spark, sf, "supplier"), "nation", "s_nationkey", "supplier", "s_suppkey")).unionByName(edge(table(spark, sf, "customer"), "nation", "c_nationkey", "customer", "c_custkey"))
    start = table(spark, sf, "region").agg(F.min("r_regionkey").cast("bigint").alias("id")).select(F.lit("region").alias("kind"), "id")
    return sequence.crawl(start, edges.filter("kind <> 'customer'"), ["kind", "id"], ["parent_kind", "parent"]).groupBy("kind").agg(F.count("*").alias("n"))


@query("select coalesce(lang, '') lang, count(*) n, count_if(n_chars is distinct from length(text)) differ from documents group by 1")
def figures_audit(spark, sf):
    """Stated counts of characters against counted ones."""
    d = table(spark, sf, "documents", "lang", "n_chars", "text")
    return d.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"), F.count_if(~F.col("n_chars").eqNullSafe(F.length("text").cast("bigint"))).alias("differ"))


@query("select class, case when ink_cv is null then 'note' when ink_cv < 0.81 then 'typed' else 'hand' end rule, count(*) n from (select distinct path, class, ink_cv from page_classes) group by 1, 2")
def page_class_rule(spark, sf):
    return _d(spark, sf, "page_classes", "path", "class", "ink_cv").groupBy("class", raster.page_class(F.col("ink_cv")).alias("rule")).agg(F.count("*").alias("n"))


@query("select event_id, case when wait > 7200 then 0 else wait end as wait_s from (select event_id, ((12 * 3600 + 60 - (hour(ts) * 3600 + minute(ts) * 60 + second(ts))) % 86400 + 86400) % 86400 wait from events)")
def reset_wait(spark, sf):
    return table(spark, sf, "events", "event_id", "ts").select("event_id", parse.seconds_until(F.lit("resets 12pm"), F.col("ts")).cast("bigint").alias("wait_s"))


@query(f"""with {_VARIANTS}, g as (select work, count(*) n, min({{'o': coalesce(variant, 9), 'id': portal_id, 'conj': conj, 'p': p, 'ymd': ymd}}) a, max({{'o': coalesce(variant, 9), 'id': portal_id, 'conj': conj, 'p': p, 'ymd': ymd}}) b from v group by 1)
select work, a.id first_id, b.id second_id, coalesce(not a.conj and not b.conj and b.ymd[1:least(a.p, b.p)] < a.ymd[1:least(a.p, b.p)], false) conflict from g where n = 2""")
def variant_order(spark, sf):
    """Works of two variants: is the second one dated earlier than the first, as far as both dates are known? Conjectural
    dates say nothing. The two ends of a group are its two cards, so no group is collected."""
    one = F.struct(F.coalesce("variant", F.lit(9)).alias("o"), F.col("portal_id").alias("id"), "conj", "p", "ymd")
    g = variants(spark, sf).groupBy("work").agg(F.count("*").alias("n"), F.min(one).alias("a"), F.max(one).alias("b")).filter("n = 2")
    earlier = parse.earlier_at_common_precision(F.col("b.ymd"), F.col("b.p"), F.col("a.ymd"), F.col("a.p"))
    return g.select("work", F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id"), F.coalesce(~F.col("a.conj") & ~F.col("b.conj") & earlier, F.lit(False)).alias("conflict"))


@query("select distinct opis_code, delo, case when length(delo) < 5 then lpad(delo, 5, '0') else delo end as_text, coalesce(try_cast(regexp_replace(delo, '[^0-9]', '', 'g') as int), 0) as_number from transcripts_raw where delo is not null")
def catalog_order(spark, sf):
    d = _d(spark, sf, "transcripts_raw", "opis_code", "delo").filter("delo is not null")
    return d.withColumns(parse.order_keys(F.col("delo"))).orderBy("opis_code", "as_number", "delo")


TITLE_SQL = f"""trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(case when regexp_extract(name, '"([^"]+)"', 1) <> '' then regexp_extract(name, '"([^"]+)"', 1) else name end), 'ё', 'е'), '{parse.TITLE_TAIL}', ' ', 'g'), '[^а-яa-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'), ' ')"""


@query(f"""select distinct portal_id, {TITLE_SQL} title from catalog where name is not null""")
def clean_titles(spark, sf):
    return table(spark, sf, "catalog", "portal_id", "name").filter("name is not null").select("portal_id", parse.clean_title(F.col("name")).alias("title")).distinct()


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from papyrine.plans import catalogue, reports, texts, workflow  # noqa: E402, F401  (they add their queries)
