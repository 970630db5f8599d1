"""Named reports: readings against readings, models, published texts.

Searches of readings take as queries every reading whose id is divisible by twenty, against all rows; searches of titles
take every published title.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import parse, text
from papyrine.operators import reports, similarity, stats
from papyrine.plans.queries import _pairs
from papyrine.plans.registry import cards, distinct, query
from papyrine.session import cut
from papyrine.sources.tables import table

#: The test texts are unlike one another, so the reports on them keep pairs that are less alike than usual.
LEAST = 0.1
_QUERIES = "reading_id % 20 = 0"


def _sheets(spark, sf):
    return reports.sheets(table(spark, sf, "transcripts_raw", "reading_id", "opis_code", "delo", "path", "model", "text"), distinct(spark, sf, "page_classes", "path", "class"))


def _published(spark, sf):
    """The first document of each file, as the published text of that file."""
    d = reports.documents_of(table(spark, sf, "documents", "doc_id", "source", "text").filter("text is not null"))
    first = d.groupBy("opis_code", "delo").agg(F.min_by("text", "doc_id").alias("text"))
    return first.select("opis_code", "delo", text.word_tokens(F.col("text")).alias("tokens"))


@query()
def best_counterpart(spark, sf):
    """The typed sheet of its file that is most like each handwritten sheet of the query set."""
    return reports.calibration(cut(_sheets(spark, sf)), _QUERIES, LEAST)


_TOKENS = "regexp_extract_all(lower(text), '[а-яёѣіѳѵa-z]+')"


@query(f"""with r as (select distinct reading_id, opis_code, delo, path, {_TOKENS} w from transcripts_raw where text is not null), m as (select r.*, class from r join (select distinct path, class from page_classes) using (path) where len(w) >= 40),
h as (select * from m where class = 'hand' and reading_id % 20 = 0), t as (select * from m where class = 'typed'),
hc as (select reading_id, opis_code, delo, len(w) l, x.unnest w, count(*) n from h, unnest(w) x group by all), tc as (select reading_id, opis_code, delo, len(w) l, x.unnest w, count(*) n from t, unnest(w) x group by all),
s as (select hc.opis_code, hc.delo, hc.reading_id a_id, tc.reading_id b_id, sum(least(hc.n, tc.n))::bigint common, 2.0::double * sum(least(hc.n, tc.n)) / (any_value(hc.l) + any_value(tc.l)) ratio from hc join tc using (opis_code, delo, w) group by 1, 2, 3, 4)
select * from s where ratio >= 0.25 qualify row_number() over (partition by a_id order by ratio desc, b_id) = 1""")
def best_counterpart_bound(spark, sf):
    """The same search by the multiset bound alone."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[а-яёѣіѳѵa-z]+"), F.lit(0))
    r = table(spark, sf, "transcripts_raw", "reading_id", "opis_code", "delo", "path", "text").filter("text is not null").select("reading_id", "opis_code", "delo", "path", words.alias("w"))
    m = cut(r.filter("size(w) >= 40").join(distinct(spark, sf, "page_classes", "path", "class"), "path").dropDuplicates(["reading_id"]))
    return similarity.best_in_blocks(m.filter("class = 'hand'").filter(_QUERIES), m.filter("class = 'typed'"), ["opis_code", "delo"], "reading_id", "w", 0.25, exact=False)


@query()
def calibration(spark, sf):
    return reports.calibration_figures(reports.calibration(cut(_sheets(spark, sf)), _QUERIES, LEAST))


@query()
def calibration_validation(spark, sf):
    measured = cut(_sheets(spark, sf))
    rows = reports.calibration_against_truth(reports.calibration(measured, _QUERIES, LEAST), measured, _published(spark, sf))
    return reports.truth_figures(cut(rows))


@query()
def model_comparison(spark, sf):
    """All scans that were read twice."""
    return reports.model_comparison(cut(_sheets(spark, sf)), LEAST)


@query()
def model_comparison_figures(spark, sf):
    return reports.comparison_figures(cut(reports.model_comparison(cut(_sheets(spark, sf)), LEAST)))


@query()
def ab_report(spark, sf):
    """The light model's readings against the others', on scans of calibration pairs that both have read."""
    measured = cut(_sheets(spark, sf))
    light, strong = measured.filter("model = 'reader-lite'"), measured.filter("model <> 'reader-lite'")
    # the scans that the light model has read too are the query set here
    both = cut(strong.join(light.select("path").distinct(), "path", "left_semi").unionByName(reports.typed(measured).filter("model is null or model = 'reader-lite'")).dropDuplicates(["reading_id"]))
    rows = reports.ab_rows(reports.calibration(both, "model <> 'reader-lite'", LEAST), light, strong, reports.typed(measured))
    return reports.comparison_figures(cut(rows), "agree_cheap", "agree_strong")


@query()
def candidate_models(spark, sf):
    """Agreement with the best typed sheet by model, in two strata by the number of words, older rows of a model replaced."""
    measured = cut(_sheets(spark, sf))
    agree = reports.best_typed(reports.handwritten(measured).filter(_QUERIES), reports.typed(measured))
    words = F.size("tokens")
    rows = agree.join(measured, "reading_id").select(F.coalesce("model", F.lit("")).alias("model"), F.when(words < 100, "short").otherwise("long").alias("stratum"), F.round("agree", 3).alias("agreement"), words.alias("words"), F.round("doubt", 4).alias("uncertain"), F.col("reading_id").alias("place"))
    return reports.measurement_table(rows, ["short", "long"])


def _titles(spark, sf):
    published = distinct(spark, sf, "title_en", "portal_id", "title_ru").select(F.col("portal_id").cast("bigint").alias("id"), parse.clean_title(F.col("title_ru")).alias("title"))
    files = cards(spark, sf).filter("name is not null").select(F.col("portal_id").cast("bigint").alias("id"), parse.clean_title(F.col("name")).alias("title"))
    return published, files


@query()
def best_titles(spark, sf):
    """For each published title the card whose title is most like it."""
    return reports.title_matches(*_titles(spark, sf))


@query()
def corpus_validation(spark, sf):
    """Readings of the cards that published titles match, against the documents of the published titles' cards."""
    matches = cut(reports.title_matches(*_titles(spark, sf)))
    d = table(spark, sf, "documents", "doc_id", "portal_id", "text").filter("text is not null and portal_id is not null").select(F.col("portal_id").cast("bigint").alias("id"), "doc_id", "text")
    first = d.groupBy("id").agg(F.min_by("text", "doc_id").alias("text"), F.max_by("text", "doc_id").alias("last"))
    rows = reports.against_published(matches, first.select("id", "text"), first.select("id", F.col("last").alias("text")))
    return reports.validation_figures(cut(rows))


@query()
def document_scores(spark, sf):
    """The first and the last document of each card that has several, scored against one another."""
    d = table(spark, sf, "documents", "doc_id", "portal_id", "text").filter("text is not null and portal_id is not null")
    several = d.groupBy("portal_id").agg(F.min_by("text", "doc_id").alias("ours"), F.max_by("text", "doc_id").alias("published"), F.count("*").alias("n")).filter("n >= 2")
    return several.select("portal_id", *(c.alias(k) for k, c in reports.score(F.col("ours"), F.col("published"), fold=True).items()))


@query()
def collation_report(spark, sf):
    """Differences of at least ten words between two readings of a scan, of pairs that are more alike than the middle pair."""
    p = cut(_pairs(spark, sf))
    floor = similarity.quick_ratio(p, ["a_reading_id", "b_reading_id"], "a_w", "b_w").agg(stats.upper_median("bound").alias("floor"))
    found = reports.resolved(p.join(F.broadcast(floor)), F.col("floor") / 2, least=10)
    return found.select("a_reading_id", "b_reading_id", "observed", F.size("differences").alias("n"), F.get("differences", F.lit(0)).alias("longest"))


@query("""with g as (select (year_from // 10) * 10 y10, count(*) n from (select distinct portal_id, year_from from delo_dates where year_from is not null) group by 1)
select 'en' lang, '| Decade | Files |' || chr(10) || string_agg('| ' || y10 || 's | ' || format('{:,}', n) || ' |', chr(10) order by y10) "document" from g union all select 'ru', '| Годы | Дел |' || chr(10) || string_agg('| ' || y10 || '-е | ' || format('{:,}', n) || ' |', chr(10) order by y10) from g""")
def decades_rendered(spark, sf):
    """The table of decades as text in two languages."""
    d = distinct(spark, sf, "delo_dates", "portal_id", "year_from").filter("year_from is not null")
    g = d.groupBy((F.floor(F.col("year_from") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n")).withColumn("shown", parse.thousands(F.col("n")))
    return reports.rendered(g, {"en": "| %ds | %s |", "ru": "| %d-е | %s |"}, ["decade", "shown"], ["decade"], {"en": "| Decade | Files |\n", "ru": "| Годы | Дел |\n"})
