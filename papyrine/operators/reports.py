"""Measurements of readings against one another and against published texts, and their rendering as text.

Pairs across sheets come from ``similarity.best_in_blocks``: a stated set of queries against all rows of their file, in
blocks, one row back for each query.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions import text
from papyrine.operators import similarity, stats
from papyrine.session import cut

#: Sheets of fewer words are not compared; handwriting has at least this share of doubts; pairs are at least, and at most,
#: this much alike (above, they are one page scanned twice); titles and lengths fit from here on.
LEAST_WORDS, LEAST_DOUBT, LEAST_RATIO, MOST_RATIO, LEAST_TITLE, LEAST_COVER = 40, 0.02, 0.25, 0.98, 0.75, 0.20
FILE = ["opis_code", "delo"]
#: Titles are short, so a task compares more of them than of sheets, and they are copied to fewer tasks.
TITLE_BLOCK = 2048


def sheets(readings: DataFrame, classes: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(reading_id, opis_code, delo, path, model, class, doubt, tokens) of each distinct reading of at least
    ``least_words`` words on a scan with a class; readings delivered twice count once."""
    c = F.col("text")
    r = readings.filter("text is not null").select("reading_id", *FILE, "path", "model", text.uncertainty(c).alias("doubt"), text.word_tokens(c).alias("tokens"))
    return r.filter(F.size("tokens") >= least_words).join(classes.select("path", "class").distinct(), "path").dropDuplicates(["reading_id"])


def handwritten(df: DataFrame, least: float = LEAST_DOUBT) -> DataFrame:
    """Genuine handwriting: classed so, and with doubts; one without a measure of doubt reads like typescript."""
    return df.filter((F.col("class") == "hand") & (F.coalesce("doubt", F.lit(-1.0)) >= least))


def typed(df: DataFrame) -> DataFrame:
    return df.filter("class = 'typed'")


def calibration(measured: DataFrame, queries: Column | str, least: float = LEAST_RATIO) -> DataFrame:
    """(file, hand, typed, ratio, words_hand, words_typed, longest_run): for each handwritten sheet for which ``queries``
    holds, the typed sheet of its file that is most like it, if it is at least ``least`` alike."""
    found = similarity.best_in_blocks(handwritten(measured).filter(queries), typed(measured), FILE, "reading_id", "tokens", least)
    mine = measured.select(F.col("reading_id").alias("a_id"), F.col("tokens").alias("a"))
    theirs = measured.select(F.col("reading_id").alias("b_id"), F.col("tokens").alias("b"))
    both = found.join(mine, "a_id").join(theirs, "b_id")
    return both.select(*FILE, F.col("a_id").alias("hand"), F.col("b_id").alias("typed"), F.round("ratio", 3).alias("ratio"), F.size("a").alias("words_hand"), F.size("b").alias("words_typed"), similarity.run_in_common("a", "b").alias("longest_run"))


def calibration_figures(pairs: DataFrame) -> DataFrame:
    """One row: pairs, files, median, best and worst agreement, median, longest and shortest run, share of short runs."""
    return pairs.agg(
        F.count("*").alias("pairs"), F.countDistinct(*FILE).alias("files"), stats.upper_median("ratio").alias("middle"), F.max("ratio").alias("best"), F.min("ratio").alias("worst"),
        stats.upper_median("longest_run").alias("run"), F.max("longest_run").alias("longest"), F.min("longest_run").alias("shortest"), stats.share(F.col("longest_run") < 10).alias("short_runs"),
    )


def calibration_against_truth(pairs: DataFrame, measured: DataFrame, published: DataFrame) -> DataFrame:
    """(file, hand, typed, agree, acc_hand, acc_typed): the agreement of two readings beside the agreement of each with
    the stretch of the published text (file, tokens) that fits the typed one best; without such a stretch no row."""
    mine = measured.select(F.col("reading_id").alias("hand"), F.col("tokens").alias("a"))
    theirs = measured.select(F.col("reading_id").alias("typed"), F.col("tokens").alias("b"))
    at = pairs.join(mine, "hand").join(theirs, "typed").join(published.select(*FILE, F.col("tokens").alias("hay")), FILE).withColumn("window", similarity.window_of("b", "hay")).filter("window is not null")
    return at.select(*FILE, "hand", "typed", F.col("ratio").alias("agree"), F.round(similarity.ratio("a", "window"), 3).alias("acc_hand"), F.round(similarity.ratio("b", "window"), 3).alias("acc_typed"))


def truth_figures(rows: DataFrame) -> DataFrame:
    """One row: n, medians of agreement and of both accuracies, median bias, and the rank correlation of agreement and
    accuracy (ties in the order of the hand sheets; null for fewer than three rows)."""
    figures = rows.agg(F.count("*").alias("n"), stats.upper_median("agree").alias("agree"), stats.upper_median("acc_hand").alias("acc_hand"), stats.upper_median("acc_typed").alias("acc_typed"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY acc_hand - agree DESC)").alias("bias"))
    rho = stats.spearman(rows, "agree", "acc_hand", "hand").select(F.when(F.col("n") > 2, F.col("rho")).alias("rho"))
    return figures.join(rho)  # one row beside one row


def best_typed(readings: DataFrame, references: DataFrame) -> DataFrame:
    """(reading_id, agree): how like the most similar typed sheet of its file each reading is; none without one."""
    found = similarity.best_in_blocks(readings, references, FILE, "reading_id", "tokens", least=0.0)
    return found.select(F.col("a_id").alias("reading_id"), F.col("ratio").alias("agree"))


def model_comparison(measured: DataFrame, least: float = LEAST_RATIO, most: float = MOST_RATIO) -> DataFrame:
    """Two readings of each scan of genuine handwriting, the first and the last: models, words, doubts, and the agreement
    of each with the typed sheets of the file; both are null without a typed sheet, and where the better one is below
    ``least`` or above ``most``. Doubts must be measured in both; the last one's show whether it is handwriting."""
    one = F.struct("reading_id", "model", "doubt", "tokens", *FILE)
    twice = measured.filter("doubt is not null").groupBy("path").agg(F.count("*").alias("n"), F.min_by(one, "reading_id").alias("old"), F.max_by(one, "reading_id").alias("new"), F.first("class").alias("class")).filter("n >= 2")
    kept = twice.filter((F.col("new.doubt") >= LEAST_DOUBT) & (F.col("class") == "hand"))
    sides = kept.select("old.*").unionByName(kept.select("new.*")).select("reading_id", *FILE, "tokens")
    agree = best_typed(sides, typed(measured))
    rows = kept.select("path", F.col("old.reading_id").alias("old_id"), F.col("new.reading_id").alias("new_id"), F.col("old.model").alias("model_old"), F.col("new.model").alias("model_new"), F.size("old.tokens").alias("words_old"), F.size("new.tokens").alias("words_new"), F.round("old.doubt", 4).alias("doubt_old"), F.round("new.doubt", 4).alias("doubt_new"))
    for side in ("old", "new"):
        rows = rows.join(agree.select(F.col("reading_id").alias(f"{side}_id"), F.col("agree").alias(f"agree_{side}")), f"{side}_id", "left")
    better = F.greatest("agree_old", "agree_new")
    fits = F.col("agree_old").isNotNull() & F.col("agree_new").isNotNull() & better.between(least, most)
    return rows.withColumns({f"agree_{s}": F.when(fits, F.round(f"agree_{s}", 3)) for s in ("old", "new")}).drop("old_id", "new_id")


def comparison_figures(rows: DataFrame, a: str = "agree_old", b: str = "agree_new") -> DataFrame:
    """One row: n, how many have both agreements, their medians, how often the second is better, median gain."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return rows.withColumn("_gain", F.when(both, F.col(b) - F.col(a))).agg(F.count("*").alias("n"), F.count_if(both).alias("compared"), stats.upper_median(a).alias("middle_a"), stats.upper_median(b).alias("middle_b"), F.count_if(F.col("_gain") > 0).alias("wins"), stats.upper_median("_gain").alias("gain"))


def ab_rows(pairs: DataFrame, cheap: DataFrame, strong: DataFrame, references: DataFrame) -> DataFrame:
    """(file, path, agree_cheap, agree_strong, words_cheap, words_strong): two readings of the sheets of calibration pairs,
    each against the pair's typed sheet. A chain of inner joins: sheets that lack one of the four are left out."""
    known = pairs.select(*FILE, F.col("hand").alias("reading_id"), F.col("typed"))
    at = known.join(strong.select("reading_id", "path", F.col("tokens").alias("s")), "reading_id").join(cheap.select("path", F.col("tokens").alias("c")), "path")
    at = at.join(references.select(F.col("reading_id").alias("typed"), F.col("tokens").alias("r")), "typed")
    return at.select(*FILE, "path", F.round(similarity.ratio("c", "r"), 3).alias("agree_cheap"), F.round(similarity.ratio("s", "r"), 3).alias("agree_strong"), F.size("c").alias("words_cheap"), F.size("s").alias("words_strong"))


def measurement_table(rows: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Each model's upper median of agreement in each stratum, sheets, mean words and doubts, in the order in which the
    models first appear."""
    named = [F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY agreement DESC) FILTER (WHERE stratum = '{s}')").alias(s) for s in strata]
    return rows.groupBy("model").agg(*named, F.count("*").alias("sheets"), F.avg("words").alias("mean_words"), F.avg("uncertain").alias("mean_doubt"), F.min("place").alias("place")).orderBy("place")


def title_matches(published: DataFrame, files: DataFrame, least: float = LEAST_TITLE) -> DataFrame:
    """(published, file, title_match): for each published title the file whose title is most like it, letter by letter, if
    at least ``least``; several titles may take one file, and of files equally like it the first by id is taken. Both
    frames have (id, title), titles made comparable before.

    Titles recur, so each is looked up once, however many rows have it: one that a file has as well is joined, for only
    equal titles have the ratio 1, and only those that no file has are searched among the distinct titles of files."""
    kept = lambda df: df.filter("title <> ''").select("id", "title").dropna()
    first = cut(kept(files).groupBy("title").agg(F.min("id").alias("file")))
    same = kept(published).join(first, "title").select("id", "file", F.lit(1.0).alias("ratio"))
    rest = cut(kept(published).join(first, "title", "left_anti"))
    asked = rest.select("title").distinct().select(F.col("title").alias("id"), "title")
    found = similarity.best_in_blocks(asked, first.select(F.col("file").alias("id"), "title"), [], "id", "title", least, block=TITLE_BLOCK)
    like = rest.join(found.select(F.col("a_id").alias("title"), F.col("b_id").alias("file"), "ratio"), "title").select("id", "file", "ratio")
    best = F.min(F.struct((-F.col("ratio")).alias("r"), F.col("file").alias("file"))).alias("x")
    return same.unionByName(like).groupBy("id").agg(best).select(F.col("id").alias("published"), F.col("x.file").alias("file"), F.round(-F.col("x.r"), 2).alias("title_match"))


def against_published(matches: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(published, file, title_match, words_ours, words_pub, coverage, words_raw, words_folded) of matched texts, as
    written and with old spelling made modern: the shorter text against its best place in the longer one."""
    o, t = ours.select(F.col("id").alias("file"), F.col("text").alias("o")), theirs.select(F.col("id").alias("published"), F.col("text").alias("t"))
    both = matches.join(o, "file").join(t, "published")  # texts as they are; only those of a pair are normalised
    blocks = lambda fold: similarity.best_block_of_words(text.normalize_text(F.col("o"), fold), text.normalize_text(F.col("t"), fold))
    scored = both.select("published", "file", "title_match", blocks(False).alias("raw"), blocks(True).alias("folded"))
    return scored.select("published", "file", "title_match", F.col("folded.words_a").alias("words_ours"), F.col("folded.words_b").alias("words_pub"), F.round("folded.length_ratio", 3).alias("coverage"), F.round("raw.block_ratio", 3).alias("words_raw"), F.round("folded.block_ratio", 3).alias("words_folded"))


def validation_figures(rows: DataFrame, least: float = LEAST_COVER, high: float = 0.60) -> DataFrame:
    """By whether the text is of the published edition (at least ``high`` alike): rows that cover enough, medians."""
    good = rows.filter(F.col("coverage") >= least)
    return good.groupBy((F.col("words_folded") >= high).alias("same_edition")).agg(F.count("*").alias("n"), stats.upper_median("words_folded").alias("folded"), stats.upper_median("words_raw").alias("raw"))


def score(ours: Column, published: Column, fold: bool = False) -> dict[str, Column]:
    """One text against a published one: word counts, agreement by letters and by words, and the number of differences."""
    a, b = text.normalize_text(ours, fold), text.normalize_text(published, fold)
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    script = similarity.edit_script(words(a), words(b))
    return {
        "words_ours": F.size(words(a)), "words_pub": F.size(words(b)), "letters": similarity.ratio(F.split(a, ""), F.split(b, "")), "words": similarity.ratio(words(a), words(b)),
        "differences": F.size(F.filter(script, lambda o: o["tag"] != "equal")),
    }


def resolved(pairs: DataFrame, floor: Column, a: str = "a_w", b: str = "b_w", least: int = 25) -> DataFrame:
    """The pairs with ``observed`` similarity and their ``differences`` of at least ``least`` words; a pair that is no more
    alike than ``floor`` has none, because its differences cannot be told from errors of reading."""
    scripted = pairs.withColumn("script", similarity.edit_script(a, b))
    seen = scripted.withColumn("observed", similarity.observed_similarity(F.col("script"), F.col(a), F.col(b)))
    return seen.withColumn("differences", F.when(F.col("observed") > floor, similarity.collation(F.col("script"), F.col(a), F.col(b), least))).drop("script")


def rendered(rows: DataFrame, templates: Mapping[str, str], columns: Sequence[str], order: Sequence[str], head: Mapping[str, str] | None = None) -> DataFrame:
    """(lang, document): the rows in order as lines of a template for each language, below its heading. A report is one
    document; it is meant for aggregated rows."""
    line = F.struct(*order, F.struct(*(F.format_string(t, *columns).alias(lang) for lang, t in templates.items())).alias("line"))
    whole = rows.agg(F.sort_array(F.collect_list(line)).alias("xs"))

    def document(lang: str) -> Column:
        lines = F.transform("xs", lambda x: x["line"][lang])
        return F.struct(F.lit(lang).alias("lang"), F.concat(F.lit((head or {}).get(lang, "")), F.array_join(lines, "\n")).alias("document"))

    return whole.select(F.explode(F.array(*map(document, templates))).alias("x")).select("x.*")


def documents_of(addresses: DataFrame) -> DataFrame:
    """``addresses`` (source 'opis_X/delo_NNNN') with opis_code and delo."""
    return addresses.withColumns({"opis_code": F.regexp_extract("source", r"^opis_([^/]+)/", 1), "delo": F.regexp_extract("source", r"/delo_(.+)$", 1)})
