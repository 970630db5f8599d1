"""Problem 2: readings whose text was cut, and how often each source (model) cuts.

Lengths are censored from above: a source with a field limit shows an atom of readings of exactly that length, in
characters or in bytes. For each source the candidate limits are the lengths that are far more frequent than those
around them; a log-normal length distribution is fitted by maximum likelihood (expectation-maximisation over the
histogram of lengths) with the readings at a limit right-censored there, and the censoring posterior of a limit is the
part of its atom that the fitted density does not explain. Away from the limits a text may have been cut in transfer, at
any place of it: what speaks for that is the source's rate of such cuts, and the length, since under the same fit texts
cut somewhere are of other lengths than whole ones (E[1/X; X > c] against f(c)).

How the body ends is the other evidence, one of a few kinds of ending. How likely each kind is among the cut and among
the whole readings of a source, and the rate of cuts in transfer, are estimated for each source by
expectation-maximisation over counts of (kind, censoring log odds), from common starting values that weigh as much as a
number of readings. A closed ending - a full sentence, row, total, signature, date - is no case by definition; its
likelihood under a cut is held at ``CLOSED_CUT``. The posterior is the prior odds of the place and length times the
source's likelihood ratio of the kind.

The ends of labels, signatures and date lines are compared with the ends of all others: one that is the beginning of
a far more frequent one is cut. The texts are read in one narrow pass; what is shuffled is a few numbers a reading.

Results at the edges: null, empty and blank texts and sheets without a body are no cuts (posterior null); a null model
is a source of its own, reported as null; rows delivered twice count once; texts are read whole.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.sheets import BARE, MARK, TOTAL, kinds, page_number
from papyrine.llm.titles import with_titles
from papyrine.session import cut

_END = re.compile(r"[.!?…][»”\"')\]]*$")
_MARK_END = re.compile(r"(?:\s*(?:\[[^\[\]\s?][^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]|~~))+$")
_SIGNATURE = re.compile(r"[^\W\d_]\.\s+([^\W\d_][^\W\d_’'-]*(?:-[^\W\d_]*)?)")
_DATE_LINE = re.compile(r"\d{1,2}\s+([^\W\d_]+)\s+1[5-9]\d\d\s+г\.\s+([^\W\d_].*)")
_DATE_PART = re.compile(r"\d{1,2}\s+[^\W\d_]+(?:\s+\d{1,4}(?:\s+г)?\.?)?")
_OPEN = re.compile(r"\[[^\[\]]*$")

#: Kinds of ending: the body is finished, it is not (for several reasons), or it cannot be told from the ending.
FINISHED = "finished"
# no stop; half a character; an open mark; half a row, sum, item or date
UNFINISHED, BROKEN, OPEN, HALF = "unfinished", "broken", "open", "half"
# an illegible place after no stop; a stop inside an open quotation
DOUBTFUL_MARK, QUOTE = "doubtful", "quote"
#: Starting likelihoods of each kind: (among whole readings, among cut ones). Whole readings rarely end openly.
START = {
    FINISHED: (0.98, None), UNFINISHED: (8e-5, 0.80), BROKEN: (3e-6, 0.03), OPEN: (5e-6, 0.05), HALF: (7e-6, 0.07),
    DOUBTFUL_MARK: (0.01, 0.02), QUOTE: (0.01, 0.02),
}
#: The likelihood of a closed ending under a cut.
CLOSED_CUT = 1e-5
#: How many readings the starting likelihoods weigh at least. Those of whole readings weigh as much as the source's own
#: readings: away from limits an open ending alone cannot tell a source that cuts from one that does without stops.
ADDED = 50.0
#: The least rate of cuts in transfer, so that a large source with few cuts does not lose them.
LEAST_PRIOR = 0.01
#: The most that a length alone can speak for or against a cut in transfer (log odds).
LENGTH_ODDS = 1.0
#: A limit's length must be this many times as frequent as those around it, and have this many unfinished readings.
EXCESS, LEAST = 6.0, 4
#: How far around a length the comparison goes.
AROUND = 40
#: A tail is cut if a longer one that begins with it is this many times as frequent.
TAIL = 10


def ending(text: str | None, page: int | None = None, titles: list[str] | None = None) -> tuple[int, int, str, str | None, str | None] | None:
    """(characters and bytes up to the end of the body, evidence, kind and text of a tail to compare), or None."""
    if text is None or not text.strip():
        return None
    lines = text.split("\n")
    kind = kinds(lines, page, frozenset(titles or ()))
    body = [i for i, x in enumerate(lines) if x.strip() and kind[i] not in ("header", "page_number")]
    if not body:
        return None
    k = body[-1]
    upto = "\n".join(lines[: k + 1])
    broken = upto.endswith("�")
    bare = upto.rstrip("�")
    evidence, tail_kind, tail = _evidence(lines, kind, body)
    if broken:
        evidence, tail_kind, tail = BROKEN, None, None
    return len(upto), len(bare.encode("utf-8", "surrogatepass")), evidence, tail_kind, tail


def _evidence(lines: list[str], kind: list[str], body: list[int]) -> tuple[str, str | None, str | None]:
    k = body[-1]
    last = lines[k].strip()
    before = lines[body[-2]].strip() if len(body) > 1 else ""
    if last[0] == "|":
        rows = [lines[i].strip() for i in body if lines[i].lstrip().startswith("|")]
        whole = last[-1] == "|" and len(last) > 1 and (len(rows) < 2 or last.count("|") == rows[0].count("|"))
        return (FINISHED if whole else HALF), None, None
    if TOTAL.fullmatch(last):
        figures = []
        for i in reversed(body[:-1]):
            if BARE.fullmatch(lines[i].strip()):
                figures.append(lines[i].strip())
            elif not MARK.fullmatch(lines[i]):
                break
        total = last.split()[-1]
        if not total.isdigit():
            return HALF, None, None
        worked = str(sum(map(int, figures))) if figures and all(map(str.isdigit, figures)) else total
        return (HALF if worked != total and worked.startswith(total) else FINISHED), None, None
    if BARE.fullmatch(last) and BARE.fullmatch(before):
        return HALF, None, None  # a column without its total
    if _OPEN.search(last) or last.count("~~") % 2:
        return OPEN, None, None
    if found := _DATE_LINE.fullmatch(last):
        return FINISHED, "date", found[2]
    if found := _SIGNATURE.fullmatch(last):
        return FINISHED, "signature", found[1]
    if _DATE_PART.fullmatch(last):
        return HALF, None, None
    if found := _MARK_END.search(last):
        rest = last[: found.start()].rstrip()
        if not rest:
            # marks on lines of their own: what stands before them counts
            i = len(body) - 1
            while i >= 0 and _MARK_END.fullmatch(lines[body[i]].strip()):
                i -= 1
            if i < 0:
                return FINISHED, None, None
            rest = lines[body[i]].strip()
            # a figure, formula or drawing ends a sheet as well
            if not found[0].lstrip().startswith(("[неразборчиво", "~~")):
                return FINISHED, None, None
            if len(body) - 1 - i >= 2 or rest[0] == "|" or BARE.fullmatch(rest) or TOTAL.fullmatch(rest) or _SIGNATURE.fullmatch(rest) or _DATE_LINE.fullmatch(rest):
                return FINISHED, None, None
        if _END.search(re.sub(r"\[\?\]\s*$", "", rest)):
            return FINISHED, None, None
        return (DOUBTFUL_MARK if found[0].rstrip().endswith("]") else UNFINISHED), None, None
    if _END.search(last) and not last.endswith("[?]"):
        if re.fullmatch(r"\(?\d{1,3}[.)]|№ ?\d+[.)]?|[^\W\d_]\.", last):
            return HALF, None, None  # the number of an item or an initial, with nothing after it
        opened = last.count("«") - last.count("»")
        return (QUOTE if opened > 0 and "«" in last and not last.endswith("»") else FINISHED), None, None
    if len(body) == 1 and len(last) <= 40 and last[0].isupper():
        return FINISHED, "label", last
    return UNFINISHED, None, None


def endings(readings: DataFrame) -> DataFrame:
    """(reading_id, model, chars, bytes, evidence, tail_kind, tail) of each distinct reading; nulls where there is no body."""
    names = ["chars", "bytes", "evidence", "tail_kind", "tail"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def measure(batches):
        for batch in batches:
            read = zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)
            rows = [ending(t, page_number(p), running) or (None,) * 5 for t, p, running in read]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["reading_id", "model", *names])

    kept = readings.filter("reading_id is not null").withColumn("reading_id", F.col("reading_id").cast("bigint"))
    return with_titles(kept, ["reading_id", "model", "page", "text"]).mapInArrow(measure, "reading_id bigint, model string, chars bigint, bytes bigint, evidence string, tail_kind string, tail string").distinct()


def _cut_tails(table: DataFrame) -> DataFrame:
    """(tail_kind, tail) that are the beginning of a far more frequent tail; a single ъ more is another spelling."""
    counts = table.filter("tail is not null").groupBy("tail_kind", "tail").agg(F.count("*").alias("n"))
    prefixes = counts.filter(f"n >= {TAIL} and length(tail) between 2 and 60").select(
        "tail_kind", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("tail") - 1), lambda k: F.struct(F.substr("tail", F.lit(1), k).alias("p"), F.substr("tail", k + 1).alias("rest")))).alias("x")
    )
    longest = prefixes.filter("x.rest <> 'ъ'").groupBy("tail_kind", F.col("x.p").alias("tail")).agg(F.max("n").alias("longer"))
    return counts.join(longest, ["tail_kind", "tail"]).filter(f"longer >= {TAIL} * n").select("tail_kind", "tail", F.lit(True).alias("cut_tail"))


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Limits of one source and unit with their censoring posteriors, from the histogram of its lengths; first a row
    with the fit alone."""
    length, n = pdf["length"].to_numpy(float), pdf["n"].to_numpy(float)
    limit = pdf["candidate"].to_numpy(bool)
    out = pd.DataFrame({"source": pdf["source"].iloc[0], "unit": pdf["unit"].iloc[0], "limit": pd.array([None, *pdf["length"][limit]], dtype="Int64")})
    z = np.log(np.maximum(length, 1))
    total = n.sum()
    censored = np.where(limit, 0.8, 0.0)
    mu, sigma = float(np.average(z, weights=n)), max(0.05, float(np.sqrt(np.cov(z, aweights=n, ddof=0))) if len(z) > 1 else 0.05)
    for _ in range(40):
        a = (z - mu) / sigma
        density = np.exp(-a * a / 2) / math.sqrt(2 * math.pi)
        above = np.maximum(0.5 * np.vectorize(math.erfc)(a / math.sqrt(2)), 1e-12)
        hazard = density / above
        # moments of a log length that is known to lie above the limit
        first = mu + sigma * hazard
        second = mu * mu + sigma * sigma + sigma * (z + mu) * hazard
        w, c = n * (1 - censored), n * censored
        mu = float((w * z + c * first).sum() / total)
        sigma = max(0.05, math.sqrt(max(1e-6, float((w * z * z + c * second).sum() / total) - mu * mu)))
        expected = total * density / (sigma * np.maximum(length, 1))
        censored = np.where(limit, np.clip(1 - expected / n, 0.01, 0.99), 0.0)
    return out.assign(posterior=[math.nan, *censored[limit]], mu=mu, sigma=sigma)


def limits(table: DataFrame) -> DataFrame:
    """(source, unit, limit, posterior, mu, sigma) of every candidate limit, and once for each source and unit with a null
    limit; source '' stands for a null model."""
    source = F.coalesce(F.col("model"), F.lit("")).alias("source")
    both = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("x")
    histogram = (
        table.filter("chars is not null")
        .select(source, both, F.col("evidence").isin(UNFINISHED, BROKEN, OPEN, HALF).cast("int").alias("open"))
        .groupBy("source", "x.unit", "x.length")
        .agg(F.count("*").alias("n"), F.sum("open").alias("open"))
    )
    near = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-AROUND, AROUND)
    usual = (F.sum("open").over(near) - F.col("open")) / (2 * AROUND)
    marked = histogram.withColumn("candidate", (F.col("open") >= LEAST) & (F.col("open") >= EXCESS * F.greatest(usual, F.lit(0.15))) & (2 * F.col("open") >= F.col("n")))
    return marked.groupBy("source", "unit").applyInPandas(_fit, "source string, unit string, limit bigint, posterior double, mu double, sigma double")


def _likelihoods(pdf: pd.DataFrame) -> pd.DataFrame:
    """(source, evidence, weight, rate) of one source from counts of (evidence, censoring log odds, at a limit)."""
    kinds_ = list(START)
    kind = pdf["evidence"].map(kinds_.index).to_numpy()
    n, odds, limit = pdf["n"].to_numpy(float), pdf["odds"].to_numpy(float), pdf["at_limit"].to_numpy(bool)
    start = np.array([[u, CLOSED_CUT if c is None else c] for u, c in START.values()]).T
    start /= start.sum(axis=1, keepdims=True)
    theta, rate = start.copy(), 0.05
    added = (max(ADDED, float(n.sum())), ADDED)
    for _ in range(60):
        prior = np.where(limit, odds, odds + math.log(rate / (1 - rate)))
        cut_part = 1 / (1 + np.exp(-np.clip(prior + np.log(theta[1][kind] / theta[0][kind]), -700, 700)))
        for c, part in enumerate((1 - cut_part, cut_part)):
            theta[c] = np.bincount(kind, n * part, len(kinds_)) + added[c] * start[c]
        theta[1][[k for k, (_, c) in enumerate(START.values()) if c is None]] = 0
        theta /= theta.sum(axis=1, keepdims=True)
        theta[1] = np.maximum(theta[1], CLOSED_CUT)
        away = ~limit
        rate = max(LEAST_PRIOR, min(0.99, float((n * cut_part)[away].sum() + 0.5) / float(n[away].sum() + 10)))
    return pd.DataFrame({"source": pdf["source"].iloc[0], "evidence": kinds_, "weight": np.log(theta[1] / theta[0]), "rate": rate})


def _length_odds(length: str) -> F.Column:
    """Log of E[1/X; X > c] / f(c) under the source's log-normal fit: cut at any place against whole, by length alone."""
    z = (F.log(F.greatest(F.col(length), F.lit(1))) - F.col("mu")) / F.col("sigma")
    y = z + F.col("sigma")
    # the upper tail of the normal distribution, to 0.0002
    tail = 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * y + 0.07056 * y * y * y)))
    cut_ = -F.col("mu") + F.col("sigma") * F.col("sigma") / 2 + F.log(F.greatest(tail, F.lit(1e-300)))
    whole = -z * z / 2 - F.log(F.col("sigma") * F.greatest(F.col(length), F.lit(1)) * math.sqrt(2 * math.pi))
    return F.greatest(F.lit(-LENGTH_ODDS), F.least(F.lit(LENGTH_ODDS), cut_ - whole))


def truncation(readings: DataFrame, fitted: bool = True) -> DataFrame:
    """(reading_id, model, chars, bytes, evidence, at_limit, posterior, is_cut): one row for each distinct reading.

    The limits, fits and likelihoods are a handful of rows for each source and are broadcast below Spark's own threshold
    only. ``fitted`` false leaves the length distributions out, to see what they decide.
    """
    table = cut(endings(readings))
    table = table.join(_cut_tails(table), ["tail_kind", "tail"], "left").withColumn("evidence", F.when(F.col("cut_tail"), UNFINISHED).otherwise(F.col("evidence")))
    found = cut(limits(table))
    # a broken last character leaves up to three bytes unwritten
    chars = found.filter("unit = 'chars' and limit is not null").select("source", F.col("limit").alias("chars"), F.col("posterior").alias("by_chars"))
    octets = found.filter("unit = 'bytes' and limit is not null").select("source", F.explode(F.sequence(F.col("limit") - 3, F.col("limit"))).alias("bytes"), F.col("posterior").alias("p"))
    octets = octets.groupBy("source", "bytes").agg(F.max("p").alias("by_bytes"))
    fits = found.filter("unit = 'chars' and limit is null").select("source", "mu", "sigma")
    joined = (
        table.withColumn("source", F.coalesce(F.col("model"), F.lit("")))
        .join(chars, ["source", "chars"], "left")
        .join(octets, ["source", "bytes"], "left")
        .join(fits, "source", "left")
    )
    at_limit = F.greatest(F.coalesce("by_chars", F.lit(0.0)), F.coalesce("by_bytes", F.lit(0.0)))
    if not fitted:
        at_limit = F.lit(0.0)
    joined = joined.withColumn("p", at_limit).withColumn("at_limit", F.col("p") > 0)
    away = F.coalesce(_length_odds("chars"), F.lit(0.0)) if fitted else F.lit(0.0)
    joined = joined.withColumn("odds", F.round(F.when(F.col("at_limit"), F.log(F.col("p") / (1 - F.col("p")))).otherwise(away), 1))
    counts = joined.filter("evidence is not null").groupBy("source", "evidence", "odds", "at_limit").agg(F.count("*").alias("n"))
    learned = counts.groupBy("source").applyInPandas(_likelihoods, "source string, evidence string, weight double, rate double")
    scored = joined.join(learned, ["source", "evidence"], "left")
    prior = F.col("odds") + F.when(F.col("at_limit"), 0.0).otherwise(F.log(F.col("rate") / (1 - F.col("rate"))))
    return scored.select(
        "reading_id", "model", "chars", "bytes", "evidence", "at_limit", F.when(F.col("evidence").isNotNull(), 1 / (1 + F.exp(-(prior + F.col("weight"))))).alias("posterior")
    ).withColumn("is_cut", F.coalesce(F.col("posterior") > 0.5, F.lit(False)))


def truncated(readings: DataFrame) -> DataFrame:
    """reading_id of the readings whose text was cut."""
    return truncation(readings).filter("is_cut").select("reading_id").distinct()


def truncation_by_source(readings: DataFrame) -> DataFrame:
    """(model, readings, cut, at_limit, share): how often each source cuts. Readings without a body count as uncut."""
    return (
        truncation(readings)
        .groupBy("model")
        .agg(F.count("*").alias("readings"), F.count_if("is_cut").alias("cut"), F.count_if(F.col("is_cut") & F.col("at_limit")).alias("at_limit"))
        .withColumn("share", F.col("cut") / F.col("readings"))
    )
