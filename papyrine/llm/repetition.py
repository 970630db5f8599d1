"""Problem 3: the share of repeated content in every reading, and readings that mostly repeat themselves.

A reading's words are its body's words in order: no running titles, page numbers, sums and table rows; the words of
editorial marks count, the mark of doubt ``[?]`` does not; broken words joined; case, spacing, punctuation, line
division and the number before an item make no difference. Four rules mark words of second and later copies: whole
sentences, whole lines, passages of ten words and more, and loops (a stretch that goes on repeating with one period).
Set phrases that recur within different sentences are marked by none.

Weak supervision: seven labelling functions vote for repetition, against it, or abstain - the shares by each of the four
rules, the share of words that any of them marks, the packed size, and how few different words there are.
Expectation-maximisation over the counts of vote patterns (at most 3 to the number of functions) estimates how often
each function votes rightly in either class, and the posterior alone decides: no function has to pass, and each can be
outvoted. The exact share is reported beside the posterior.

A first look at all texts of a batch at once (hashes of all windows of words) finds the few in which any window comes
twice; only these are looked through for passages and loops.

Results at the edges: null, empty and blank texts have no words, share null, and are never found; texts are read
whole, whatever their length; rows delivered twice count once.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.sheets import kinds, page_number
from papyrine.llm.titles import with_titles
from papyrine.session import cut

#: The share of repeated words from which on a text counts as repeating itself; the functions on shares vote by it.
SHARE = 0.3
#: Words of the shortest repeated passage that is no set phrase.
PASSAGE = 10
#: Longest period of a loop, and the fewest words that it repeats.
PERIOD, LOOP = 60, 6

_DOUBT = re.compile(r"\[\?\]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑¬=\xad][ \t]*\n\s*(?=[^\W\d_])")
_ITEM = re.compile(r"^[ \t]*(?:№\s*\d+[.)]?|\(?\d{1,3}[.)]|[-–—•*])[ \t]+", re.M)
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?…]+|\n")
_STOP = frozenset(".!?…")


def body_text(text: str, page: int | None = None, titles: list[str] | None = None) -> str:
    """The body of a sheet: lines without running titles, page numbers, sums and table rows; broken words joined."""
    lines = text.split("\n")
    kept = [x for x, k in zip(lines, kinds(lines, page, frozenset(titles or ())), strict=True) if not k and not x.lstrip().startswith("|")]
    return _BROKEN.sub("", "\n".join(kept))


def units(text: str, page: int | None = None, titles: list[str] | None = None) -> tuple[list[str], list[tuple[int, int]], list[tuple[int, int]]]:
    """(words, sentences as (from, to) of words, lines likewise)."""
    body = body_text(text, page, titles)
    if "[?]" in body:
        body = _DOUBT.sub("", body)
    body = _ITEM.sub("", body).lower()
    words: list[str] = []
    sentences, lines = [], []
    s = n = 0
    for t in _TOKEN.findall(body):
        if t == "\n":
            if len(words) > n:
                lines.append((n, len(words)))
            n = len(words)
        elif t[0] in _STOP:
            if len(words) > s:
                sentences.append((s, len(words)))
            s = len(words)
        else:
            words.append(t)
    if len(words) > s:
        sentences.append((s, len(words)))
    if len(words) > n:
        lines.append((n, len(words)))
    return words, sentences, lines


def _copies(codes: np.ndarray, spans: list[tuple[int, int]], least: int, marked: np.ndarray) -> None:
    seen = set()
    for a, b in spans:
        if b - a >= least:
            key = codes[a:b].tobytes()
            if key in seen:
                marked[a:b] = True
            else:
                seen.add(key)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _passages(codes: np.ndarray, marked: np.ndarray) -> None:
    n, last = len(codes), -1
    seen = set()
    for i in range(n - PASSAGE + 1):
        key = codes[i : i + PASSAGE].tobytes()
        if key in seen:
            marked[max(last, i) : i + PASSAGE] = True
            last = i + PASSAGE
        seen.add(key)


def _loops(codes: np.ndarray, marked: np.ndarray) -> None:
    n = len(codes)
    for p in range(1, min(PERIOD, n // 2) + 1):
        same = codes[p:] == codes[:-p]
        if np.count_nonzero(same) >= max(p, LOOP):
            for x, y in _runs(same):
                if y - x >= max(2 * p, LOOP):
                    marked[x + p : y + p] = True


def _recurring(codes: np.ndarray, owner: np.ndarray, width: int, texts: int) -> np.ndarray:
    """For each text, whether a window of ``width`` words comes twice in it (by hash: true at least where it does)."""
    out = np.zeros(texts, bool)
    n = len(codes) - width + 1
    if n <= 1:
        return out
    whole = owner[:n] == owner[width - 1 :]
    value = owner[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        value = (value ^ codes[k : n + k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
    value, of = value[whole], owner[:n][whole]
    order = np.argsort(value, kind="stable")
    value, of = value[order], of[order]
    out[of[1:][(value[1:] == value[:-1]) & (of[1:] == of[:-1])]] = True
    return out


Measured = tuple[int, float | None, float | None, float | None, float | None, float | None, float | None, float | None]


def measure(texts: list[str | None], pages: list[int | None], titles: list[list[str] | None] | None = None) -> list[Measured]:
    """For each text (words, repeated share, the shares by sentences, lines, passages and loops, packed size, share of
    words that came before)."""
    empty = (0, *[None] * 7)
    out: list[Measured] = [empty] * len(texts)
    index: dict[str, int] = {}
    read = []
    for k, (text, page, running) in enumerate(zip(texts, pages, titles or [None] * len(texts), strict=True)):
        if text is not None and text.strip():
            words, sentences, lines = units(text, page, running)
            if words:
                read.append((k, words, sentences, lines, np.array([index.setdefault(w, len(index)) for w in words])))
    if not read:
        return out
    codes = np.concatenate([r[4] for r in read])
    owner = np.repeat(np.arange(len(read)), [len(r[4]) for r in read])
    # a loop is a stretch of at least LOOP words that all came one period before
    loops, passages = (_recurring(codes, owner, width, len(read)) for width in (LOOP, PASSAGE))
    for (k, words, sentences, lines, own), loop, passage in zip(read, loops.tolist(), passages.tolist(), strict=True):
        n = len(words)
        again = 1 - len(set(words)) / n
        raw = " ".join(words).encode()
        packed = len(zlib.compress(raw, 1)) / len(raw)
        by = np.zeros((4, n), bool)
        if again > 0:
            _copies(own, sentences, 2, by[0])
            _copies(own, lines, 3, by[1])
            if passage:
                _passages(own, by[2])
            if loop:
                _loops(own, by[3])
        by_rule = (np.count_nonzero(by, axis=1) / n).tolist() if by.any() else [0.0] * 4
        out[k] = (n, np.count_nonzero(by.any(axis=0)) / n, *by_rule, packed, again)
    return out


def shares(text: str | None, page: int | None = None) -> Measured:
    """``measure`` of one text."""
    return measure([text], [page])[0]


#: The labelling functions: (column, from here on it votes for repetition, up to here it votes against; between, it abstains).
RULES = [
    ("sentences", SHARE, 0.02), ("lines", SHARE, 0.02), ("passages", SHARE, 0.02), ("loops", SHARE, 0.02),
    ("share", SHARE, SHARE / 2), ("packed", -0.25, -0.45), ("again", 0.6, 0.4),
]
_NAMES = ["words", "share", "sentences", "lines", "passages", "loops", "packed", "again"]


def with_shares(readings: DataFrame) -> DataFrame:
    """(reading_id, words, share, sentences, lines, passages, loops, packed, again) of each distinct reading."""

    def measured(batches):
        for batch in batches:
            rows = measure(batch.column(2).to_pylist(), [page_number(p) for p in batch.column(1).to_pylist()], batch.column(3).to_pylist())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
            arrays = [pa.array(c, pa.int64() if k == 0 else pa.float64()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["reading_id", *_NAMES])

    kept = readings.filter("reading_id is not null").withColumn("reading_id", F.col("reading_id").cast("bigint"))
    schema = "reading_id bigint, words bigint, " + ", ".join(f"{c} double" for c in _NAMES[1:])
    # the texts stay where they are; only the numbers of rows delivered twice are shuffled
    return with_titles(kept, ["reading_id", "page", "text"]).mapInArrow(measured, schema).distinct()


def _votes() -> F.Column:
    code = F.lit(0)
    for k, (name, high, low) in enumerate(RULES):
        x = -F.col(name) if high < 0 else F.col(name)
        vote = F.when(x >= high, 1).when(x <= low, 2).otherwise(0)
        code = code + vote * (3**k)
    return F.when(F.col("words") >= 1, code).cast("bigint")


class RepetitionModel:
    """How often each function votes rightly, learned from counts of vote patterns; code: base-3 digits, 1 for, 2 against.

    ``rate[function][class][vote]``; the class is 1 for texts that repeat themselves. The starting rates only say which
    class is which; added weight keeps a vote that was never seen from deciding alone.
    """

    START = [[0.25, 0.05, 0.70], [0.25, 0.65, 0.10]]
    ADDED = 2.0

    def __init__(self, patterns: dict[int, int], rounds: int = 50):
        self.prior = [0.9, 0.1]
        self.rate = [[list(v) for v in self.START] for _ in RULES]
        for _ in range(rounds):
            weight = [1.0, 1.0]
            hits = [[[self.ADDED * x for x in v] for v in self.START] for _ in RULES]
            for code, n in patterns.items():
                p = self.posterior(code)
                for c, q in enumerate((1 - p, p)):
                    weight[c] += n * q
                    x = code
                    for r in range(len(RULES)):
                        hits[r][c][x % 3] += n * q
                        x //= 3
            self.prior = [w / sum(weight) for w in weight]
            self.rate = [[[v / sum(hits[r][c]) for v in hits[r][c]] for c in range(2)] for r in range(len(RULES))]

    def posterior(self, code: int) -> float:
        log = [math.log(p) for p in self.prior]
        for r in range(len(RULES)):
            for c in range(2):
                log[c] += math.log(self.rate[r][c][code % 3])
            code //= 3
        return 1 / (1 + math.exp(max(-700, min(700, log[0] - log[1]))))


def repetition(readings: DataFrame) -> DataFrame:
    """``with_shares`` with ``posterior``: the probability that the reading repeats itself (null without words)."""
    table = cut(with_shares(readings).withColumn("votes", _votes()))
    counts = {r["votes"]: r["n"] for r in table.filter("votes is not null").groupBy("votes").agg(F.count("*").alias("n")).collect()}  # <= 3 ** rules
    model = RepetitionModel(counts)
    found = table.sparkSession.createDataFrame([(v, model.posterior(v)) for v in counts], "votes bigint, posterior double")
    return table.join(F.broadcast(found), "votes", "left").drop("votes")


def repeating(readings: DataFrame) -> DataFrame:
    """reading_id of the readings that repeat themselves: those whose posterior is at least one half."""
    return repetition(readings).filter("posterior >= 0.5").select("reading_id")
