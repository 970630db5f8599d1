"""Problem 8: text statistics of every document, and prose told apart from lists, tables and junk.

Each document's statistics come from one pass over its whole text. Rules on them are noisy labelling functions: each
votes for one type (prose, list, table, junk) or abstains. How often a rule votes rightly and wrongly is learned
without labels, by expectation-maximisation over the patterns of votes; a document's type is the one with the largest
posterior. Documents are added up to vote patterns first (at most 2 to the number of rules, a few hundred in
practice), so the model sees counts of all documents and the driver never sees a document.

Results at the edges: null and blank texts have zero counts, null ratios and no type; very long texts are read whole;
repeated rows are documents of their own. Words are compared with ``common_words`` in lower case and modern spelling.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.tokenizer import portions
from papyrine.session import cut

TYPES = ("prose", "list", "table", "junk")

# Pre-reform letters and their modern ones.
MODERN = str.maketrans("ѣіѳѵ", "еифи")

_MARK = re.compile(r"~~|\[\?\]|\[(?:[^\[\]]|\[[^\[\]]*\])*\]")
_WORD = re.compile(r"[^\W\d_]+")
_ITEM = re.compile(r"(?:[-–—•*·▪◦‣+]|\(?\d{1,3}[.)]|№ ?\d+|[a-zа-я]\))\s+\S")
_INLINE = re.compile(r"\(?\d{1,3}\)")
_COLON = re.compile(r"[^:.!?]{0,30}(?:\b[^\W\d_]\. ?){1,2}[^:.!?]{0,20}: ")
_TAIL = re.compile(r"[,—–-] ?\d[^\n]{0,8}(?:шт|л|с|стр|экз|г|pcs?|p|S|Bl)ъ?\.?$")
_SENTENCE = re.compile(r"(?:[^\W\d_]{2}|[\d»”\"')\]])[.!?…]+[»”\"')\]]*$|[!?…][»”\"')]+$")
_CELL = re.compile(r"[-+]?\d+(?:[.,/:]\d+)*%?|\d{1,2}/[IVX]+|—|–|-|\[\?\]|---+|\.\.\.|…")
_MIXED = re.compile(r"(?=\S*\d)(?=\S*[^\W\d_])[\w#@%$&]{6,}")
_JUMBLED = re.compile(r"[^\W\d_][,;:!?»«)(][^\W\d_]|[^\W\d_A-ZА-ЯЁІѢѲ][A-ZА-ЯЁІѢѲ]")
_IMPOSSIBLE = re.compile(r"(?<![^\W\d_])[ьыъЬЫЪ]|[бвгджзйклмнпрстфхцчшщ]{5}|[bcdfghjklmnpqrtvwxz]{5}|[аеиоуыэюяё]{4}|[ьъ][ьъыаоуэ]|ё[ё]|[жшчщ]ы")
_STRANGE = re.compile(r"[\x80-\xbfÐÑÒ]")

STATISTICS = {
    "chars": pa.int64(), "words": pa.int64(), "mean_word_length": pa.float64(), "symbol_ratio": pa.float64(), "digit_ratio": pa.float64(),
    "lines": pa.int64(), "punctuated_lines": pa.float64(), "common_words_share": pa.float64(), "sentence_ends": pa.int64(), "item_lines": pa.float64(),
    "cell_share": pa.float64(), "mark_share": pa.float64(), "mixed_share": pa.float64(), "votes": pa.int64(),
}
_SQL = {pa.int64(): "bigint", pa.float64(): "double"}


def common_forms(words: list[tuple[str, str]]) -> frozenset[str]:
    """The common words of all languages in the form words of a text are compared in. Lists of at most some thousand
    words are meant: they are shipped to the workers."""
    return frozenset(w.casefold() for _, w in words if w)


def _modern(word: str) -> str:
    word = word.translate(MODERN)
    return word[:-1] if len(word) > 1 and word[-1] == "ъ" else word


RULES: list[tuple[str, str]] = [
    ("prose", "common words"), ("prose", "sentences"), ("prose", "long lines of words"),
    ("list", "item lines"), ("list", "inline items"), ("list", "short lines"), ("list", "name and thing"), ("list", "counted things"),
    ("table", "cells"), ("table", "separators"), ("table", "name and value"),
    ("junk", "marks"), ("junk", "symbols"), ("junk", "only common words"), ("junk", "no common word"), ("junk", "letters with digits"), ("junk", "strange letters"), ("junk", "no sentence"), ("junk", "jumbled letters"), ("junk", "impossible words"), ("prose", "finished"),
]


# What is added up over the tokens (split at white space) of a text.
TOKEN = ("size", "words", "letters", "digits", "common", "cell", "ends", "mixed", "strange", "jumbled", "impossible", "capital", "inline", "marked")


class Measure:
    """Statistics of the texts of a batch. What a token adds is worked out once for each distinct one and cached."""

    def __init__(self, common: frozenset[str], entries: int = 300_000):
        self.common, self.entries = common, entries
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.values: list[tuple[int, ...]] = []
        self.table = np.zeros((0, len(TOKEN)), np.int64)

    def token(self, t: str) -> tuple[int, ...]:
        if t[0] == "\x01":  # a mark, its inner spaces removed
            return (len(t) - 1, 0, 0, 0, 0, int(t == "\x01[?]"), 0, 0, 0, 0, 0, 0, 0, len(t) - 1)
        words = _WORD.findall(t.lower())
        letters = sum(map(len, words))
        initial = len(t) == 2 and t[1] == "." and letters == 1
        common = 0 if initial else sum(w in self.common or _modern(w) in self.common for w in words)
        return (
            len(t), len(words), letters, sum(map(str.isdigit, t)), common, int(bool(_CELL.fullmatch(t.strip(",;")))), int(bool(_SENTENCE.search(t))),
            len(t) if _MIXED.fullmatch(t) else 0, len(_STRANGE.findall(t)), int(bool(_JUMBLED.search(t)) and not t.isupper() and "'" not in t), int(bool(_IMPOSSIBLE.search(t.lower()))), int(t.lstrip("«„“\"'([—")[:1].isupper()), int(bool(_INLINE.fullmatch(t))), 0,
        )

    def sums(self, tokens: list[str], counts: list[int]) -> np.ndarray:
        if len(self.index) > self.entries:
            self.clear()
        for t in set(tokens).difference(self.index):
            self.index[t] = len(self.values)
            self.values.append(self.token(t))
        if len(self.table) < len(self.values):
            self.table = np.array(self.values, np.int64)
        codes = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        total = np.zeros((len(tokens) + 1, len(TOKEN)), np.int64)
        np.cumsum(self.table[codes], axis=0, out=total[1:])
        ends = np.cumsum([0, *counts])
        return total[ends[1:]] - total[ends[:-1]]

    def statistics(self, texts: list[str | None]) -> list[tuple]:
        """The values of ``STATISTICS`` for each text."""
        tokens: list[str] = []
        counts, shapes = [], []
        for text in texts:
            if text is None or not text.strip():
                counts.append(0)
                shapes.append(None)
                continue
            lines = [x for line in text.splitlines() if (x := line.strip()) and x != "---" and not x.startswith("## ")]
            body = "\n".join(lines)
            if "[" in body or "~~" in body:
                body = _MARK.sub(lambda m: " \x01" + "".join(m[0].split()) + " ", body)
            if "|" in body:
                body = body.replace("|", " ")
            own = body.split()
            tokens += own
            counts.append(len(own))
            n = len(lines)
            ended = sum(x[-1] in ".!?…:;,»”\"')]" for x in lines)
            items = sum(not x[0].isalpha() and _ITEM.match(x) is not None for x in lines)
            colons = sum(_COLON.match(x) is not None for x in lines) if body.count(":") * 2 >= n else 0
            tails = sum(_TAIL.search(x) is not None for x in lines) if n >= 2 else 0
            separated = sum("\t" in x or x.count("|") >= 2 for x in lines) if "\t" in text or "|" in text else 0
            pairs = sum(";" in x for x in lines) if ";" in body else 0
            shapes.append((n, ended, items, colons, tails, separated, pairs))
        rows = []
        for text, shape, x in zip(texts, shapes, self.sums(tokens, counts).tolist(), strict=True):
            if shape is None:
                rows.append((len(text or ""), 0, None, None, None, 0, None, None, 0, None, None, None, None, None))
            else:
                rows.append(self.row(len(text), counts, shape, dict(zip(TOKEN, x, strict=True))))
        return rows

    @staticmethod
    def row(chars: int, counts: list[int], shape: tuple, x: dict[str, int]) -> tuple:
        n_lines, ended, items, colons, tails, separated, pairs = shape
        lines, dense, n = max(1, n_lines), max(1, x["size"]), x["words"]
        ended, items, separated = ended / lines, items / lines, separated / lines
        share = x["common"] / n if n else 0.0
        slots = x["words"] + x["cell"]
        cells = x["cell"] / slots if slots else 0.0
        symbols = (dense - x["letters"] - x["digits"] - x["marked"]) / dense
        marked, mixed, per_end = x["marked"] / dense, x["mixed"] / dense, n / x["ends"] if x["ends"] else math.inf
        votes = [
            n >= 3 and 0.03 <= share <= 0.62,
            x["ends"] >= 1 and 3 <= per_end <= 24 and 2 * x["capital"] >= x["ends"],
            n / lines >= 3.2 and cells < 0.25 and ended > 0.05,
            n_lines >= 3 and items >= 0.5,
            x["inline"] >= 3 and n / x["inline"] <= 7,
            n_lines >= 3 and n / lines <= 4 and x["ends"] == 0 and cells < 0.25 and ended < 0.25 and x["mixed"] == 0,
            n_lines >= 2 and colons / lines >= 0.5,
            n_lines >= 2 and tails / lines >= 0.5,
            cells >= 0.35,
            separated >= 0.5 and n_lines >= 2,
            pairs / lines >= 0.5 and cells >= 0.25,
            marked >= 0.5,
            symbols >= 0.3 and cells < 0.3 and separated < 0.3,
            n >= 8 and share > 0.7,
            n >= 15 and share < 0.03 and items < 0.3 and x["inline"] < 3 and cells < 0.25 and n / lines > 4,
            mixed >= 0.3,
            x["strange"] / dense >= 0.2,
            n >= 25 and per_end > 60 and n / lines > 6,
            n >= 8 and x["jumbled"] / n >= 0.02,
            n >= 8 and x["impossible"] / n >= 0.08,
            n >= 3 and x["ends"] >= 1 and items == 0 and colons / lines < 0.5 and cells < 0.25 and x["jumbled"] == 0 and x["impossible"] / n < 0.08 and x["capital"] >= 1 and per_end <= 24,
        ]
        code = sum(1 << k for k, v in enumerate(votes) if v)
        mean = x["letters"] / n if n else None
        return (chars, n, mean, symbols, x["digits"] / dense, n_lines, ended, share, x["ends"], items, cells, marked, mixed, code)


#: A list of common words is shared with every task, so it may not be longer; 148 words are usual.
MOST_COMMON = 100_000


def with_statistics(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the statistics, votes): one row for each row of ``documents``."""
    listed = common_words.select("lang", "word").dropna().limit(MOST_COMMON + 1).collect()
    if len(listed) > MOST_COMMON:
        raise ValueError(f"a list of common words has at most {MOST_COMMON} words")
    common = common_forms([tuple(r) for r in listed])

    def measure(batches):
        of = Measure(common)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts):
                columns = list(zip(*of.statistics(texts[a:b]), strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, STATISTICS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *arrays], [key, *STATISTICS])

    schema = ", ".join(f"{k} {_SQL[t]}" for k, t in STATISTICS.items())
    return documents.select(key, text).mapInArrow(measure, f"`{key}` {documents.schema[key].dataType.simpleString()}, {schema}")


class VoteModel:
    """Accuracies of the rules and posteriors of the types, learned from counts of vote patterns."""

    def __init__(self, patterns: dict[int, int], rounds: int = 60):
        self.patterns = patterns
        k = len(TYPES)
        own = [TYPES.index(t) for t, _ in RULES]
        # where they begin: a rule votes for its own type in half of the cases, for another one seldom
        self.prior = [1 / k] * k
        self.rate = [[0.5 if c == own[r] else 0.05 for c in range(k)] for r in range(len(RULES))]
        for _ in range(rounds):
            weight = [1.0] * k
            hit = [[0.5 if c == own[r] else 0.02 for c in range(k)] for r in range(len(RULES))]
            for code, n in patterns.items():
                p = self.posterior(code)
                for c in range(k):
                    weight[c] += n * p[c]
                    for r in range(len(RULES)):
                        if code >> r & 1:
                            hit[r][c] += n * p[c]
            total = sum(weight)
            self.prior = [w / total for w in weight]
            # a rule may not become evidence against its own type
            for r, o in enumerate(own):
                rates = [min(0.99, max(0.001, hit[r][c] / weight[c])) for c in range(k)]
                top = rates[o]
                self.rate[r] = [x if c == o else min(x, top) for c, x in enumerate(rates)]

    def posterior(self, code: int) -> list[float]:
        logs = []
        for c in range(len(TYPES)):
            s = math.log(self.prior[c])
            for r in range(len(RULES)):
                q = self.rate[r][c]
                s += math.log(q if code >> r & 1 else 1 - q)
            logs.append(s)
        top = max(logs)
        e = [math.exp(x - top) for x in logs]
        return [x / sum(e) for x in e]


def text_types(statistics_table: DataFrame) -> DataFrame:
    """The table with ``type``, ``posterior`` and ``prose`` (the posterior of prose); null where there are no votes."""
    counts = statistics_table.filter("votes is not null").groupBy("votes").agg(F.count("*").alias("n")).collect()  # <= 2 ** rules
    model = VoteModel({r["votes"]: r["n"] for r in counts})
    rows = []
    for r in counts:
        p = model.posterior(r["votes"])
        best = max(range(len(TYPES)), key=lambda c: (p[c], -c))
        rows.append((r["votes"], TYPES[best], p[best], p[0]))
    found = statistics_table.sparkSession.createDataFrame(rows, "votes bigint, type string, posterior double, prose double")
    return statistics_table.join(F.broadcast(found), "votes", "left") if len(rows) < 100_000 else statistics_table.join(found, "votes", "left")


def typed_documents(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics and type of every document. The statistics are written once, to the shared folder."""
    return text_types(cut(with_statistics(documents, common_words, key, text)))


def not_prose(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of the documents, neither null nor blank, that are no natural prose."""
    return typed_documents(documents, common_words, key, text).filter("type is not null and type <> 'prose'").select(F.col(key).cast("bigint").alias(key)).distinct()
