"""Problem 5: noise in the text of scanned sheets, found line by line, and the text repaired into paragraphs.

Lines: running titles and page numbers come from ``sheets.kinds``; titles in wordings of their own from the lines that
recur at the edges of a file's sheets (``titles``). A line that ends in a letter and a breaking sign is broken if the
next line of the body goes on in lower case; titles between the halves do not matter. Whether the joined word keeps a
hyphen is decided by counts: it does if the word is written with one inside lines more often than without.

Misread characters: a sign or digit inside a word, or a letter of another script, shows itself. A letter misread as
another letter is found through the vocabulary: all words of the corpus are counted (added up in each task first), and
each has an anagram hash, the sum of the fifth powers of its code points. Two words that differ by one confusion a -> b
differ by b^5 - a^5 in it, whatever the place. So rare words are joined with frequent ones in SQL by an equi-join on
the hash less each confusion; the letters are compared after the join, and the correction of each word is the best
ranked by frequency. The confusions are a fixed list of well-known ones and those that the corpus itself shows: pairs
of letters by which enough rare words differ from far more frequent ones, inside the word, not in its ending.
Words that are neither frequent nor part of a correction can be told apart in the second pass by a set of frequent
words, which holds at most 1 / ``FREQUENT`` words whatever the corpus.
A word with one sign for a letter is joined in the same way, on the hash less (sign^5 - letter^5) for every letter of
its script; since the sign is no letter for certain, its correction need only be a word that is known.
Only words of Cyrillic or Latin letters are hashed; words of other scripts are left as they are.

Results at the edges: null and empty texts have no lines; texts are read whole; rows delivered twice count once; a
word broken over a line end belongs to the line in which its misread letter stands.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.sheets import kinds, page_number
from papyrine.llm.titles import with_titles
from papyrine.session import SHARED_ROWS, cut, once

# Letters and what they are misread as. (letter, misread as)
CONFUSIONS = [
    ("н", "п"), ("и", "п"), ("т", "г"), ("л", "д"), ("к", "н"), ("в", "б"), ("ы", "м"), ("ш", "т"), ("щ", "ш"), ("ц", "п"), ("і", "п"), ("п", "н"), ("г", "т"),
    ("t", "f"), ("e", "c"), ("c", "e"), ("n", "u"), ("u", "n"), ("h", "b"), ("l", "i"), ("i", "l"), ("o", "c"), ("f", "t"),
]
# Signs of another script or digits, and the letter they are misread for.
IN_CYRILLIC = {"a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "x": "х", "y": "у", "k": "к", "m": "м", "t": "т", "h": "н", "b": "в", "i": "і", "0": "о", "3": "з", "4": "ч", "6": "б", "1": "і"}
IN_LATIN = {"0": "o", "1": "l", "5": "s", "3": "e", "8": "b", "6": "b", "!": "i"}
# Signs that stand for any letter inside a word.
NOISE = "\\^#|%$!"
# Signs that break a word over a line end.
BREAKS = "-‐‑¬=\xad"

#: A word is frequent if it makes up this share of all words; so there are at most 100,000 frequent words.
FREQUENT = 1e-5
#: A pair of letters is a confusion if this many rare words show it inside the word.
SHOWN = 5
#: A word is a misreading if the word it stands for is this many times as frequent.
RATIO = 20

_FORMULA = re.compile(r"\[(?:формула|formula)[^\]]*\]", re.I)
_BREAK = re.compile(r"[^\W\d_][" + re.escape(BREAKS) + r"][ \t]*$")
_BREAK_SIGNS = frozenset(BREAKS)
_WORD = re.compile(r"[^\W\d_]+")
_WORD_END = re.compile(r"([^\W\d_]+)[" + re.escape(BREAKS) + r"][ \t]*$")
_WORD_START = re.compile(r"[^\W\d_]+")
_CYR, _LAT = "Ѐ-ӿ", "A-Za-zÀ-ÖØ-öø-ÿ"
_NOISE = re.escape(NOISE)
_ANY = r"[^\W\d_]"
# each begins with one set of rare characters, which the pattern engine looks for fast
_DIRECT = re.compile(
    rf"[{_LAT}0-9{_NOISE}](?:(?<=[{_LAT}])(?:(?<=[{_CYR}].)|(?=[{_CYR}]))|(?<=\d)(?:(?<={_ANY}.)|(?={_ANY}))"
    rf"|(?<=[{_NOISE}])(?:(?<={_ANY}.)(?={_ANY}|[{re.escape(BREAKS)}][ \t]*$)|(?<=^.)(?={_ANY})))",
    re.M,
)
# a word with one sign for a letter, in lower case
_SIGNED = re.compile(rf"{_ANY}+[{_NOISE}]{_ANY}+")
# letters that a sign may stand for, by script
_LETTERS_OF = {_CYR: "абвгдеёжзийклмнопрстуфхцчшщъыьэюяіѣѳѵ", _LAT: "abcdefghijklmnopqrstuvwxyzàâäæçèéêëîïôöœùûüß"}
_TOKEN = re.compile(rf"(?:[^\W_]|(?<=[^\W_])[{_NOISE}](?=[^\W_]))+")
_COMPOUND = re.compile(rf"-(?<={_ANY}.){_ANY}+")
_STRAY = re.compile(r"[aceopxyAEOPCTXKMHB](?<![^\W_'’-].)[aceopxyAEOPCTXKMHB]{0,2}(?![^\W_'’-])")
_ROMAN = re.compile(r"[IVXLCDM]+")
_MARK = re.compile(r"\[(?:[^\[\]]|\[[^\[\]]*\])*\]")
_LETTERS = re.compile(rf"[{_CYR}]")


def _clean(text: str) -> str:
    return _FORMULA.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text) if "[" in text else text


def joins(lines: list[str], kind: list[str], strict: bool = True) -> dict[int, int]:
    """For each line that ends in the first part of a broken word, the line with the second part. ``strict`` false: also
    lines after which the body goes on with something else, so that the second part is missing."""
    out = {}
    n = len(lines)
    for i in range(n - 1):
        line = lines[i]
        if kind[i] or not line or line.rstrip(" \t")[-1:] not in _BREAK_SIGNS or not _BREAK.search(line[-6:]):
            continue
        j = i + 1
        while j < n and (kind[j] in ("header", "page_number") or not lines[j].strip()):
            j += 1
        if j < n and (not strict or lines[j].lstrip()[:1].islower()):
            out[i] = j
    return out


def words_of(lines: list[str], kind: list[str], broken: dict[int, int], noisy: bool = True) -> list[tuple[int, int | None, int, str]]:
    """(line, second line of a broken word or None, letters in the first line, word in lower case) of all words that are
    letters of one script only; others show their misreading themselves. ``noisy``: whether the sheet may have any."""
    out = []
    second = set(broken.values())
    tails = {}
    for i, line in enumerate(lines):
        if kind[i] and i not in broken and i not in second:
            continue
        if not line:
            continue
        if noisy and _DIRECT.search(line):
            line = _TOKEN.sub(lambda m: m[0] if m[0].isalpha() and not _DIRECT.search(m[0]) else " " * len(m[0]), line)
        low = line.lower()
        found = _WORD.findall(low)
        if i in second and found and i in tails:
            a, head = tails.pop(i)
            if low.lstrip().startswith(found[0]):
                out.append((a, i, len(head), head + found[0]))
                found = found[1:]
        if i in broken and found and (end := _WORD_END.search(low)) and end[1] == found[-1]:
            tails[broken[i]] = (i, found.pop())
        out += [(i, None, 0, w) for w in found]
    return out


def body_words(lines: list[str], kind: list[str], broken: dict[int, int], noisy: bool = True, signed: list[str] | None = None) -> list[str]:
    """The words of ``words_of`` without their places, in order. ``signed`` takes the words with one sign for a letter."""
    parts = []
    second = set(broken.values())
    for i, line in enumerate(lines):
        if line and (not kind[i] or i in second):
            parts.append(line.rstrip(" \t")[:-1] if i in broken else line + "\n")
    body = "".join(x.lstrip() if k and not parts[k - 1].endswith("\n") else x for k, x in enumerate(parts))
    if noisy:

        def keep(m: re.Match) -> str:
            t = m[0]
            if t.isalpha():
                return t if not _DIRECT.search(t) else " "
            if signed is not None and _SIGNED.fullmatch(t):
                signed.append(t.lower())
            return " "

        # only the stretches between spaces in which something shows
        out, last = [], 0
        for m in _DIRECT.finditer(body):
            at = m.start()
            if at < last:
                continue
            start = max(body.rfind(" ", 0, at), body.rfind("\n", 0, at), last - 1) + 1
            ends = [k for k in (body.find(" ", at + 1), body.find("\n", at + 1)) if k >= 0]
            stop = min(ends) if ends else len(body)
            out += [body[last:start], _TOKEN.sub(keep, body[start:stop])]
            last = stop
        body = "".join([*out, body[last:]])
    return _WORD.findall(body.lower())


def direct_misreadings(lines: list[str], kind: list[str], noisy: bool = True, stray: bool = True) -> set[int]:
    """Lines with a word whose misread character shows itself. ``noisy`` and ``stray``: whether the sheet may have any."""
    out: set[int] = set()
    if not noisy and not stray:
        return out
    for i, line in enumerate(lines):
        if kind[i] or not line:
            continue
        if noisy and _DIRECT.search(line):
            for m in _TOKEN.finditer(line):
                t = m[0]
                if t.isalpha():
                    if _DIRECT.search(t):
                        out.add(i)
                elif not t.isdigit():
                    letters = sum(map(str.isalpha, t))
                    if letters >= 2 and (any(c in NOISE for c in t) or letters > sum(map(str.isdigit, t))):
                        out.add(i)
            if any(c in line for c in NOISE) and re.search(rf"[^\W\d_][{_NOISE}][{re.escape(BREAKS)}][ \t]*$|^[{_NOISE}][^\W\d_]", line):
                out.add(i)
        if stray and i not in out and _STRAY.search(line):
            plain = _MARK.sub(" ", line)
            found = [m[0] for m in _STRAY.finditer(plain) if not _ROMAN.fullmatch(m[0])]
            # a short word of look-alikes only, and no other Latin letter, among Cyrillic words
            if found and len(_LETTERS.findall(plain)) > 8 and len(re.findall(rf"[{_LAT}]", plain)) == sum(map(len, found)):
                out.add(i)
    return out


def _sheet(text: str, page: str | None, titles: list[str] | None = None):
    """(lines, their kinds, broken words), and whether the sheet may have misread characters that show themselves."""
    text = _clean(text)
    lines = text.split("\n")
    kind = kinds(lines, page_number(page), frozenset(titles or ()))
    return (lines, kind, joins(lines, kind)), _DIRECT.search(text) is not None, _STRAY.search(text) is not None and _LETTERS.search(text) is not None


def _halves(lines: list[str], broken: dict[int, int]) -> list[str]:
    """The broken words of a sheet in lower case, a not sign between their halves."""
    out = []
    for i, j in broken.items():
        head, tail = _WORD_END.search(lines[i].lower()), _WORD_START.match(lines[j].lower().lstrip())
        if head and tail:
            out.append(f"{head[1]}¬{tail[0]}")
    return out


def _compounds(text: str) -> list[str]:
    """Words of two parts with a hyphen between, in lower case."""
    out = []
    for m in _COMPOUND.finditer(text):
        k = m.start()
        while k and text[k - 1].isalpha():
            k -= 1
        out.append(text[k : m.end()].lower())
    return out


def _with_titles(readings: DataFrame, key: bool = False) -> DataFrame:
    """page, text and titles of the readings; ``key``: reading_id first, rows without one left out."""
    if key:
        readings = readings.filter("reading_id is not null").withColumn("reading_id", F.col("reading_id").cast("bigint"))
    return with_titles(readings, [*["reading_id"] * key, "page", "text"])


def word_counts(readings: DataFrame) -> DataFrame:
    """(word, n) over all sheets; among them words with one sign for a letter and words with a hyphen inside a line.
    Each task adds its words up before anything is shuffled."""
    return _counted(_with_titles(readings))


def _counted(titled: DataFrame) -> DataFrame:

    def count(batches):
        total: Counter[str] = Counter()
        for batch in batches:
            for page, text, titles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    (lines, kind, broken), noisy, _ = _sheet(text, page, titles)
                    signed: list[str] = []
                    total.update(body_words(lines, kind, broken, noisy, signed)[:-1])  # the last word may be cut
                    total.update(signed)
                    total.update(_compounds(text))
            if len(total) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["word", "n"])
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return titled.select("page", "text", "titles").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def anagram_hash(column: str) -> F.Column:
    """The sum of the fifth powers of a word's code points."""
    power = lambda c: F.ascii(c).cast("bigint") * F.ascii(c) * F.ascii(c) * F.ascii(c) * F.ascii(c)
    return F.aggregate(F.split(F.col(column), ""), F.lit(0).cast("bigint"), lambda a, c: a + F.when(c == "", F.lit(0).cast("bigint")).otherwise(power(c)))


def corrections(counts: DataFrame) -> DataFrame:
    """(wrong, right, at): each misread word with the best ranked word it stands for, and the place of the first difference.

    One confusion at a time, in one or two places of the word; or one sign for any letter.
    """
    letters_only = "^[A-Za-z\u00c0-\u052f]+$"  # so far fifth powers are far from overflowing
    hashed = counts.filter((F.length("word") >= 3) & F.col("word").rlike(letters_only)).withColumn("hash", anagram_hash("word"))
    is_signed = F.col("word").rlike(f"^(?:[{_CYR}]+[{_NOISE}][{_CYR}]+|[{_LAT}]+[{_NOISE}][{_LAT}]+)$")
    shown = shown_confusions(hashed)
    # only confusions far less usual than the average one count for less
    usual = sum(shown.values()) / len(shown) if shown else 1.0
    pairs = dict.fromkeys(CONFUSIONS, 1.0) | {k: min(1.0, 4 * v / usual) for k, v in shown.items()}
    letters = _letter_corrections(hashed, pairs)
    # what is itself misread mends nothing
    sound = hashed.join(letters.select(F.col("wrong").alias("word")), "word", "left_anti")
    return letters.unionByName(_sign_corrections(sound, counts.filter(is_signed)))


def shown_confusions(known: DataFrame) -> dict[tuple[str, str], float]:
    """(letter, misread as) and how usual that is, as a part of the letter's places in frequent words: pairs of letters by which at least ``SHOWN`` rare words differ from a far more frequent word
    in one place, neither of the last two. At most the square of the letters of the two scripts."""
    inner = F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.struct(F.concat(F.substr("word", F.lit(1), i - 1), F.lit("*"), F.substr("word", i + 1)).alias("rest"), F.substr("word", i, F.lit(1)).alias("letter")))
    places = known.filter("length(word) >= 4").select("word", "n", F.explode(inner).alias("x")).select("word", "n", "x.*")
    right = places.filter(f"n >= {RATIO}").select("rest", F.col("n").alias("n_right"), F.col("letter").alias("right_letter"))
    # of the words that share all but one letter only the most frequent can be what the others stand for
    right = right.groupBy("rest").agg(F.max(F.struct("n_right", "right_letter")).alias("r")).select("rest", "r.*")
    pairs = places.join(right, "rest").filter(f"letter <> right_letter and n_right >= {RATIO} * n")
    shown = pairs.groupBy("right_letter", "letter").agg(F.countDistinct("word").alias("shown")).filter(f"shown >= {SHOWN}")
    letters = right.groupBy("right_letter").agg(F.count("*").alias("places"))
    return {(r[0], r[1]): r[2] for r in shown.join(letters, "right_letter").select("right_letter", "letter", F.col("shown") / F.col("places")).sort("right_letter", "letter").collect()}


def kept_hyphens(counts: DataFrame) -> DataFrame:
    """(wrong, right) of words that are written with a hyphen inside lines more often than without (words broken over a
    line end count among the latter): the halves with a not sign between, and with the hyphen."""
    with_hyphen = counts.filter(F.contains("word", F.lit("-"))).select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    whole = counts.select(F.col("word").alias("whole"), F.col("n").alias("n_whole"))
    named = with_hyphen.withColumns({"wrong": F.replace("right", F.lit("-"), F.lit("¬")), "whole": F.replace("right", F.lit("-"), F.lit(""))})
    return named.join(whole, "whole", "left").filter("n_right > coalesce(n_whole, 0)").select("wrong", "right")


def _sign_corrections(known: DataFrame, signed: DataFrame) -> DataFrame:
    """(wrong, right, at) of words with one sign for a letter: the most frequent word that has a letter in its place, but
    the letter that the sign looks like first."""
    power = lambda c: F.lit(ord(c) ** 5)
    signs = F.create_map(*(F.lit(x) if isinstance(x, str) else x for c in NOISE for x in (c, power(c))))
    listed = {k: F.array(*(F.struct(F.lit(c).alias("letter"), power(c).alias("power")) for c in v)) for k, v in _LETTERS_OF.items()}
    like = F.create_map(*(F.lit(x) for c in NOISE if c in IN_LATIN for x in (c, IN_LATIN[c])))
    wrong = signed.select(F.col("word").alias("wrong"), F.regexp_extract("word", f"[{_NOISE}]", 0).alias("sign"), (anagram_hash("word")).alias("wrong_hash"))
    wrong = wrong.select("*", F.explode(F.when(F.col("wrong").rlike(f"[{_CYR}]"), listed[_CYR]).otherwise(listed[_LAT])).alias("c"))
    wrong = wrong.select("wrong", "sign", "c.letter", F.replace("wrong", "sign", "letter").alias("meant"), (F.col("wrong_hash") - signs[F.col("sign")] + F.col("c.power")).alias("hash"))
    right = known.select(F.col("word").alias("right"), F.col("n").alias("n_right"), "hash")
    found = wrong.join(right, "hash").filter("right = meant").withColumn("at", F.instr("wrong", F.col("sign")))
    looks = ~F.col("wrong").rlike(f"[{_CYR}]") & F.coalesce(like[F.col("sign")] == F.col("letter"), F.lit(False))
    best = Window.partitionBy("wrong").orderBy(looks.desc(), F.desc("n_right"), "right")
    return found.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("wrong", "right", F.col("at").cast("int").alias("at"))


def _letter_corrections(known: DataFrame, pairs: dict[tuple[str, str], float]) -> DataFrame:
    """Corrections by the confusions of ``pairs``, ranked by how frequent the word and how usual the confusion is."""
    # each word takes the confusions whose letter it has
    rows = [(a, b, k * (ord(b) ** 5 - ord(a) ** 5), k, usual) for (a, b), usual in pairs.items() for k in (1, 2)]
    names = ("right_letter", "wrong_letter", "difference", "places", "usual")
    listed = F.array(*(F.struct(*(F.lit(v).cast(("string", "string", "bigint", "int", "double")[i]).alias(n) for i, (n, v) in enumerate(zip(names, r, strict=True)))) for r in rows))
    has = lambda x: F.length("wrong") - F.length(F.replace("wrong", x["wrong_letter"], F.lit(""))) >= x["places"]
    wrong = known.select(F.col("word").alias("wrong"), F.col("n").alias("n_wrong"), F.col("hash").alias("wrong_hash"))
    wrong = wrong.select("*", F.explode(F.filter(listed, has)).alias("c")).select("wrong", "n_wrong", "wrong_hash", "c.*")
    right = known.filter(f"n >= {RATIO}").select(F.col("word").alias("right"), F.col("n").alias("n_right"), "hash")
    differs = F.zip_with(F.split("wrong", ""), F.split("right", ""), lambda x, y: F.when(x != y, F.concat(y, x)))
    found = (
        wrong.withColumn("hash", F.col("wrong_hash") - F.col("difference"))
        .join(right, "hash")
        .filter((F.length("wrong") == F.length("right")) & (F.col("n_right") >= RATIO * F.col("n_wrong")))
        .withColumn("differs", differs)
        .filter(F.size(F.filter("differs", lambda x: x.isNotNull())) == F.col("places"))
        .filter(F.forall("differs", lambda x: x.isNull() | (x == F.concat(F.col("right_letter"), F.col("wrong_letter")))))
        .withColumn("at", F.array_position(F.transform("differs", lambda x: x.isNotNull()), F.lit(True)))
    )
    best = Window.partitionBy("wrong").orderBy((F.col("n_right") * F.col("usual")).desc(), "places", "right")
    return found.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("wrong", "right", F.col("at").cast("int").alias("at"))


def _scan(titled: DataFrame, frequent: frozenset[str], halves: bool = False) -> DataFrame:
    """Rows of two sorts: (reading_id, line_no, kind) of noise that shows itself, and words to be looked up; those with a
    sign for a letter have no line_no, for their lines are among the first. ``halves``: broken words are looked up too."""
    shared = titled.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches):
        known = shared.value
        for batch in batches:
            out: list[tuple] = []
            for rid, page, text, titles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text:
                    continue
                (lines, kind, broken), noisy, stray = _sheet(text, page, titles)
                for i, k in enumerate(kind):
                    if k in ("header", "page_number"):
                        out.append((rid, i + 1, k, None, None, None))
                out += [(rid, i + 1, "hyphen", None, None, None) for i in joins(lines, kind, strict=False)]
                direct = direct_misreadings(lines, kind, noisy, stray)
                out += [(rid, i + 1, "misread", None, None, None) for i in direct]
                signed: list[str] = []
                words = set(body_words(lines, kind, broken, noisy, signed))
                out += [(rid, None, None, w, None, None) for w in {*signed, *(_halves(lines, broken) if halves else ())}]
                if not any(len(w) > 2 for w in words.difference(known)):
                    continue
                for a, b, head, w in words_of(lines, kind, broken, noisy):
                    if w not in known and len(w) > 2:
                        out.append((rid, a + 1, None, w, None if b is None else b + 1, head))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["reading_id", "line_no", "kind", "word", "next_line", "head"])

    return titled.mapInArrow(scan, "reading_id bigint, line_no bigint, kind string, word string, next_line bigint, head int")


def _corrected(titled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, corrections), both written to the shared folder."""
    counts = cut(_counted(titled))
    return counts, cut(corrections(counts))


def _frequent(counts: DataFrame, fixes: DataFrame) -> frozenset[str]:
    total = counts.filter("not contains(word, '-')").agg(F.sum("n")).first()[0] or 0
    common = counts.filter(F.col("n") >= max(1, FREQUENT * total)).join(fixes.select(F.col("wrong").alias("word")), "word", "left_anti")
    return frozenset(r[0] for r in common.select("word").collect())  # at most 1 / FREQUENT words of each sort


def noisy_lines(readings: DataFrame) -> DataFrame:
    """(reading_id, line_no, kind) of every noisy line, distinct."""
    titled = _with_titles(readings, key=True)
    counts, fixes = _corrected(titled)
    scanned = cut(_scan(titled, _frequent(counts, fixes)))
    shown = scanned.filter("kind is not null").select("reading_id", "line_no", "kind")
    line = F.when(F.col("next_line").isNotNull() & (F.col("at") > F.col("head")), F.col("next_line")).otherwise(F.col("line_no"))
    looked_up = scanned.filter("word is not null and line_no is not null").join(fixes, F.col("word") == F.col("wrong")).select("reading_id", line.alias("line_no"), F.lit("misread").alias("kind"))
    return shown.unionByName(looked_up).distinct()


def repair_word(word: str, fixes: dict[str, str]) -> str:
    """A word with its misread characters mended, its case kept: by the corrections, else by the fixed look-alikes."""
    if word.isdigit():
        return word
    low = word.lower()
    if (right := fixes.get(low)) is None:
        cyrillic = len(_LETTERS.findall(low)) * 2 >= sum(map(str.isalpha, low))
        table = IN_CYRILLIC if cyrillic else IN_LATIN
        right = "".join(table.get(c, c) if not (cyrillic and _LETTERS.match(c)) else c for c in low) if cyrillic or any(not c.isalpha() for c in low) else low
    if right == low or len(right) != len(word):
        return word
    if word.isupper() and len(word) > 1:
        return right.upper()
    return "".join(b if a == c else (b.upper() if a.isupper() else b) for a, b, c in zip(word, right, low, strict=True))


def _mend_stray(line: str) -> str:
    """A short word of Latin look-alikes among Cyrillic words, made Cyrillic, as ``direct_misreadings`` finds it."""
    plain = _MARK.sub(" ", line)
    found = [m[0] for m in _STRAY.finditer(plain) if not _ROMAN.fullmatch(m[0])]
    if not found or len(_LETTERS.findall(plain)) <= 8 or len(re.findall(rf"[{_LAT}]", plain)) != sum(map(len, found)):
        return line
    like = lambda c: IN_CYRILLIC[c] if c in IN_CYRILLIC else IN_CYRILLIC[c.lower()].upper()
    return _STRAY.sub(lambda m: m[0] if _ROMAN.fullmatch(m[0]) else "".join(map(like, m[0])), line)


def repair(text: str | None, page: str | None, fixes: dict[str, str] | None, titles: list[str] | None = None) -> str | None:
    """Continuous paragraphs: no running titles and page numbers, broken words joined, misread words mended.

    A blank line, a mark, a table row, a heading or a line that ends a sentence well before the usual width ends a paragraph.
    """
    if text is None:
        return None
    fixes = fixes if fixes is not None else {}
    lines = text.split("\n")
    kind = kinds(lines, page_number(page), frozenset(titles or ()))
    broken = joins(lines, kind)
    kept = [i for i in range(len(lines)) if kind[i] not in ("header", "page_number")]
    width = sorted(len(lines[i]) for i in kept if lines[i].strip())
    usual = width[len(width) * 3 // 4] if width else 0
    stray = _STRAY.search(text) is not None and _LETTERS.search(text) is not None
    paragraphs, current = [], ""
    for i in kept:
        line = lines[i].strip()
        if stray and _STRAY.search(line):
            line = _mend_stray(line)
        if not line or line[0] == "|" or kind[i] == "sum":
            paragraphs += [x for x in (current, line) if x]
            current = ""
            continue
        if i in broken:
            halves = _halves(lines, {i: broken[i]})
            current += line.rstrip(BREAKS + " ") + "-" * (bool(halves) and halves[0] in fixes)
            continue
        current += line
        if line[-1] in ".!?…»" and len(line) < 0.75 * usual:
            paragraphs.append(current)
            current = ""
        else:
            current += " "
    if current.strip():
        paragraphs.append(current)
    joined = "\n".join(p.strip() for p in paragraphs)
    if not fixes and not _DIRECT.search(joined):
        return joined

    def mend(m: re.Match) -> str:
        word = m[0]
        if word.isalpha():
            return repair_word(word, fixes) if word.lower() in fixes or _DIRECT.search(word) else word
        return word if word.isdigit() else repair_word(word, fixes)

    return _TOKEN.sub(mend, joined)


def repaired(readings: DataFrame, shared: int = SHARED_ROWS) -> DataFrame:
    """(reading_id, repaired): every distinct reading's text as readable paragraphs; null stays null.

    Up to ``shared`` corrections go to all tasks, and each text is mended where it is read. Beyond that, the words of
    each reading are looked up by a join, and its corrections are joined to its text.
    """
    titled = _with_titles(readings, key=True)
    counts, found = _corrected(titled)
    fixes = cut(found.select("wrong", "right").unionByName(kept_hyphens(counts)))
    texts = once(titled, "reading_id")
    schema = "reading_id bigint, repaired string"
    if fixes.limit(shared + 1).count() <= shared:
        known = readings.sparkSession.sparkContext.broadcast({r["wrong"]: r["right"] for r in fixes.collect()})

        def mend(batches):
            for batch in batches:
                rows = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([repair(text, page, known.value, titles) for page, text, titles in rows], pa.string())], ["reading_id", "repaired"])

        return texts.mapInArrow(mend, schema)
    scanned = cut(_scan(titled, _frequent(counts, found), halves=True))
    mine = scanned.filter("word is not null").join(fixes, F.col("word") == F.col("wrong")).groupBy("reading_id").agg(F.collect_set(F.struct("wrong", "right")).alias("fixes"))

    def mend_joined(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            out = [repair(text, page, {x["wrong"]: x["right"] for x in fix or []}, titles) for page, text, titles, fix in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["reading_id", "repaired"])

    return texts.join(mine, "reading_id", "left").select("reading_id", "page", "text", "titles", "fixes").mapInArrow(mend_joined, schema)
