"""What the lines of a transcribed sheet are: running titles, page numbers, sums, table rows, marks, body.

Shared by the operators on sheets. Everything here looks at one text; what has to be known about the other sheets of
a file (which titles run through it) is worked out by the operators and passed in.
"""

from __future__ import annotations

import re

# Latin letters and digits that are misread for a Cyrillic letter in a title.
TITLE_LOOKALIKES = str.maketrans("oOeEaAcCpPxXyYkKMTHB", "оОеЕаАсСрРхХуУкКМТНВ")
_DIGIT_IN_WORD = re.compile(r"[03](?=[^\W\d_])|(?<=[^\W\d_])[03]")

_NUMBER = r"\d{1,7}"
#: Nothing but a page number, in the notations of the archive.
PAGE = re.compile(
    rf"(?:[-–—]\s*{_NUMBER}\s*[-–—]|\[{_NUMBER}\]|\({_NUMBER}\)|(?:л|стр|с|лист|page|p|S)\.?\s*{_NUMBER}(?:\s*об\.?)?|{_NUMBER}\s*об\.?|{_NUMBER}\.?)", re.I
)
BARE = re.compile(r"\d+(?:[.,]\d+)?")
#: A line of editorial marks only.
MARK = re.compile(r"(?:\s*(?:\[(?:[^\[\]]|\[[^\[\]]*\])*\]|~~))+\s*")
TOTAL = re.compile(r"(?:Итого|Всего|Total|Summe|Somme)\b.*", re.I)
_SIDE = re.compile(rf"^\W*{_NUMBER}\s{{2,}}|\s{{2,}}{_NUMBER}\W*$")
#: A running title whose wording gives it away.
TITLE = re.compile(
    r"\W*(?:фонд\s+\d+\W+опись\s+\S+\W+дело\s+\S+|записки\s+\S+\s+«[^»]*»,?\s*вып\.?\s*\S+|[^.!?]{3,60}\.\s*часть\s+[ivx]+)\W*", re.I
)
_SPACED = re.compile(r"\W*(?:[^\W\d_] +){4,}[^\W\d_]\b.*")
#: Cheap signs that a line may be such a title.
_HINT = re.compile(r"[дДD][eеЕE][лЛ][oо0ОO]\s|вып\.|ВЫП\.|[чЧ][aаАA][сcСC][тТT][ьЬ]\s")


def title_core(line: str) -> str:
    """A line without a page number beside it and without ornaments, look-alike signs in words made Cyrillic."""
    text = _SIDE.sub("", line.strip()).strip(" \t*·•—–-")
    return _DIGIT_IN_WORD.sub(lambda m: "О" if m[0] == "0" else "З", text).translate(TITLE_LOOKALIKES)


def skeleton(line: str) -> str:
    """What copies of a running title have in common: its letters, without case, spacing, numbers and ornaments."""
    return "".join(c for c in title_core(line).casefold() if c.isalpha())


def is_capitals(text: str) -> bool:
    """A short line in capitals without the end of a sentence."""
    letters = [c for c in text if c.isalpha()]
    return len(letters) >= 4 and len(text) <= 60 and all(c.isupper() for c in letters) and text[-1] not in ".!?…,;:-‐‑¬=\xad"


def is_title(lines: list[str], i: int, running: frozenset[str] = frozenset(), hinted: bool = True) -> bool:
    """Whether line i is a running title: by its wording, as one of the file's ``running`` skeletons, or set in
    capitals on its own (a line of capitals beside another one is part of a longer text)."""
    line = lines[i]
    if len(line) > 100 or not line:
        return False
    if running and skeleton(line) in running:
        return True
    spaced = line.count(" ") * 2 + 3 >= len(line) > 8 and _SPACED.fullmatch(line)
    if not spaced and not line.isupper() and not (hinted and _HINT.search(line)):
        return False
    if spaced:
        return True
    core = title_core(line)
    if not core:
        return False
    if TITLE.fullmatch(core):
        return True
    if is_capitals(core) and "[" not in line and "|" not in line:
        beside = [lines[j].strip() for j in (i - 1, i + 1) if 0 <= j < len(lines)]
        return not any(len(b) > 8 and is_capitals(b.rstrip(".!?…,;:-‐‑¬=\xad ") or "x") for b in beside)
    return False


def kinds(lines: list[str], page: int | None = None, running: frozenset[str] = frozenset()) -> list[str]:
    """For each line: '' (body or blank), 'header', 'page_number' or 'sum' (a figure of a sum, or its total).

    A page number stands alone at the top or the bottom of the sheet, next to titles at most; bare figures that stand
    together are a sum worked out on the sheet. ``page``, the sheet's number in its file, tells a bare page number
    from a figure: pages are counted from the first sheet or its cover on.
    """
    n = len(lines)
    out = [""] * n
    full = [i for i in range(n) if lines[i].strip()]
    hinted = _HINT.search("\n".join(lines)) is not None
    for i in full:
        line = lines[i]
        # most lines are neither short capitals nor letter-spaced, and need no closer look
        if (hinted or running or line.isupper() or line.count(" ") * 2 + 3 >= len(line)) and is_title(lines, i, running, hinted):
            out[i] = "header"
    for i in full:
        if lines[i].lstrip()[:1] in "ИВTSивt" and TOTAL.fullmatch(lines[i].strip()):
            out[i] = "sum"
            j = i - 1
            while j >= 0 and (out[j] == "header" or not (text := lines[j].strip()) or BARE.fullmatch(text) or MARK.fullmatch(text)):
                if out[j] == "" and BARE.fullmatch(lines[j].strip()):
                    out[j] = "sum"
                j -= 1
    # from the top and from the bottom: titles, then at most one page number
    for order in (full, full[::-1]):
        for i in order[:3]:
            if out[i] == "header":
                continue
            text = lines[i].strip()
            if out[i] == "" and len(text) <= 18 and PAGE.fullmatch(text) and not (page is not None and text.isdigit() and abs(int(text) - page) > 4):
                out[i] = "page_number"
                continue
            break
    return out


def page_number(page: str | None) -> int | None:
    """The number of a sheet in its file, from the ``page`` column."""
    digits = re.match(r"\d+", page or "")
    return int(digits[0]) if digits else None
