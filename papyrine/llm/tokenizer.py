"""Problem 6: every text as the ids of a public byte-level tokenizer, without regular expressions.

All texts of an Arrow batch become one array of code points. A table gives each code point a class; classes and a
look at the next characters give each position a symbol of a small automaton that places the pre-token boundaries.
The automaton's transition functions form a finite monoid under composition, which is associative, so the state at
every position comes from a blocked scan over monoid elements: one vectorised table look-up for each column of a
block, the same again over the blocks' totals. Slices between boundaries feed pair merging, whose results are cached
by slice for the life of a worker; offsets of ids and of slices are kept, so that ``decode`` and ``spans`` need no
second pass.

Results at the edges: a null or empty text has an empty list; no text is trimmed or normalised; special tokens of the
vocabulary are ordinary text. A row gives a row, repeated ones too; other columns of the input do not matter.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cached slices of one worker; the cache is emptied when it is full, so its memory is bounded.
CACHE_ENTRIES = 400_000
#: Slices longer than this are merged but not kept.
CACHE_LENGTH = 64
#: Width of a block of the scan.
BLOCK = 64

# --- pre-tokenisation -------------------------------------------------------------------------------------------

# Character classes.
OTHER, LETTER, NUMBER, BLANK, SPACE = 0, 1, 2, 3, 4  # BLANK: white space other than U+0020
# White space in the sense of the tokenizer's pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe to form a pre-token of its own.
SHORT = ["s", "t", "m", "d"]
LONG = ["re", "ve", "ll"]

# Symbols: what a position is for the automaton.
S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_LAST_SPACE, S_LAST_BLANK, S_SHORT, S_LONG, S_END = range(9)
# States: the kind of the open pre-token.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, HELD_SPACE, ONE_LEFT, TWO_LEFT = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token begins at this position."""
    if symbol == S_END:
        return FRESH, True
    if symbol == S_LAST_SPACE:  # the last U+0020 before a character that is not white space goes with that
        return HELD_SPACE, True
    if symbol == S_LAST_BLANK:
        return FRESH, True
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    if symbol == S_LETTER:
        if state in (TWO_LEFT, ONE_LEFT):
            return (ONE_LEFT if state == TWO_LEFT else FRESH), False
        return IN_LETTERS, state not in (IN_LETTERS, HELD_SPACE)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, HELD_SPACE)
    if symbol in (S_SHORT, S_LONG) and state not in (IN_OTHER, HELD_SPACE):
        return (ONE_LEFT if symbol == S_SHORT else TWO_LEFT), True
    return IN_OTHER, state not in (IN_OTHER, HELD_SPACE)


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(monoid element of each symbol, composition table, state after each element from FRESH, boundary of state and symbol)."""
    generators = [tuple(_step(s, y)[0] for s in range(8)) for y in range(9)]
    identity = tuple(range(8))
    elements, index, queue = [identity], {identity: 0}, [identity]
    while queue:
        f = queue.pop()
        for g in generators:
            h = tuple(g[f[s]] for s in range(8))
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
                queue.append(h)
    compose = np.array([[index[tuple(g[f[s]] for s in range(8))] for g in elements] for f in elements], np.uint8)
    begins = np.array([[_step(s, y)[1] for y in range(9)] for s in range(8)], bool)
    return np.array([index[g] for g in generators], np.uint8), compose, np.array([f[FRESH] for f in elements], np.uint8), begins


def _scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive scan of monoid elements under composition."""
    n = len(functions)
    rows = -(-n // BLOCK)
    grid = np.zeros((BLOCK, rows), np.uint8)  # a column of the text is a row here, contiguous
    padded = np.zeros(rows * BLOCK, np.uint8)
    padded[:n] = functions
    grid[:] = padded.reshape(rows, BLOCK).T
    flat, width = compose.ravel(), compose.shape[0]
    for j in range(1, BLOCK):
        np.take(flat, grid[j - 1].astype(np.intp) * width + grid[j], out=grid[j])
    if rows > 1:
        before = _scan(grid[-1, :-1], compose) if rows > 2 else grid[-1, :-1]
        carried = before.astype(np.intp) * width
        for j in range(BLOCK):
            grid[j, 1:] = flat[carried + grid[j, 1:]]
    return grid.T.ravel()[:n]


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE] = BLANK
    table[0x20] = SPACE
    return table


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens begin. ``ends``: positions of the separators after each text."""
    functions, compose, from_fresh, begins = _automaton()
    kinds = _classes()[points]
    kinds[ends] = 255
    following = np.empty_like(kinds)
    following[:-1], following[-1] = kinds[1:], 255
    symbol = np.where(kinds == LETTER, S_LETTER, np.where(kinds == NUMBER, S_NUMBER, S_OTHER)).astype(np.uint8)
    white = (kinds == BLANK) | (kinds == SPACE)
    last = white & (following <= NUMBER)
    symbol[white] = S_WHITE
    symbol[last & (kinds == SPACE)] = S_LAST_SPACE
    symbol[last & (kinds == BLANK)] = S_LAST_BLANK
    quotes = np.flatnonzero(points[:-2] == 0x27) if len(points) > 2 else np.empty(0, np.intp)
    if len(quotes):
        one, two = points[quotes + 1], points[quotes + 2]
        inside = kinds[quotes] != 255
        symbol[quotes[inside & np.isin(one, [ord(c) for c in SHORT])]] = S_SHORT
        pairs = np.zeros(len(quotes), bool)
        for a, b in LONG:
            pairs |= (one == ord(a)) & (two == ord(b))
        symbol[quotes[inside & pairs]] = S_LONG
    if len(points) > 1 and points[-2] == 0x27:  # an apostrophe right before the last separator has nothing after it
        symbol[-2] = S_OTHER
    symbol[ends] = S_END
    after = from_fresh[_scan(functions[symbol], compose)]
    before = np.empty_like(after)
    before[0], before[1:] = FRESH, after[:-1]
    return np.flatnonzero(begins[before, symbol])


def pretokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of all texts in order, and the number of the first one of each text, with the total at the end."""
    joined = "\x00".join(texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    starts = boundaries(points, ends)
    last = np.searchsorted(starts, ends)  # a separator is always a slice of its own, and not a pre-token
    begin, end = np.delete(starts, last), np.delete(np.append(starts[1:], len(points)), last)
    tokens = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    return tokens, np.concatenate([[0], last - np.arange(len(texts))])


# --- pair merging -----------------------------------------------------------------------------------------------


class Vocabulary:
    """Ranks of a byte-level vocabulary, and the cache of merged slices."""

    def __init__(self, content: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.bytes = {n: b for b, n in self.ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: the neighbouring pair of lowest rank is joined, the leftmost first, until none is known."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, piece[i : i + 2]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or parts[i] + parts[j] != pair:
                continue
            parts[i], alive[j], right[i] = pair, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for a in (left[i], i):
                b = right[a] if a >= 0 else n
                if b < n and (r := ranks.get(both := parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, both))
        return tuple(ranks[p] for p, k in zip(parts, alive) if k)

    def encode_slices(self, tokens: list[str]) -> list[tuple[int, ...]]:
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        new = {t: self.merge(t.encode("utf-8", "surrogatepass")) for t in set(tokens).difference(cache)}
        if not new:
            return list(map(cache.__getitem__, tokens))
        cache.update((t, ids) for t, ids in new.items() if len(t) <= CACHE_LENGTH)
        return [ids if (ids := new.get(t)) is not None else cache[t] for t in tokens]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        tokens, firsts = pretokens(texts)
        slices = self.encode_slices(tokens)
        lengths = np.fromiter(map(len, slices), np.int64, len(slices))
        ids = np.fromiter(chain.from_iterable(slices), np.int32, int(lengths.sum()))
        return ids, np.concatenate([[0], np.cumsum(lengths)])[firsts]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        tokens, firsts = pretokens(texts)
        lengths = np.fromiter(map(len, self.encode_slices(tokens)), np.int64, len(tokens))
        return np.diff(np.concatenate([[0], np.cumsum(lengths)])[firsts])

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Byte offsets (from, to) of each id in the text's UTF-8 form."""
        ids, _ = self.encode([text])
        ends = np.cumsum([len(self.bytes[i]) for i in ids.tolist()])
        return list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if len(ids) else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


@lru_cache(4)
def load(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def default_path() -> str:
    """The file of byte_bpe_50k among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Texts of a batch go through the scan in portions of about this many characters.
PORTION = 400_000


def portions(texts: list[str | None]):
    """(first, last) of consecutive portions of a batch; a text longer than ``PORTION`` is one of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > PORTION:
            yield first, i
            first = size = 0
            first = i
        size += n
    if first < len(texts):
        yield first, len(texts)


def with_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the text of each row as a list of ids. The vocabulary (under 1 MB, of fixed size) is broadcast."""
    spark = df.sparkSession
    content = spark.sparkContext.broadcast(Path(path or default_path()).read_bytes())

    def encode(batches):
        vocabulary = load(content.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts):
                ids, offsets = vocabulary.encode([t or "" for t in texts[a:b]])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [key, "ids"])

    return df.select(key, text).mapInArrow(encode, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def with_token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, tokens): the number of ids of each row's text, 0 for a null one."""
    spark = df.sparkSession
    content = spark.sparkContext.broadcast(Path(path or default_path()).read_bytes())

    def count(batches):
        vocabulary = load(content.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts):
                counts = vocabulary.counts([t or "" for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64())], [key, "tokens"])

    return df.select(key, text).mapInArrow(count, f"`{key}` {df.schema[key].dataType.simpleString()}, tokens bigint")


def token_statistics(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(tokens, documents): how many documents have each number of ids."""
    return with_token_counts(df, key, text, path).groupBy("tokens").agg(F.count("*").alias("documents"))
