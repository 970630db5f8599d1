import base64
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.llm import tokenizer

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ours():
    return tokenizer.load(Path(tokenizer.default_path()).read_bytes())


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer.default_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "  a", "it's we'll 'tis ''s", "a\n\n b\t\tc  ", "don't  stop", "　\xa0 x", "привѣтъ, міръ 1905 г.", "<|endoftext|>", "a\x00b", "é😀", "'", "x'", " 's", "12 345½", "'re'llve"]


def test_against_the_public_library(ours, theirs):
    ids, offsets = ours.encode(TEXTS)
    for i, text in enumerate(TEXTS):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == theirs.encode_ordinary(text), text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="abst'relvmd  \n\t1½éЖ!?​\xa0.😀", max_size=40), max_size=4))
def test_random_texts(ours, theirs, texts):
    ids, offsets = ours.encode(texts)
    for i, text in enumerate(texts):
        own = ids[offsets[i] : offsets[i + 1]].tolist()
        assert own == theirs.encode_ordinary(text) and ours.decode(own) == text
    assert ours.counts(texts).tolist() == [len(theirs.encode_ordinary(t)) for t in texts]


def test_long_text_and_spans(ours, theirs):
    text = "жж" * 30_000 + " конец"
    ids, _ = ours.encode([text])
    assert ids.tolist() == theirs.encode_ordinary(text)
    spans = ours.spans("Ёлка 12")
    assert spans[0][0] == 0 and spans[-1][1] == len("Ёлка 12".encode()) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_frame(spark, theirs):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "а б", None), (3, "а б", None)], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in tokenizer.with_ids(df).orderBy("doc_id").collect()]
    assert got == [(1, []), (2, []), (3, theirs.encode_ordinary("а б")), (3, theirs.encode_ordinary("а б"))]
    assert tokenizer.with_ids(df.limit(0)).count() == 0
    assert {(r.tokens, r.documents) for r in tokenizer.token_statistics(df).collect()} == {(0, 2), (len(got[2][1]), 2)}
