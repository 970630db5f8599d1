import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.llm import charform

SCHEMA = "portal_id int, opis_code string, delo string, form_delo string"


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_canonical_is_stable(text):
    once = charform.canonical(text)
    assert charform.canonical(once) == once == unicodedata.normalize("NFKC", once)


def test_look_alikes_meet_and_letters_stay_apart():
    form = charform.address_form
    assert {form(v) for v in ("0029", "о029", "O029", "00２9", " 0​029﻿", "0\xad029".replace("0\xad0", "00"), "ο029", "𝟎𝟎𝟐𝟗")} == {"0029"}
    assert form("00б2") == "0062" and form("01l2") == form("0І12") == "0112" and form("З") == "3" and form("Ʒ001") == "3001"
    assert form("0130й") == form("0130й") == "0130й" != form("0130и") and form("6ё") != form("6е")
    assert form("0039e") == "0039е" and form("1ɑ") == form("１А") == "1а" and form("9Б") == "9б"
    assert form(None) is None and form("") == form("  ") == ""


def test_pairs_against_brute_force(spark, rows):
    data = [(1, "1", "0029", "x"), (2, "1", "о029", "x"), (2, "1", "о029", "x"), (3, "1", "0029", None), (4, "２", "0029", None), (5, "2", "0029", "y"), (6, None, "0029", None), (None, "1", "0029", None), (7, "1", "", "z"), (8, "1", " ", "z")]
    df = spark.createDataFrame(data, SCHEMA)
    form = charform.address_form
    kept = {r[:3] for r in data if None not in r[:3]}
    want = sorted({(a[0], b[0]) for a in kept for b in kept if a[0] < b[0] and a[1:] != b[1:] and list(map(form, a[1:])) == list(map(form, b[1:]))})
    assert rows(charform.same_address_pairs(df)) == want == [(1, 2), (2, 3), (4, 5), (7, 8)]
    assert charform.same_address_pairs(df.limit(0)).count() == 0 and charform.with_forms(df).count() == len(data)
    assert {(r.portal_id, r.cards, r.forms) for r in charform.addresses(df).collect()} >= {(1, 3, 2), (2, 3, 2), (3, 3, 2)}
