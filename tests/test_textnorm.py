"""Orthography, tokens, case and offsets (OP-20 to OP-34)."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verba.functions.textnorm import MODERN, PREREFORM, case_of, normalize_word, orthography, reform_variants, split_hyphen, token_columns, tokenize, utf16_offsets

PRE = [("Ивановъ", "ивановъ"), ("Покровскій", "покровский"), ("Ѳеодоръ", "феодоръ"), ("Iоаннъ", "иоаннъ"), ("Бѣлёвъ", "белевъ"), ("Бг҃ъ", "бгъ"), ("Андрей", "андрей"), ("Кузнецо́в", "кузнецов"),
       ("Ѡ ѯ ѱ ꙋ ѧ ѵ", "о кс пс у я и"), ("кр‐нин", "кр-нин"), ("Mississippi", "mississippi"), ("Kот", "кот"), ("Kотw", "kотw"), ("Пет­ров", "петров"), ("Андрей", "андрей")]
MOD = [("Ивановъ", "ивановъ"), ("Ёлкин", "елкин"), ("Покровскій", "покровскій"), ("Iоаннъ", "iоаннъ"), ("HOBЫЙ", "новый"), ("XIX-го", "xix-го"), ("MOCKBA", "mockba"), ("Кóт", "кот"), ("Кóт", "кот"), ("ó", "o")]


@pytest.mark.parametrize("text,want", PRE)
def test_prereform(text, want):
    assert orthography(PREREFORM, text) == want


@pytest.mark.parametrize("text,want", MOD)
def test_modern(text, want):
    assert orthography(MODERN, text) == want


def test_words():
    assert normalize_word(PREREFORM, "Санктъ-Петербургъ") == "санкт-петербург"
    assert normalize_word(PREREFORM, "объявленіе") == "объявление"
    assert normalize_word(MODERN, "Ивановъ") == "ивановъ"


def show(rules, text):
    return [(t[0], t[6], t[7], t[1]) for t in tokenize(rules, text)]


def test_scripts():
    assert [x[0::2] for x in show(MODERN, "Kотw")] == [("K", "latin"), ("от", "cyrillic"), ("w", "latin")]
    assert show(PREREFORM, "XIX-го")[1][:2] == ("-", "punct")
    assert show(MODERN, "Kот-Cмирнов") == [("Kот-Cмирнов", "word", "cyrillic", "кот-смирнов")]
    assert [x[0] for x in show(MODERN, "Kот-Smith")] == ["Kот", "-", "Smith"]
    assert show(MODERN, "αβγ")[0][2] == "mixed"


def test_clusters():
    raws = lambda s: [t[0] for t in tokenize(PREREFORM, s)]
    assert raws("́кот") == ["кот"]
    assert raws("\U0001f468‍\U0001f469‍\U0001f467 и") == ["\U0001f468‍\U0001f469‍\U0001f467", "и"]
    assert raws("\U0001f1f7\U0001f1fa!") == ["\U0001f1f7\U0001f1fa", "!"]
    assert raws("5⃣") == ["5⃣"] and tokenize(PREREFORM, "5⃣")[0][1] == "5"
    assert raws("кот​пёс") == ["кот", "пёс"]
    assert raws("-кот-") == ["-", "кот", "-"]


@pytest.mark.parametrize("text,want", [("кот\nпёс. Кот", [0, 0, 1, 0]), ("Нижний\r\nНовгород", [0, 0]), ("кот\n\nпёс", [1, 0]), ("кот\n  \r\n\tпёс", [1, 0]), ("кот пёс", [1, 0])])
def test_sentence_ends(text, want):
    assert [int(t[10]) for t in tokenize(MODERN, text)] == want


@pytest.mark.parametrize("raw,want", [("кот", "lower"), ("Кот", "title"), ("КОТ", "upper"), ("И", "title"), ("СПб", "mixed"), ("Санкт-Петербург", "title"), ("санкт-Петербург", "mixed"), ("12", "none")])
def test_case(raw, want):
    assert case_of(raw) == want


def test_variants():
    assert reform_variants("синяго") == ["синего"]
    assert reform_variants("хорошаго") == ["хорошого", "хорошего"]
    assert reform_variants("новыя") == ["новые", "новой"]
    assert reform_variants("покровския") == ["покровские", "покровской"]
    assert reform_variants("синия") == ["синие", "синей"]
    assert reform_variants("кот") == []


def test_hyphens_and_offsets():
    (tok,) = tokenize(PREREFORM, "Санктъ-Петербургъ")
    parts = split_hyphen(tok)
    assert [(p[0], p[1]) for p in parts] == [("Санктъ", "санкт"), ("Петербургъ", "петербург")]
    assert "Санктъ-Петербургъ".encode()[parts[1][2] : parts[1][3]].decode() == "Петербургъ"
    assert utf16_offsets("a😀b", [6, 0, 5, 1, 2]) == [4, 0, 3, 1, 3]
    with pytest.raises(ValueError):
        utf16_offsets("a", [2])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("аБвKоt1 .-‐\ń‍😀🇷!ъ​"), max_size=40) | st.text(max_size=30))
def test_offset_contract(text):
    raw, last = text.encode("utf-8", "surrogatepass"), 0
    if "\ud800" <= max(text, default="") <= "\udfff" or any("\ud800" <= c <= "\udfff" for c in text):
        return
    for t in tokenize(PREREFORM, text):
        assert raw[t[2] : t[3]].decode() == t[0] == text[t[4] : t[5]]
        assert t[2] >= last
        last = t[3]


def test_columns_equal_tokens():
    import random

    from verba.functions.textnorm import TOKEN_FIELDS, token_rows

    rnd = random.Random(9)
    alphabet = "abKо т.,!\n\r\u2029 -‐1٣5\u0301\u200d😀🏽🇷🇺іѣъЪ…;$ßé\u200bx\x85XIмиp"
    texts = [None, "", "no breaks", "a.\n\nb", "г. Киев"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    for rules in (MODERN, PREREFORM):
        ends, cols = token_columns(rules, texts, TOKEN_FIELDS)
        rows = list(zip(*(cols[f].to_pylist() for f in TOKEN_FIELDS), strict=True))
        for text, lo, hi in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            assert rows[lo:hi] == tokenize(rules, text or "") == token_rows(rules, text or ""), text
        assert set(token_columns(rules, texts, ("kind",))[1]) == {"kind"}
