import datetime
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import pii

KEY = b"key"


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 10**20), st.integers(0, 10**20), st.binary(min_size=1, max_size=16))
def test_feistel_inverts(size, value, key):
    value %= size
    there = pii.feistel(value, size, key)
    assert 0 <= there < size and pii.feistel(there, size, key, invert=True) == value


def test_feistel_permutes():
    for size in (1, 2, 3, 10, 257):
        assert sorted(pii.feistel(v, size, KEY) for v in range(size)) == list(range(size))


VALUES = {
    "card": ["4845168114407329", "4845 1681 1440 7329"], "phone": ["+1 (017) 555-7713", "(443) 555-5793", "+49 30 1234 5678"],
    "ip": ["97.51.17.173", "255.255.255.255"], "date": ["2024-02-29", "31.12.1999", "01/02/2003"], "ssn": ["123-45-6789"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], "email": ["und.34@mail7.example.com", "éàß_x+1@a-b.org"],
    "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962"],
}


def test_formats():
    for kind, values in VALUES.items():
        for value in values:
            new = pii.pseudonym(kind, value, KEY)
            assert new != value and pii.pseudonym(kind, new, KEY, invert=True) == value
            if kind != "ip":
                assert len(new) == len(value)
            text, spans = pii.pseudonymised(f"see ({value})###, {value} end", KEY)
            assert [(k, text[a:b]) for k, a, b in spans] == [(kind, new)] * 2, (kind, text)
            assert value not in text


def test_names_in_any_script_are_permuted_and_back():
    for name in ("ÝxÝ", "иван.Петров", "王伟", "김철수", "αλέξης", "محمد", "ßßß", "ŁukaszŽ", "þórð", "דוד9"):
        mail = name + "@a.org"
        new = pii.pseudonym("email", mail, KEY)
        assert new != mail and len(new) == len(mail) and pii.pseudonym("email", new, KEY, invert=True) == mail, (mail, new)
        text, spans = pii.pseudonymised(f"to {mail}.", KEY)
        assert text == f"to {new}." and [k for k, _, _ in spans] == ["email"]
    for c in "aZ9éÉЖжß王가אب":
        assert all(pii.alphabet(d) == pii.alphabet(c) for d in pii.alphabet(c)[:300]) and c in pii.alphabet(c)


def test_small_formats_are_permuted_one_to_one():
    names = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"]
    assert sorted(pii.pseudonym("email", f"{n}@x.org", KEY)[:2] for n in names) == sorted(names)
    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(i)).isoformat() for i in range(73049)]
    assert sorted(pii.pseudonym("date", d, KEY) for d in days[:73049:1]) == days
    assert {pii.pseudonym("date", d[8:] + "." + d[5:7] + "." + d[:4], KEY)[6:] == pii.pseudonym("date", d, KEY)[:4] for d in days[::997]} == {True}


def test_one_number_has_one_pseudonym_however_it_is_written():
    digits = lambda t: re.sub(r"[^0-9]", "", t)
    same = ["+49 30 1234 5678", "+493012345678", "+49 (301) 2345 678"]
    assert len({digits(pii.pseudonym("phone", x, KEY)) for x in same}) == 1
    us = ["+1 (443) 555-5793", "+14435555793", "(443) 555-5793"]
    assert len({digits(pii.pseudonym("phone", x, KEY))[-10:] for x in us}) == 1
    for x in same + us + ["+351 21 123 4567", "+7 912 345 6789"]:
        new = pii.pseudonym("phone", x, KEY)
        assert new != x and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", x) and pii.pseudonym("phone", new, KEY, invert=True) == x


def test_addresses_keep_their_zeros():
    for x in ("010.001.002.003", "000.000.000.000", "10.1.2.3"):
        new = pii.pseudonym("ip", x, KEY)
        assert pii.pseudonym("ip", new, KEY, invert=True) == x and (len(new) == 15 and any(p[0] == "0" for p in new.split(".")) or x == "10.1.2.3")
    assert pii.pseudonym("ip", "10.01.2.3", KEY) is None


def test_long_text():
    mail = "und.34@mail7.example.com"
    text, spans = pii.pseudonymised(("word 12 a@b " * 200_000) + mail, KEY)
    assert len(spans) == 1 and text.endswith(pii.pseudonym("email", mail, KEY))


def test_ibans_before_capitals_and_numbers():
    es, at, be = "ES9121000418450200051332", "AT611904300234573201", "BE68 5390 0754 7034"
    for iban, after in ((es, " AND"), (es, " 12"), (es, " IBAN 12"), (at, " IBAN"), (be, " IS"), (be, " AB12 CD"), ("BE68539007547034", " " + es)):
        text, spans = pii.pseudonymised(f"to {iban}{after}", KEY)
        assert text.startswith(f"to {pii.pseudonym('iban', iban, KEY)} ") and iban not in text and es not in text, text
        assert spans[0] == ("iban", 3, 3 + len(iban))
    text, spans = pii.pseudonymised(f"NR12 ABCD {be}", KEY)
    assert text == f"NR12 ABCD {pii.pseudonym('iban', be, KEY)}" and len(spans) == 1
    other = next(f"ZZ{c:02d}539007547034" for c in range(2, 99) if pii.pseudonym("iban", f"ZZ{c:02d}539007547034", KEY))
    assert other not in pii.pseudonymised(f"{other} IS", KEY)[0]


def test_invalid_is_left():
    for text in ("9807915762804490", "300.1.1.1", "31.02.2020", "2023-02-29", "000-12-3456", "GB82 WEST 1234 5698 7654 33", "v1.2.3.4.5", "call 12", "a@b"):
        assert pii.pseudonymised(text, KEY) == (text, [])


def test_documents(spark):
    rows = [(1, "mail und.34@mail7.example.com", "x"), (2, "again und.34@mail7.example.com", None), (3, None, None), (4, "", "y"), (4, "", "y"), (None, "10.0.0.1", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string").withColumnRenamed("pii", "start").repartition(3)
    found = pii.pseudonymise(docs, KEY).collect()
    assert len(found) == 6
    by = {r["doc_id"]: r for r in found}
    assert by[1]["text"].split()[1] == by[2]["text"].split()[1] != "und.34@mail7.example.com"
    assert by[3]["text"] is None and by[3]["pii"] == [] and by[1]["start"] == "x"
    assert re.fullmatch(r"[\d.]+", by[None]["text"])
    assert pii.pseudonymise(docs.limit(0), KEY).count() == 0
