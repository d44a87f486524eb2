"""Personal data as format-preserving pseudonyms.

What is found and validated is replaced by another value of the same format: a keyed Feistel permutation with
cycle-walking over exactly that format's values. Equal values get equal pseudonyms in all documents, so they stay
linked; different ones stay different; and who has the key can invert the permutation.

    card      13 to 19 digits that pass the Luhn check (the pseudonym passes it too)
    iban      country, check digits and account that pass mod 97 (so does the pseudonym)
    phone     +country (area) number, +country and 7 to 12 digits, or (area) number: digits only change, to the same
              ones however they are grouped, with the country's code or without
    ssn       ddd-dd-dddd with valid parts
    ip        four numbers up to 255, none or all of them filled up to three digits with zeros
    date      yyyy-mm-dd, dd.mm.yyyy or dd/mm/yyyy with a real day from 1900 to 2099
    email     letters and digits of the part before @, in any script; the domain stays
    secret    32 or more hexadecimal digits in one run, in a text with a decimal digit

As with any permutation, a value may be its own pseudonym, by chance of one in the number of its format's values; for a
name of one letter that is one in 26. Such a value is listed as replaced all the same.

Numbers that fail their check (other 16-digit numbers, 300.1.1.1, 31.02.2020) are left alone.

Defined cases: a null text stays null with no spans; a long text is scanned as a whole, in time that grows with it; equal rows get equal results; an empty table gives no rows; other
columns pass through; a column named like an output is replaced by it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices

ROUNDS = 10

LOWER = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
ALPHABETS = ["0123456789", LOWER, LOWER.upper(), ACCENTED, "".join(c.upper() for c in ACCENTED if len(c.upper()) == 1)]
#: First and last code points of scripts that are one alphabet: ideographs, Hangul syllables.
WIDE = [(0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
BLOCK = 128  # of any other script, the letters of one kind in such a run of code points are an alphabet
#: Country codes of two digits; 1 and 7 are the codes of one, all others have three.
_TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_EMAIL = re.compile(r"(?<![\w.+%-])[^\W_][\w.+%-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_DIGIT = re.compile(r"[0-9]")
_NUMBERS = re.compile(
    r"""(?P<secret>(?<![0-9A-Za-z])(?=[0-9a-f]{32}|[0-9A-F]{32})[0-9A-Fa-f]{32,}(?![0-9A-Za-z]))
    |(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9][0-9]-[0-9][0-9]|[0-9][0-9][./][0-9][0-9][./][0-9]{4})(?![0-9/-]|\.[0-9]))
    |(?P<ip>(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9]))
    |(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9][0-9]-[0-9]{4}(?![0-9-]))
    |(?P<phone>(?<![\w+])\+[0-9]{1,3}[ -]?\([0-9]{2,4}\)[ -]?[0-9]{3,4}[ -][0-9]{3,4}(?![0-9])|(?<![\w+])\+[0-9]{1,3}(?:[ -][0-9]{2,4}){2,4}(?![0-9])|(?<![\w+])\+[0-9]{8,15}(?![0-9])|(?<!\w)\([0-9]{3}\)[ -]?[0-9]{3}-[0-9]{4}(?![0-9]))
    |(?P<card>(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]))""",
    re.X,
)
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
#: Characters of an IBAN by country, without spaces.
_IBAN_SIZES = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def feistel(value: int, size: int, key: bytes, rounds: int = ROUNDS, invert: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network over the next even power of two, walked along
    its cycle until it is inside again (four steps on average at most)."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    n_bytes = (half + 7) // 8
    label = size.to_bytes((size.bit_length() + 7) // 8, "big")

    def mix(r: int, x: int) -> int:
        data = bytes([r]) + x.to_bytes(n_bytes, "big") + label
        return int.from_bytes(hashlib.shake_256(key + data).digest(n_bytes), "big") & mask

    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(rounds)) if invert else range(rounds):
            if invert:
                left, right = right ^ mix(r, left), left
            else:
                left, right = right, left ^ mix(r, right)
        value = left << half | right
        if value < size:
            return value


def _luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(int(c) for c in reversed(digits)))
    return -total % 10


def _fill(shape: str, digits: str) -> str:
    """The digits in the places of the digits of shape."""
    at = iter(digits)
    return "".join(next(at) if c.isdigit() else c for c in shape)


@lru_cache(1 << 12)
def alphabet(c: str) -> str:
    """The characters among which c may be changed: every one of them has the same alphabet. Empty for what is neither a
    letter nor a digit."""
    for known in ALPHABETS:
        if c in known:
            return known
    if not (c.isalpha() or c.isdecimal()):
        return ""
    for first, last in WIDE:
        if first <= ord(c) <= last:
            return "".join(map(chr, range(first, last + 1)))
    start, kind = ord(c) // BLOCK * BLOCK, unicodedata.category(c)
    return "".join(d for d in map(chr, range(start, start + BLOCK)) if unicodedata.category(d) == kind and not any(d in known for known in ALPHABETS))


def _mixed_radix(text: str, key: bytes, invert: bool) -> str:
    """Permutes characters within their alphabets; others stay where they are."""
    own = [alphabet(c) for c in text]
    size, value = 1, 0
    for c, k in zip(text, own, strict=True):
        if k:
            size, value = size * len(k), value * len(k) + k.index(c)
    value = feistel(value, size, key, invert=invert)
    out = list(text)
    for i in reversed(range(len(text))):
        if own[i]:
            value, at = divmod(value, len(own[i]))
            out[i] = own[i][at]
    return "".join(out)


_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def pseudonym(kind: str, found: str, key: bytes, invert: bool = False) -> str | None:
    """The value that stands for what was found, of the same format; None where it isn't valid for its kind."""
    own = hashlib.blake2b(kind.encode(), key=key[:64], digest_size=32).digest()
    digits = re.sub(r"\D", "", found)
    if kind == "card":
        if _luhn(digits[:-1]) != int(digits[-1]):
            return None
        body = str(feistel(int(digits[:-1]), 10 ** (len(digits) - 1), own, invert=invert)).zfill(len(digits) - 1)
        return _fill(found, body + str(_luhn(body)))
    if kind == "phone":
        # by the code's own length, not by the spelling: a number has one pseudonym however its digits are grouped
        code = 0 if found[0] != "+" else 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGITS else 3
        body = str(feistel(int(digits[code:]), 10 ** (len(digits) - code), own, invert=invert)).zfill(len(digits) - code)
        return _fill(found, digits[:code] + body)
    if kind == "ssn":
        if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000":
            return None
        area = [a for a in range(1, 900) if a != 666]
        value = (area.index(int(digits[:3])) * 99 + int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1
        value, serial = divmod(feistel(value, len(area) * 99 * 9999, own, invert=invert), 9999)
        at, group = divmod(value, 99)
        return f"{area[at]:03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "ip":
        parts = found.split(".")
        padded = any(p[0] == "0" and p != "0" for p in parts)
        if max(map(int, parts)) > 255 or padded and any(len(p) != 3 for p in parts):
            return None
        value = int.from_bytes(bytes(map(int, parts)), "big")
        while True:  # an address with all parts filled up with zeros becomes another one of these
            value = feistel(value, 1 << 32, own, invert=invert)
            new = [f"{x:03d}" if padded else str(x) for x in value.to_bytes(4, "big")]
            if not padded or any(p[0] == "0" for p in new):
                return ".".join(new)
    if kind == "date":
        year, month, day = (found[:4], found[5:7], found[8:]) if found[4] == "-" else (found[6:], found[3:5], found[:2])
        try:
            at = datetime.date(int(year), int(month), int(day)).toordinal()
        except ValueError:
            return None
        if not _FIRST_DAY <= at <= _LAST_DAY:
            return None
        new = datetime.date.fromordinal(_FIRST_DAY + feistel(at - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, own, invert=invert))
        return new.isoformat() if found[4] == "-" else new.strftime(f"%d{found[2]}%m{found[5]}%Y")
    if kind == "iban":
        plain = found.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _iban_number(plain) % 97 != 1:
            return None
        body = _mixed_radix(plain[4:], own, invert)
        checked = plain[:2] + f"{98 - _iban_number(plain[:2] + '00' + body) % 97:02d}" + body
        at = iter(checked)
        return "".join(c if c == " " else next(at) for c in found)
    if kind == "email":
        local, domain = found.split("@", 1)
        return _mixed_radix(local, own, invert) + "@" + domain
    alphabet = "0123456789abcdef" if found == found.lower() else "0123456789ABCDEF"
    if any(c not in alphabet for c in found):
        return None
    return f"{feistel(int(found, 16), 16 ** len(found), own, invert=invert):0{len(found)}{'x' if alphabet[-1] == 'f' else 'X'}}"


def _ibans(text: str) -> Iterator[tuple[int, int, str]]:
    """Valid IBANs. Capitals and digits that follow may look like further groups: an IBAN ends at its country's length,
    or else where the match does, or else, for a country without a known length, at the last border where it is valid."""
    at = 0
    while m := _IBAN.search(text, at):
        start, longest = m.span()
        borders = [e for e in range(longest, start, -1) if e == longest or text[e] == " "]
        size = _IBAN_SIZES.get(text[start : start + 2])
        if size:
            borders = [e for e in borders if len(text[start:e].replace(" ", "")) == size] + [longest]
        end = next((e for e in borders if pseudonym("iban", text[start:e], b"k") is not None), None)
        if end is not None:
            yield start, end, "iban"
        at = start + 1 if end is None else end


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates, in order and without overlaps; what an earlier kind holds stays with it."""
    spans: list[tuple[int, int, str]] = []
    if "@" in text:
        spans += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if not _DIGIT.search(text):
        return spans
    spans += _ibans(text)
    spans += [(m.start(), m.end(), m.lastgroup) for m in _NUMBERS.finditer(text)]
    kept, last = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= last:
            kept.append((start, end, kind))
            last = end
    return kept


def pseudonymised(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in it."""
    parts, spans, at, shift = [], [], 0, 0
    for start, end, kind in find(text):
        new = pseudonym(kind, text[start:end], key)
        if new is None:
            continue
        parts += [text[at:start], new]
        spans.append((kind, start + shift, start + shift + len(new)))
        shift += len(new) - (end - start)
        at = end
    return ("".join([*parts, text[at:]]) if parts else text), spans


SPANS = "array<struct<kind:string,start:int,end:int>>"


def pseudonymise(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """The table with its text pseudonymised, and `pii`: kind, start and end of each replacement in the new text."""
    rest = [c for c in docs.columns if c not in (column, "pii")]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").cast("string").alias(column))
    schema = T.StructType([*rows.schema.fields, T.StructField("pii", T.DataType.fromDDL(SPANS))])
    span_type = to_arrow_type(schema["pii"].dataType)

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, column):
            found = [(None, []) if t is None else pseudonymised(t, key) for t in texts]
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in found], span_type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t for t, _ in found], pa.string()), spans], names=[*rest, column, "pii"])

    return rows.mapInArrow(replaced, schema)
