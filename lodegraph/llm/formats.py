"""Numbers and dates of people: the formats they are written in, their validation, and keyed permutations within them.

A format says which characters of a value identify someone (its core) and which only belong to the layout: separators,
country code, trunk zero, check digit. A value is permuted by a Feistel network over its core alone. Where not every
core is valid, the permutation is walked until it meets a valid one, which keeps it a bijection on the valid ones. Check
digits are computed anew, and only where the value's own was right.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable

ROUNDS = 10
DIGITS, LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# --- Fixed values: numbering plans and check digits -------------------------------------------------------------------
#: Country codes of two digits; 1 and 7 have one digit, all others three.
TWO_DIGIT_COUNTRIES = (
    20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58,
    60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98,
)
#: Check letters of Spanish identity cards, by the number modulo 23.
CARD_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
INSURANCE_NEVER = ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")
MONTHS = (
    ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
    ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"),
    ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
)


# --- Permutations -----------------------------------------------------------------------------------------------------
def feistel(value: str, alphabet: str, key: bytes) -> str:
    """Keyed permutation of the strings over `alphabet` of this length (one character is shifted)."""
    n, radix = len(value), len(alphabet)
    if n == 0:
        return value
    digits = [alphabet.index(c) for c in value]

    def mix(r: int, half: list[int], modulus: int) -> int:
        h = hashlib.blake2b(bytes([r, n % 256, radix]) + bytes(half), key=key, digest_size=16)
        return int.from_bytes(h.digest(), "big") % modulus

    if n == 1:
        return alphabet[(digits[0] + mix(0, [], radix)) % radix]
    a, b = digits[: n // 2], digits[n // 2 :]
    for r in range(ROUNDS):
        size = radix ** len(a)
        x = 0
        for d in a:
            x = x * radix + d
        x = (x + mix(r, b, size)) % size
        new = []
        for _ in a:
            x, d = divmod(x, radix)
            new.append(d)
        a, b = b, new[::-1]
    return "".join(alphabet[d] for d in a + b)


def walk(value: str, alphabet: str, key: bytes, valid: Callable[[str], bool]) -> str:
    """Permutation of the valid strings: the network is applied until it meets one. `value` must be valid."""
    out = feistel(value, alphabet, key)
    while not valid(out):
        out = feistel(out, alphabet, key)
    return out


def shift(n: int, size: int, key: bytes) -> int:
    """Keyed permutation of 0..size-1, walked on the decimal strings that hold them."""
    width = len(str(size - 1))
    return int(walk(f"{n:0{width}}", DIGITS, key, lambda s: int(s) < size))


def _fill(layout: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in layout)


# --- Phone numbers ------------------------------------------------------------------------------------------------------
_EXTENSION = re.compile(r"[ ,]{0,2}(?:ext|x|Durchwahl|poste)\.?[ ]?(\d{1,5})$", re.I)


def country_code(digits: str) -> int:
    """How many leading digits of an international number are its country code."""
    if digits[:1] in ("1", "7"):
        return 1
    return 2 if int(digits[:2] or 0) in TWO_DIGIT_COUNTRIES else 3


def north_american(national: str) -> bool:
    return len(national) == 10 and national[0] in "23456789" and national[3] in "23456789"


def split_phone(s: str) -> tuple[str, str, str, bool] | None:
    """(country code, national number without trunk zero, extension, whether it follows the ten-digit plan), or None if no plan allows it."""
    m = _EXTENSION.search(s)
    body, extension = (s[: m.start()], m[1]) if m else (s, "")
    digits = "".join(c for c in body if c.isdigit())
    if len(set(digits)) < 3:
        return None
    if body.lstrip("( ").startswith("+"):
        if not 8 <= len(digits) <= 15:
            return None
        n = country_code(digits)
        country, national = digits[:n], digits[n:]
        if country == "1" and not north_american(national):
            return None
        return (country, national.removeprefix("0"), extension, country == "1") if len(national) >= 5 else None
    if digits[0] == "0":
        return ("", digits[1:], extension, False) if 9 <= len(digits) <= 13 else None
    national = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    return ("1" if len(digits) == 11 else "", national, extension, True) if north_american(national) else None


def permute_phone(s: str, key: bytes) -> str:
    """The national number is permuted; country code, trunk zero and layout stay. With and without country code a number gets the same digits."""
    parts = split_phone(s)
    if parts is None:
        return s
    country, national, extension, plan = parts
    ok = north_american if plan else lambda x: x[0] != "0"
    new = walk(national, DIGITS, key, ok) if ok(national) else feistel(national, DIGITS, key)
    m = _EXTENSION.search(s)
    body = s[: m.start()] if m else s
    kept = "".join(c for c in body if c.isdigit())
    kept = kept[: len(kept) - len(national)]
    tail = s[m.start() :] if m else ""
    return _fill(body, kept + new) + (_fill(tail, feistel(extension, DIGITS, key)) if extension else tail)


# --- Identity numbers ---------------------------------------------------------------------------------------------------
def social_security(d: str) -> bool:
    """Nine digits that the format allows: no part all zeros, not 666, not one digit throughout. The 9xx range, which only taxpayer numbers use, is allowed."""
    return len(d) == 9 and d.isdecimal() and d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000" and len(set(d)) > 1


def national_insurance(v: str) -> bool:
    """Two letters, six digits, A to D. QQ, which official texts use for examples, is allowed."""
    return bool(re.fullmatch(r"(?:QQ|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z])\d{6}[A-D]", v)) and v[:2] not in INSURANCE_NEVER


def card_letter(v: str) -> str | None:
    """The check letter of a Spanish card: 8 digits, or X, Y, Z and 7."""
    number = str("XYZ".find(v[0])) + v[1:8] if v[0] in "XYZ" else v[:8]
    return CARD_LETTERS[int(number) % 23] if number.isdecimal() and len(number) == 8 else None


def luhn(d: str) -> str:
    """The digit that makes d + digit pass the Luhn check."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(d)))
    return str(-total % 10)


def mod_11_10(d: str) -> str:
    """The check digit of a German tax number's first ten digits (ISO 7064, MOD 11,10)."""
    p = 10
    for c in d:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return str((11 - p) % 10)


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02}"


def french_check(d: str) -> str:
    return f"{97 - int(d) % 97:02}"


#: Name of a format: shape of the value without separators, and whether a value of that shape passes its check.
CHECKED = {
    "iban": (re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}"), lambda v: iban_check(v[:2], v[4:]) == v[2:4]),
    "payment_card": (re.compile(r"[2-6]\d{12,18}"), lambda v: len(set(v)) > 1 and luhn(v[:-1]) == v[-1]),
    "french_insee": (re.compile(r"[12]\d{2}(?:0[1-9]|1[0-2]|[2-4]\d|5\d)\d{10}"), lambda v: french_check(v[:13]) == v[13:]),
    "spanish_card": (re.compile(r"(?:\d{8}|[XYZ]\d{7})[A-Z]"), lambda v: card_letter(v) == v[-1]),
    "german_tax": (re.compile(r"[1-9]\d{10}"), lambda v: mod_11_10(v[:10]) == v[10]),
}
#: Formats that need no label: their check, or their own grouping, tells them from other numbers.
BARE = ("iban", "payment_card", "french_insee")


def id_format(s: str) -> tuple[str, bool] | None:
    """(format, whether its check digit is right) of an identity number, or None if no format allows it."""
    v = re.sub(r"[\s -]", "", s).upper()
    if social_security(v):
        return "social_security", True
    if national_insurance(v):
        return "national_insurance", True
    for name, (shape, check) in CHECKED.items():
        if shape.fullmatch(v):
            return name, check(v)
    if re.fullmatch(r"[A-Z]{1,2}\d{6,9}|[A-Z]\d{2}[A-Z0-9]{6,8}" + (r"|\d{9}" if s.isalnum() else ""), v) and len(set(v)) > 2 and any(c.isdigit() for c in v):
        return "passport", True
    return None


def permute_id(s: str, key: bytes) -> str:
    """Digits and letters permuted within the format; country letters, check digits and separators keep their role."""
    found = id_format(s)
    v = [c.upper() for c in s if c.isascii() and c.isalnum()]
    name, right = found or ("passport", True)
    text = "".join(v)
    if name == "social_security":
        new = walk(text, DIGITS, key, social_security)
    elif name == "iban":
        account = _core(text[4:], key)
        new = text[:2] + (iban_check(text[:2], account) if right else text[2:4]) + account
    elif name == "payment_card":
        body = text[:1] + feistel(text[1:-1], DIGITS, key)
        new = body + (luhn(body) if right else text[-1])
    elif name == "french_insee":
        body = text[:1] + walk(text[1:13], DIGITS, key, lambda x: CHECKED[name][0].fullmatch(text[0] + x + text[13:]) is not None)
        new = body + (french_check(body) if right else text[13:])
    elif name == "spanish_card":
        body = text[:1] + feistel(text[1:8], DIGITS, key) if text[0] in "XYZ" else feistel(text[:8], DIGITS, key)
        new = body + (card_letter(body + "A") if right else text[-1])
    elif name == "german_tax":
        body = walk(text[:10], DIGITS, key, lambda x: x[0] != "0")
        new = body + (mod_11_10(body) if right else text[10])
    elif name == "national_insurance":
        new = text[:2] + feistel(text[2:8], DIGITS, key) + text[8:]
    else:
        new = _core(text, key)
    it = iter(new)
    return "".join((str.lower if c.islower() else str)(next(it)) if c.isascii() and c.isalnum() else c for c in s)


def _core(text: str, key: bytes) -> str:
    """Digits permuted among digits, letters among letters."""
    ds = iter(feistel("".join(c for c in text if c.isdigit()), DIGITS, key))
    ls = iter(feistel("".join(c for c in text if c.isalpha()), LETTERS, key))
    return "".join(next(ds) if c.isdigit() else next(ls) for c in text)


# --- Dates --------------------------------------------------------------------------------------------------------------
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), 73_049  # through 2099-12-31
_ISO = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})")
_NUMERIC = re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})")
_NAMED = re.compile(r"(\d{1,2})(\.?(?:st|nd|rd|th)?(?: de)? )([^\W\d_]+)((?: de)? )(\d{4})")


def split_date(s: str) -> tuple[dt.date, Callable[[dt.date], str]] | None:
    """(date, how to write another one the same way), or None for what the calendar doesn't know. Day before month, unless only the other order is a date."""
    def day(y: int, m: int, d: int) -> dt.date | None:
        try:
            got = dt.date(y, m, d)
        except ValueError:
            return None
        return got if 0 <= got.toordinal() - FIRST_DAY < DAYS else None

    m = _ISO.fullmatch(s)
    if m:
        got = day(int(m[1]), int(m[3]), int(m[4]))
        two = len(m[3]) == 2 and len(m[4]) == 2
        return got and (got, lambda x: m[2].join((f"{x.year}", f"{x.month:02}" if two else str(x.month), f"{x.day:02}" if two else str(x.day))))
    m = _NUMERIC.fullmatch(s)
    if m:
        two = len(m[1]) == 2 and len(m[3]) == 2
        put = (lambda n: f"{n:02}") if two else str
        got = day(int(m[4]), int(m[3]), int(m[1]))
        if got:
            return got, lambda x: m[2].join((put(x.day), put(x.month), str(x.year)))
        got = day(int(m[4]), int(m[1]), int(m[3]))
        return got and (got, lambda x: m[2].join((put(x.month), put(x.day), str(x.year))))
    m = _NAMED.fullmatch(s)
    names = next((names for names in MONTHS if m[3].lower() in names), None) if m else None
    got = day(int(m[5]), names.index(m[3].lower()) + 1, int(m[1])) if names else None
    case = str.capitalize if m and m[3][0].isupper() else str
    return got and (got, lambda x: (f"{x.day:02}" if m[1][0] == "0" else str(x.day)) + m[2] + case(names[x.month - 1]) + m[4] + str(x.year))


def permute_date(s: str, key: bytes) -> str:
    """Another date of 1900 to 2099, written the same way; equal dates get equal ones in every format."""
    found = split_date(s)
    if not found:
        return s
    date, write = found
    return write(dt.date.fromordinal(FIRST_DAY + shift(date.toordinal() - FIRST_DAY, DAYS, key)))
