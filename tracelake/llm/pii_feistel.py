"""Format-preserving pseudonyms for personal data.

Each value that passes its check (Luhn, modulus 97, ranges of octets, the calendar) is permuted by a keyed Feistel network
within the set of valid values of its format, so that the result passes the same check, looks the same, and equal values
stay equal across documents. The key holder can turn it round, but for the writing of a date: one whose day or month has lost or gained
a digit comes back as the same day in the other writing.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from tracelake.llm.common import map_texts

ROUNDS = 10
KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")
#: First and last day of the dates that are permuted among each other.
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0 .. n - 1, for any n; values outside a square grid walk on until they fall inside."""

    def __init__(self, key: bytes):
        self.key = key

    def _part(self, tag: str, round_: int, x: int, m: int) -> int:
        size = 16 + (m.bit_length() + 7) // 8
        out = b""
        while len(out) < size:
            out += hashlib.blake2b(f"{tag}:{round_}:{x}:{m}:{len(out)}".encode(), key=self.key[:64], digest_size=64).digest()
        return int.from_bytes(out[:size], "big") % m

    def encrypt(self, tag: str, x: int, n: int) -> int:
        m = max(1, math.isqrt(n - 1) + 1)
        while True:
            a, b = divmod(x, m)
            for r in range(ROUNDS):
                a, b = b, (a + self._part(tag, r, b, m)) % m
            x = a * m + b
            if x < n:
                return x

    def decrypt(self, tag: str, x: int, n: int) -> int:
        m = max(1, math.isqrt(n - 1) + 1)
        while True:
            a, b = divmod(x, m)
            for r in reversed(range(ROUNDS)):
                a, b = (b - self._part(tag, r, a, m)) % m, a
            x = a * m + b
            if x < n:
                return x


def luhn(digits: str) -> int:
    """The sum that is divisible by 10 for a valid number."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))


def fill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


#: Letters beyond ASCII that are permuted among each other; of other scripts they stay as they are.
SCRIPTS = {"l": "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "g": "αβγδεζηθικλμνξοπρστυφχψω", "c": "абвгдежзийклмнопрстуфхцчшщъыьэюя"}


def _characters(run: Callable, tag: str, s: str, skip: int = 0) -> str:
    """Letters and digits of ``s`` from ``skip`` on, permuted within their classes as one mixed-radix number."""
    sets = {"0": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | SCRIPTS
    kind = ["" if i < skip else next((k for k, own in sets.items() if c in own), "") for i, c in enumerate(s)]
    x, n = 0, 1
    for c, k in zip(s, kind, strict=True):
        if k:
            x, n = x * len(sets[k]) + sets[k].index(c), n * len(sets[k])
    y, out = run(tag + ":" + "".join(k or "." for k in kind), x, n), []
    for c, k in zip(reversed(s), reversed(kind), strict=True):
        if k:
            y, at = divmod(y, len(sets[k]))
            c = sets[k][at]
        out.append(c)
    return "".join(reversed(out))


def _card(run: Callable, s: str) -> str | None:
    digits = "".join(c for c in s if c.isdigit())
    if not 13 <= len(digits) <= 19 or luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    n = 10 ** (len(digits) - 1)
    body = str(run(f"card{len(digits)}", int(digits[:-1]), n)).zfill(len(digits) - 1)
    return fill(s, body + str(-luhn(body + "0") % 10))


def _iban(run: Callable, s: str) -> str | None:
    plain = s.replace(" ", "")

    def number(t: str) -> int:
        return int("".join(str(int(c, 36)) for c in t))

    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _characters(run, "iban" + plain[:2], plain[4:])
    out = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(out) for c in s)


#: Numbers of country 1 without its code: ten digits as three, three and four.
PLAIN_NORTH = re.compile(r"\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[2-9][0-9]{2}[\x20.-][0-9]{3}[\x20.-][0-9]{4}")


def _phone(run: Callable, s: str) -> str | None:
    """Numbers of country 1 are one set, with or without its code; their first digit stays below 2, or from 2 on."""
    digits = "".join(c for c in s if c.isdigit())
    if not 8 <= len(digits) <= 15:
        return None
    north = len(digits) == 11 and digits[0] == "1" or (len(digits) == 10 and PLAIN_NORTH.fullmatch(s) is not None)
    if north:
        low, x = 2 * 10**9, int(digits[-10:])
        y = run("phone1 low", x, low) if x < low else low + run("phone1", x - low, 10**10 - low)
        return fill(s, digits[:-10] + str(y).zfill(10))
    code = digits[: -7 if len(digits) < 11 else -10]
    rest = digits[len(code) :]
    return fill(s, code + str(run(f"phone{code}", int(rest), 10 ** len(rest))).zfill(len(rest)))


def _ssn(run: Callable, s: str) -> str | None:
    a, b, c = map(int, s.split("-"))
    if not (0 < a < 900 and a != 666 and b and c):
        return None
    areas = 898
    x = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
    y, c = divmod(run("ssn", x, areas * 99 * 9999), 9999)
    a, b = divmod(y, 99)
    return f"{a + 1 + (a + 1 >= 666):03d}-{b + 1:02d}-{c + 1:04d}"


def _ip(run: Callable, s: str) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    y = run("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, y.to_bytes(4, "big")))


def _date(run: Callable, s: str) -> str | None:
    """Orders of day, month and year are tried in turn; a day without leading zeros may gain or lose a digit.

    The days up to the 12th and the later ones are permuted among each other, in all orders alike: so the same day has
    the same pseudonym in each, and a result reads back in its own order.
    """
    a, b, c = re.split(r"[./-]", s)
    mark = s[len(a)]
    orders = ["ymd"] if len(a) == 4 else ["mdy", "dmy"] if mark == "/" else ["dmy"]
    for order in orders:
        at = dict(zip(order, map(int, (a, b, c)), strict=True))
        try:
            day = datetime.date(at["y"], at["m"], at["d"]).toordinal()
        except ValueError:
            continue
        if not FIRST <= day <= LAST:
            continue
        while True:
            day = FIRST + run("date", day - FIRST, LAST - FIRST + 1)
            new = datetime.date.fromordinal(day)
            if (new.day > 12) == (at["d"] > 12):
                break
        width = {"y": 4, "m": 2, "d": 2} if len(a) != 1 and len(b) != 1 else {"y": 4, "m": 1, "d": 1}
        value = {"y": new.year, "m": new.month, "d": new.day}
        return mark.join(str(value[k]).zfill(width[k]) for k in order)
    return None


def _email(run: Callable, s: str) -> str | None:
    """Addresses that differ in case alone are one; each keeps the cases of its letters, so that it can be turned round."""
    local, domain = s.rsplit("@", 1)
    new = _characters(run, "email@" + domain.lower(), "".join(low if len(low := c.lower()) == 1 else c for c in local))
    return "".join(n.upper() if c.isupper() else n for c, n in zip(local, new, strict=True)) + "@" + domain


#: The formats. At one place the first kind whose check a value passes wins.
FORMATS = {
    "email": r"(?<![\w.+%-])[^\W_][\w.%+'’-]*@(?:[\w-]+\.)+[^\W0-9_]{2,}",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    # A date may stand before the T of a time.
    "date": r"(?<![\w./-])(?:[0-9]{4}(?P<m>[./-])[0-9]{1,2}(?P=m)[0-9]{1,2}|[0-9]{1,2}(?P<n>[./-])[0-9]{1,2}(?P=n)[0-9]{4})(?![/-]|(?![Tt][0-9]{2}:?[0-9]{2})\w)",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w|-\w)",
    "phone": r"(?<!\w)\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-]?[0-9]{2,4}){1,4}(?!\w)|(?<!\w)\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?!\w)",
    "card": r"(?<![\w+.-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\w-]|\.[0-9])",
}
#: Cards whose digits stand together or as printed: these go before a longer run of digits that passes by chance, but for digits behind
#: a dash, which belong to them.
PRINTED = r"(?<![\w+.-])(?:[0-9]{13,19}|(?:[0-9]{4}(?P<a>[\x20-])[0-9]{4}(?P=a)[0-9]{4}(?P=a)[0-9]{4}|[0-9]{4}(?P<b>[\x20-])[0-9]{6}(?P=b)[0-9]{4,5})(?!-[0-9]))(?!\w|\.[0-9]|-[^\W0-9])"
#: Cards in other groups, of three digits at least: these may begin behind any row of digits.
GROUPED = r"(?<![\w+.-])[0-9]{3,16}(?:[\x20-][0-9]{3,16}){1,5}(?!\w|\.[0-9]|-[^\W0-9])"
#: Phones of country 1 have ten more digits: what follows is not theirs.
NORTH = r"(?<!\w)\+1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?!\w)"
#: Phones without a country's code: three, three and four digits, pairs from 0 on, or an area from 0 on.
NATIONAL = (
    r"(?<![\w.+-])(?:(?:1(?P<p>[\x20.-])[0-9]{3}(?P=p)|[2-9][0-9]{2}(?P<q>[\x20.-]))[0-9]{3}[\x20.-][0-9]{4}|0[0-9](?P<r>[\x20.-])[0-9]{2}(?:(?P=r)[0-9]{2}){3}"
    r"|0[0-9]{1,4}[\x20/-][0-9]{3,4}[\x20-][0-9]{3,4}|0[0-9]{1,4}[\x20/-][0-9]{6,8})(?![\w-]|\.[0-9])"
)
#: Lengths of IBANs by country: an end that fits goes before others.
LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 "
        "IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 "
        "SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
#: The forms in the order that they are tried.
FORMS = [(k, re.compile(f)) for k, f in [*list(FORMATS.items())[:-2], ("phone", NORTH), ("phone", FORMATS["phone"]), ("card", PRINTED), ("card", GROUPED), ("phone", NATIONAL), ("card", FORMATS["card"])]]
OTHERS = [form for kind, form in FORMS if kind in ("ip", "date", "ssn")]
PATTERN = re.compile("|".join(form.pattern for _, form in FORMS))


def ends(kind: str, form: re.Pattern, text: str, start: int) -> list[int]:
    """Ends of a form at ``start``: the longest, then those between groups of letters and digits, from right to left.

    A phone or card does not end within an address, a date or a security number that begins in it.
    """
    if (m := form.match(text, start)) is None:
        return []
    out = [m.end()]
    if kind in ("iban", "phone", "card"):
        cuts = [b for b in range(m.end() - 1, start, -1) if text[b] in " .-"]
        out += [b for b in cuts if (c := form.match(text, start, b)) is not None and c.end() == b]
        if kind != "iban":
            begun = [m.span() for c in cuts for o in OTHERS if (m := o.match(text, c + 1)) is not None]
            out = [b for b in out if not any(a < b < e for a, e in begun)]
    if kind == "iban":
        out.sort(key=lambda b: len(text[start:b].replace(" ", "")) != LENGTHS.get(text[start : start + 2]))
    if form.pattern == FORMATS["card"]:
        # Groups of one or two digits are rows of numbers rather than a card cut short.
        out[1:] = [b for b in out[1:] if min(map(len, re.split("[ -]", text[start:b]))) >= 3]
    return out


CHECKS = {"email": _email, "iban": _iban, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date}
QUICK = re.compile(r"[0-9@]")


class Pseudonyms:
    """Replaces every valid value of a text; ``back`` turns the values round with the same key."""

    def __init__(self, key: str):
        self.feistel = Feistel(key.encode())
        self.forth = lru_cache(100_000)(self._forth)

    def __reduce__(self):
        return Pseudonyms, (self.feistel.key.decode(),)

    def _forth(self, kind: str, value: str) -> str | None:
        return CHECKS[kind](self.feistel.encrypt, value)

    def back(self, kind: str, value: str) -> str | None:
        return CHECKS[kind](self.feistel.decrypt, value)

    def spans(self, text: str) -> list[tuple[str, int, int, str]]:
        """(kind, start, end, pseudonym) of the values, from left to right.

        Where no form passes its check, the search goes on behind the first character; digits that failed as a card
        of any grouping are not tried so again from a later start, only as printed.
        """
        out, at, tried = [], 0, 0
        while (m := PATTERN.search(text, at) if at or QUICK.search(text) else None) is not None:
            start, at = m.start(), m.start() + 1
            for kind, form in FORMS:
                loose = form.pattern == FORMATS["card"]
                places = ends(kind, form, text, start) if not loose or start >= tried else []
                hit = next(((b, new) for b in places if (new := self.forth(kind, text[start:b])) is not None), None)
                if hit is not None:
                    out.append((kind, start, *hit))
                    at = hit[0]
                    break
                if loose and places:
                    tried = places[0]
        return out

    def apply(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        found, out, at = self.spans(text), [], 0
        for _, a, b, new in found:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), found


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but the text) of every row, the text with its values replaced, and the counts ``n_<kind>``.

    The same ``key`` gives the same pseudonyms everywhere. Whole texts are searched; a null text becomes empty with
    counts of zero. Numbers that fail their check stay as they are, and so do IBANs in small letters or with dashes, which are no format here; letters of
    a mail's name beyond ASCII are replaced in Latin, Greek and Cyrillic script, domains stay. Rows with null ids and repeated rows each come out.
    Columns named like the counts are replaced. An empty table gives an empty result.
    """
    names = [f"n_{k}" for k in KINDS]
    own = [c for c in (keep if keep is not None else docs.columns) if c != text_col and c not in names]
    shared = Pseudonyms(key)

    def run(texts: list[str]) -> list[list]:
        made = [shared.apply(t) for t in texts]
        return [[m[0] for m in made], *[[sum(s[0] == k for s in m[1]) for m in made] for k in KINDS]]

    return map_texts(docs, own, text_col, [StructField(text_col, StringType()), *[StructField(n, LongType()) for n in names]], run)
