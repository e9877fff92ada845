"""Personal data against definitions written out here: no pattern, order or check of the code under test is used."""

import datetime
import ipaddress
import random

import pytest

from tracelake.llm import pii_feistel
from tracelake.llm.queries import QUERIES

WORDS = ["with", "and", "paid", "see", "older", "from", "the", "call"]
#: Countries and the lengths of their IBANs.
COUNTRIES = {"BE": 16, "DE": 22, "GB": 22, "ES": 24, "FR": 27, "NO": 15, "MT": 31, "PL": 28}


def card_sum(digits):
    """Every second digit from the right counts double, and what exceeds nine by its digits."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        tens, ones = divmod(int(d) * (1 + place % 2), 10)
        total += tens + ones
    return total


def digits_of(s):
    return [c for c in s if c in "0123456789"]


def is_card(s):
    d = digits_of(s)
    return 13 <= len(d) <= 19 and card_sum(d) % 10 == 0 and len(set(d)) > 1


def iban_rest(plain):
    """The remainder by 97 of country and check behind the rest, letters as 10 to 35, one character after the other."""
    rest = 0
    for c in plain[4:] + plain[:4]:
        v = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest


def is_iban(s):
    plain = s.replace(" ", "")
    return 15 <= len(plain) <= 34 and plain.isalnum() and plain.upper() == plain and plain[:2].isalpha() and plain[2:4].isdigit() and iban_rest(plain) == 1


def is_ssn(s):
    p = s.split("-")
    return [len(x) for x in p] == [3, 2, 4] and all(x.isdigit() for x in p) and p[0] not in ("000", "666") and p[0] < "900" and p[1] != "00" and p[2] != "0000"


def is_ip(s):
    try:
        return bool(ipaddress.IPv4Address(s))
    except ValueError:
        return False


def is_date(s):
    for mark in "-./":
        p = s.split(mark)
        if len(p) != 3 or not all(x.isascii() and x.isdigit() for x in p):
            continue
        orders = [p] if len(p[0]) == 4 else [[p[2], p[1], p[0]], *([[p[2], p[0], p[1]]] if mark == "/" else [])]
        for y, m, d in orders:
            try:
                if len(y) == 4 and max(len(m), len(d)) < 3 and 1900 <= datetime.date(int(y), int(m), int(d)).year < 2100:
                    return True
            except ValueError:
                pass
    return False


def is_mail(s):
    local, at, domain = s.rpartition("@")
    parts = domain.split(".")
    return bool(at) and local[:1].isalnum() and "@" not in local and len(parts) > 1 and all(parts) and len(parts[-1]) > 1 and parts[-1].isalpha()


def is_phone(s):
    return 8 <= len(digits_of(s)) <= 15 and all(c in "0123456789 +()./-" for c in s)


VALID = {"email": is_mail, "iban": is_iban, "card": is_card, "phone": is_phone, "ssn": is_ssn, "ip": is_ip, "date": is_date}


def number(r, n, first="123456789"):
    return r.choice(first) + "".join(r.choice("0123456789") for _ in range(n - 1))


def grouped(s, sizes, mark):
    out, at = [], 0
    for n in sizes:
        out.append(s[at : at + n])
        at += n
    return mark.join(x for x in out if x)


def made(r, kind):
    if kind == "card":
        sizes = r.choice([[4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 4, 3], [6, 13], [4, 4, 8], [5, 5, 5], [13], [15], [16], [19], [4, 5, 6], [3, 3, 3, 3, 3, 4]])
        body = number(r, sum(sizes) - 1, "3456")
        return grouped(next(body + c for c in "0123456789" if card_sum(body + c) % 10 == 0), sizes, r.choice(" -"))
    if kind == "iban":
        country = r.choice(sorted(COUNTRIES))
        rest = number(r, COUNTRIES[country] - 4) if r.random() < 0.5 else "".join(r.choice("ABCXYZ0123456789") for _ in range(COUNTRIES[country] - 4))
        plain = next(p for n in range(2, 99) if iban_rest(p := f"{country}{n:02d}{rest}") == 1)
        return plain if r.random() < 0.5 else grouped(plain, [4] * 9, " ")
    if kind == "ssn":
        return next(s for _ in range(99) if is_ssn(s := f"{r.randint(1, 899):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"))
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "date":
        d = datetime.date(1900, 1, 1) + datetime.timedelta(r.randrange(73_000))
        return d.strftime(r.choice(["%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d"]))
    if kind == "email":
        return r.choice(["bob", "o'brien", "José", "Ann.Lee", "x_1", "a-b+c"]) + number(r, 2) + "@" + r.choice(["ex.com", "Mail.example.org", "ex-a.co.uk", "exämple.de"])
    return r.choice([f"+49 30 {number(r, 7)}", f"+33 6 {grouped(number(r, 8), [2] * 4, ' ')}", f"({number(r, 3)}) {number(r, 3)}-{number(r, 4)}", f"{number(r, 3, '23456789')}-{number(r, 3)}-{number(r, 4)}", f"06 {grouped(number(r, 8), [2] * 4, ' ')}", f"+1 415 {number(r, 3)} {number(r, 4)}"])


@pytest.mark.parametrize("kind", pii_feistel.KINDS)
def test_values_among_words_are_found_exactly(kind):
    p, r = pii_feistel.Pseudonyms("key"), random.Random(kind)
    for _ in range(150):
        text, want = "", []
        for _ in range(r.randint(1, 4)):
            value = made(r, kind)
            text += r.choice(WORDS) + r.choice([" ", ": ", ", ", " <", " '"])
            # Sixteen digits in fours that are a card go before three more behind a blank, which may be their code.
            known = value[:19] if kind == "card" and len(value) == 23 and value[19] == " " and is_card(value[:19]) else value
            want.append((kind, len(text), len(text) + len(known)))
            text += value + r.choice([" ", ", ", "; ", "> "])
        assert [s[:3] for s in p.spans(text + "end")] == want, text


def cards_in(text):
    """Start and end of each row of whole groups of three digits at least, with one blank or dash between, that is a card.

    Before it stands no letter, digit, sign of a number, dot or dash; behind it no letter or digit, no dot and digit, no dash and letter.
    """
    letter = lambda c: c.isalnum() or c == "_"
    for a in range(len(text)):
        if text[a] not in "0123456789" or (a and (letter(text[a - 1]) or text[a - 1] in "+.-")):
            continue
        at, groups = a, 0
        while True:
            b = at
            while b < len(text) and text[b] in "0123456789":
                b += 1
            groups += 1
            if not 3 <= b - at <= 16 and not (groups == 1 and 13 <= b - at <= 19):
                break
            behind = text[b : b + 2] + "  "
            open_end = not letter(behind[0]) and not (behind[0] == "." and behind[1] in "0123456789") and not (behind[0] == "-" and letter(behind[1]) and behind[1] not in "0123456789")
            if open_end and is_card(text[a:b]):
                yield a, b
            if behind[0] not in " -" or behind[1] not in "0123456789" or len(digits_of(text[a:b])) > 19:
                break
            at = b + 1


def test_no_valid_value_stays_whole_in_random_mixes():
    p, r, seen = pii_feistel.Pseudonyms("key"), random.Random(3), dict.fromkeys((*pii_feistel.KINDS, "any card"), 0)
    near = ["12", "12/26", "EUR", "100", "AB12", ".", ",", "-", "IBAN", "x", "2024", "7", "4111", "123", "no."]
    for _ in range(3_000):
        text, planted = "", []
        for _ in range(r.randint(1, 6)):
            if r.random() < 0.5:
                text += r.choice(near) + " "
                continue
            kind = r.choice(pii_feistel.KINDS)
            value = made(r, kind)
            planted.append((kind, len(text), len(text) + len(value)))
            text += value + r.choice([" ", " ", ", "])
        spans = p.spans(text)
        for (_, a, b, _), (_, c, _, _) in zip(spans, spans[1:], strict=False):
            assert a < b <= c
        for kind, a, b, new in spans:
            assert VALID[kind](text[a:b]) and VALID[kind](new) and new != text[a:b], (text, kind, new)
            assert kind in ("date", "ip") or [c.isdigit() for c in new] == [c.isdigit() for c in text[a:b]]
        for kind, a, b in [*planted, *(("any card", *x) for x in cards_in(text))]:
            seen[kind] += 1
            assert any(c < b and a < d for _, c, d, _ in spans), (text, kind, text[a:b])
    assert min(seen.values()) > 300


def test_the_query_leaves_no_plain_value(spark, data):
    before = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    after, seen = {r["doc_id"]: r["text"] for r in QUERIES["op9_pii"](spark, data).collect()}, 0
    assert before.keys() == after.keys()
    for i, text in before.items():
        old, new = text.split(), after[i].split()
        assert len(old) == len(new)
        for a, b in zip(old, new, strict=True):
            bare = a.strip(".,;:!?()<>[]\"'")
            if is_mail(bare) or is_ssn(bare) or is_ip(bare) or is_date(bare) or (bare.isascii() and bare.isdigit() and is_card(bare)):
                seen += 1
                assert a != b, (i, a)
            elif a != b:
                assert digits_of(a) or "@" in a or (a.isascii() and a.upper() == a), (i, a)
        for a, b in cards_in(text):
            seen += 1
            assert text[a:b] not in after[i], (i, text[a:b])
    assert seen >= 20
