"""Span finders, scanners and scores against plain re-implementations, and the pipeline's stages on odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import line_dedup, mixing, pii_feistel, secrets_zstd, simhash, toxicity_nnpu
from tracelake.llm.queries import QUERIES


def texts(spark, data):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


# personal data


def by_hand(p, text):
    """Every place from left to right, every form there, every end that the form allows, none left out beforehand but one:
    digits that failed as a loose row of groups are not tried so again from a later start."""
    out, at, tried = [], 0, 0
    while at < len(text):
        hit = None
        for kind, form in pii_feistel.FORMS:
            loose = form.pattern == pii_feistel.FORMATS["card"]
            ends = [] if loose and at < tried else pii_feistel.ends(kind, form, text, at)
            for end in ends:
                if (new := pii_feistel.CHECKS[kind](p.feistel.encrypt, text[at:end])) is not None:
                    hit = (kind, at, end, new)
                    break
            if hit:
                break
            tried = ends[0] if loose and ends else tried
        if hit:
            out.append(hit)
        at = hit[2] if hit else at + 1
    return out


LEAKS = [
    ("card 4111 1111 1111 1111 12/26", "4111 1111 1111 1111"), ("ref 12 4111 1111 1111 1111", "4111 1111 1111 1111"), ("AB12 4111 1111 1111 1111", "4111 1111 1111 1111"),
    ("pay BE68 5390 0754 7034 100 EUR", "BE68 5390 0754 7034"), ("BE68 5390 0754 7034 IBAN", "BE68 5390 0754 7034"), ("+49 30 1234567 2024-02-29", "+49 30 1234567"), ("+49 30 1234567 2024-02-29", "2024-02-29"),
]


#: In other groups, behind other digits, with other letters, and with a dash behind: all of the value goes.
LEAKS += [(t.format(v), v) for v in ("6212 3456 7890 1234 569", "411111 1111 111111", "4111 1111 11111111", "4111-111-111-111-111") for t in ("{}", "ref 7 {}", "12 {}", "order 55 {}, paid", "1 22 {}")]
LEAKS += [("to josé.garcia@ex.com", "josé.garcia@ex.com"), ("müller@ex.com", "müller@ex.com"), ("<bob@exämple.com>", "bob@exämple.com"), ("o'brien@ex.com", "o'brien@ex.com"), ("Иван@пример.рф", "Иван@пример.рф"), ("'bob@ex.com'", "bob@ex.com"), ("SSN 123-45-6789-", "123-45-6789")]


@pytest.mark.parametrize("mail", ["josé.garcia@ex.com", "O'Brien@ex.com", "Ürgén+x@exämple.com", "Иван@пример.рф", "İx@ex.com", "straße@ex.de"])
def test_mails_come_back(mail):
    p = pii_feistel.Pseudonyms("key")
    new = p.apply(mail)[0]
    assert new != mail and p.back("email", new) == mail and [c.isalpha() for c in new] == [c.isalpha() for c in mail]


@pytest.mark.parametrize(("text", "value"), LEAKS)
def test_no_value_leaks_next_to_another(text, value):
    made, found = pii_feistel.Pseudonyms("key").apply(text)
    assert value not in made and value in {text[a:b] for _, a, b, _ in found}


def test_spans_equal_those_by_hand(spark, data):
    p, r = pii_feistel.Pseudonyms("key"), random.Random(1)
    values = ["4111 1111 1111 1111", "4111111111111111", "3782 822463 10005", "BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32", "+49 30 1234567", "(415) 555-1234", "555-123-4567", "123-45-6789", "10.20.30.40", "2024-02-29", "13/04/2001", "a.b@c.org"]
    near = ["12", "12/26", "EUR", "100", "AB12", ".", ", ", "-", "IBAN", "x", "2024", "7", "+", "("]
    for _ in range(400):
        t = "".join(r.choice([*values, *near]) + r.choice(["", " ", " ", ", "]) for _ in range(r.randint(1, 7)))
        assert p.spans(t) == by_hand(p, t), t
    mine = {i: p.spans(t) for i, t in texts(spark, data).items()}
    assert sum(map(len, mine.values())) > 20
    for i, t in texts(spark, data).items():
        if len(t) < 3_000:
            assert mine[i] == by_hand(p, t), i


def test_pii_query(spark, data):
    p = pii_feistel.Pseudonyms("demonstration key")
    for r in QUERIES["op9_pii"](spark, data).where("length(text) < 5000").collect():
        made, found = p.apply(texts_once(spark, data)[r["doc_id"]])
        assert r["text"] == made and [r[f"n_{k}"] for k in pii_feistel.KINDS] == [sum(s[0] == k for s in found) for k in pii_feistel.KINDS]


_held = {}


def texts_once(spark, data):
    if data not in _held:
        _held[data] = texts(spark, data)
    return _held[data]


def test_equal_values_in_other_forms_stay_linked():
    p = pii_feistel.Pseudonyms("key")
    digits = lambda s: re.sub(r"\D", "", s)[-10:]
    assert len({digits(p.forth("phone", x)) for x in ("+1 415 555 1234", "(415) 555-1234", "415-555-1234", "1-415-555-1234")}) == 1
    days = [p.forth("date", x) for x in ("2024-02-13", "13.02.2024", "13/02/2024", "02/13/2024")]
    assert {tuple(sorted(re.findall(r"\d+", d))) for d in days} == {tuple(sorted(re.findall(r"\d+", days[0])))}
    for mail in ("Bob.Smith@x.org", "BOB.smith@x.org"):
        assert p.back("email", p.forth("email", mail)) == mail
    assert p.forth("email", "Bob.Smith@x.org").lower() == p.forth("email", "bob.smith@x.org")


# secrets


def base_by_hand(t):
    """A loop over positions for each kind: leftmost matches, each going on behind the one before."""
    word = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    out = []

    def run(at, chars):
        end = at
        while end < len(t) and t[end] in chars:
            end += 1
        return end

    def assign(at):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t[at : at + 8])
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if not low.startswith(name):
                continue
            i = at + len(name)
            i += i < len(t) and t[i] in "\"'"
            i = run(i, " ")
            if i >= len(t) or t[i] not in ":=":
                continue
            i = run(i + 1, " ")
            i += i < len(t) and t[i] in "\"'"
            end = run(i, word + "+/_.=-")
            if end > i:
                return end, end - i >= 8
        return None

    def plain(prefix, chars, least):
        def find(at):
            if not t.startswith(prefix, at):
                return None
            end = run(at + len(prefix), chars)
            return (end, end - at >= least) if end > at + len(prefix) else None

        return find

    for kind, find in (("assign", assign), ("access", plain("AKIA", word[:26] + word[-10:], 16)), ("hex", plain("", "0123456789abcdef", 32))):
        at = 0
        while at < len(t):
            hit = find(at)
            if hit is None:
                at += 1
                continue
            if hit[1]:
                out.append((at, hit[0], kind))
            at = hit[0]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_base_spans_equal_those_by_hand(spark, data):
    r = random.Random(2)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "ApiKey", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "abc.def-123", "é", "=x", "\n", "ſ", "K"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert sorted(secrets_zstd.base_spans(t)) == sorted(base_by_hand(t)), t
    for row in QUERIES["op10_secrets"](spark, data).collect():
        base = base_by_hand(texts_once(spark, data)[row["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        kinds = Counter(k for *_, k in base)
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"]) and row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(row["spans"].split(",")) and all(s.startswith("novel:") for s in row["spans"].split(",") if s and s not in joined)


def test_planted_keys_and_names(spark):
    r = random.Random(3)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "customer billing history report monthly archive folder backup region europe cluster worker deploy rollout session handler buffer queue".split()
    rows, planted, names = [], set(), set()
    for i in range(300):
        key = "".join(r.choice(chars) for _ in range(r.choice((20, 32, 40, 64, 5_000))))
        name = "_".join(r.choice(words) for _ in range(5)) + "2"
        rows.append((i, f"the secret of {i}\nclient = connect(bearer, {key})\nretry(bearer, {key}) # key {name}\n"))
        planted |= {(i, m.start()) for m in re.finditer(key, rows[-1][1])}
        names.add((i, rows[-1][1].index(name)))
    got = secrets_zstd.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = {(x["doc_id"], int(s.split(":")[1])) for x in got for s in x["spans"].split(",") if s.startswith("novel:")}
    # Both places of a key count: a key that is repeated is no name.
    assert len(found & planted) >= 0.95 * len(planted) and len(found & names) <= 0.01 * len(names) and len(found - planted - names) == 0


# toxicity


def test_margin_equals_a_plain_sum(spark, data):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = toxicity_nnpu.fit(docs, labels)
    assert m.weights and m == toxicity_nnpu.fit(docs.repartition(7), labels)  # rows in another order

    def plain(t):
        pieces = [w.strip(toxicity_nnpu.EDGE) for w in t.lower().split()]
        seen = Counter()
        for w in pieces:
            for b in [f"w{w}"] + [f"b{w[:n]}" for n in (4, 5, 6, 7) if len(w) > n] if w else []:
                seen[b] += 1
        reach = lambda times: [times >= 1, times >= 2, times >= 3] + [times >= 2 and times >= x * len(pieces) for x in (1 / 256, 1 / 128, 1 / 64, 1 / 32)]
        return m.bias + sum(w * r for b, n in seen.items() if b in m.weights for w, r in zip(m.weights[b], reach(n), strict=True))

    for t in texts_once(spark, data).values():
        assert m.margin(t) == pytest.approx(plain(t), abs=1e-9)


# clashes, repeats and odd rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __id string, __key int, __row string, __text string, __size int, `toxic score` double, n_lines int, n_removed int, row int, id string, m map<string,int>"
EXTRA = ["i", 7, "r", "t", 3, 0.5, 7, 8, 9, "x", {"a": 1}]


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *EXTRA) for i, t, s in rows], T._parse_datatype_string(SCHEMA))


ROWS = [
    (1, "one\ntwo\nthree\nfour words in this line", "a"), (2, "x\none\ntwo\nthree\ny z and many other words", "a"), (2, "another text of the same id with words", "b"), (3, None, None), (4, "", "a"), (5, " \n ", "b"),
    (None, "a text without an id of its own", "b"), (6, "word " * 3000, "b"), (7, "copy of some words here again", "a"), (7, "copy of some words here again", "a"), (8, "copy of some words here again", "b"),
]


def same_extras(rows):
    return all((r["__id"], r["__key"], r["__row"], r["__text"], r["__size"], r["toxic score"], r["n_lines"], r["n_removed"], r["row"], r["id"], r["m"]) == tuple(EXTRA) for r in rows)


def test_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, 1, 0), (6, None, 0), (7, 1, 0), (2, 0, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, stages = odd(spark, ROWS), dict(c.STAGES)
    for name, stage in c.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [] and stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    got = stages["toxicity"](spark, docs, str(tmp_path)).collect()
    assert same_extras(got) and Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in ROWS)
    got = stages["line dedup"](spark, docs, str(tmp_path)).collect()
    assert same_extras(got) and {r["doc_id"]: r["text"] for r in got if r["lang"] and r["doc_id"] in (1, 3, 4)} == {1: ROWS[0][1], 3: None, 4: ""}
    assert {r["text"] for r in got if r["doc_id"] == 2} == {"x\ny z and many other words", ROWS[2][1]} and all(r["n_chars"] == len(r["text"] or "") for r in got)
    got = stages["near-dedup"](spark, docs, str(tmp_path)).collect()
    assert same_extras(got) and Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, _ in ROWS[:4] + ROWS[6:9])
    got = stages["mixing"](spark, docs, str(tmp_path)).collect()
    assert same_extras(got) and {r["doc_id"] for r in got} <= {1, 2, 6, 7, 8, None} and sum(len(r["text"].split()) for r in got) > 0
    assert {r["n_tokens"] for r in stages["bpe"](spark, docs, str(tmp_path)).where("doc_id in (3, 4, 5)").collect()} == {0}


def test_keep_first_with_repeated_ids(spark):
    a, b = "first text with several words", "quite another text of five words"
    rows = [(1, a, "s"), (5, a, "s"), (5, b, "s"), (6, b, "t"), (1, a, "s")]
    got = simhash.keep_first(odd(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (5, b)]


def test_lines_with_clashing_names_keep_the_counts(spark):
    got = line_dedup.dedup_lines(odd(spark, ROWS[:2])).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["__key"]) for r in got) == [(1, 4, 0, 7), (2, 5, 3, 7)]


def test_long_keys_lose_no_link():
    r = np.random.default_rng(2)
    (masks, starts), chains = simhash.long_masks(), simhash.ring()
    assert len(masks) == len(starts) == 105 and min(m.bit_count() for m in masks) >= 30
    for _ in range(3000):
        x = sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 5)), replace=False))
        assert any(not x & m and simhash.chain_ok(np.array([x], np.uint64), chains[s])[0] for m, s in zip(masks, starts, strict=True))


def test_long_keys_give_the_same_components(spark, monkeypatch):
    from test_texts import check_components, docs, near_copies

    monkeypatch.setattr(simhash, "PIECES", ((1 << 62, 0),))
    rows = near_copies(120, 4)
    check_components(rows, simhash.near_duplicates(docs(spark, rows)).collect())


def test_spans_of_quotients_give_the_same_quotas(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 7)
    r = np.random.default_rng(6)
    rows = [(g, i, float(s)) for g in (0, 1) for i, s in enumerate(r.integers(1, 40, 30) ** (g + 1))]
    items = spark.createDataFrame(rows, "g int, i bigint, s double")
    made = [sorted(map(tuple, mixing.apportion(items, ["g"], "i", "s", F.lit(333).cast("bigint"), F.lit(30), spread).select("g", "i", "quota").collect())) for spread in (False, True)]
    assert made[0] == made[1] and sum(q for *_, q in made[0]) == 666


def test_mix_agrees_where_different_texts_share_id_and_size(spark):
    texts = [f"w{i} " + " ".join(f"x{i}y{j}" for j in range(30)) for i in range(40)]
    rows = [(None if i % 2 else 3, s, t, len(t)) for i, t in enumerate(texts) for s in ("a", "b", "c", None)]
    made = []
    for order, parts in ((1, 2), (-1, 7)):
        docs = spark.createDataFrame(rows[::order], "doc_id bigint, source string, text string, n_chars int").repartition(parts)
        made.append(sorted(map(repr, mixing.mix(docs).collect())))
    assert made[0] == made[1] and len(made[0]) > 100


@pytest.mark.parametrize("kind", ["letters", "small letters", "digits", "letters and digits", "with dots", "with signs", "large hex"])
def test_keys_of_any_alphabet_are_found(kind):
    import string

    letters, r = string.ascii_letters, random.Random(kind)
    own = {"letters": letters, "small letters": letters[:26], "digits": string.digits, "letters and digits": letters + string.digits, "with dots": letters + string.digits + ".", "with signs": letters + string.digits + "$!@#%^&*", "large hex": "0123456789ABCDEF"}[kind]
    novelty, found = secrets_zstd.Novelty(repeats=False), 0
    for _ in range(100):
        key = "".join(r.choice(own) for _ in range(40))
        key = f"k{key}9" if kind.startswith("with") else key  # a dot at an end is no part of a key
        text = f"some words of a note stand here\nthe api key is {key} and more words follow, as they do\n"
        base = secrets_zstd.base_spans(text)
        at = text.index(key)
        found += any(a <= at and b >= at + len(key) for a, b, _ in base + secrets_zstd.novel_spans(text, base, novelty))
    assert found >= 95
