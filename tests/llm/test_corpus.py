"""Language by cross-parsing, the Merkle manifest and the alignment of tokenizers against plain re-implementations, and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tracelake.llm import cross_parse, merkle_manifest, token_align
from tracelake.llm.bpe import byte_symbols
from tracelake.llm.queries import QUERIES, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# language


def phrases(text, reference):
    """The parse by hand: the longest beginning that occurs in the reference, cut at the end of a block; a symbol that does not occur is a phrase."""
    n, at = 0, 0
    while at < len(text):
        end, stop = at + 1, (at // cross_parse.BLOCK + 1) * cross_parse.BLOCK
        while end < min(stop, len(text)) and text[at : end + 1] in reference:
            end += 1
        n, at = n + 1, end
    return n


def by_hand(text):
    return "".join(map(chr, cross_parse.plain(text)))


@pytest.mark.parametrize("seed", range(6))
def test_phrases_equal_those_by_hand(seed):
    r = random.Random(seed)
    alphabet = "abcdé. ß中"[: r.randint(2, 9)]
    text = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    made, other = [text(r.randint(1, 300)) for _ in range(5)], [text(40)]
    references = [cross_parse.Reference.of("x", made), cross_parse.Reference.of("y", other)]
    model = cross_parse.Model(tuple(references))
    texts = [text(n) + "zq"[: r.randint(0, 2)] for n in (1, 5, 50, 1_023, 1_024, 1_025, 5_000)]
    want = [[phrases(by_hand(t), "".join(map(by_hand, own))) * np.log2(ref.size) / len(by_hand(t)) for own, ref in zip((made, other), references, strict=True)] for t in texts]
    assert np.allclose(model.costs(texts), want)


def test_languages_are_told_apart(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op11_cross_parse"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(held) > 200 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.99
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_language_on_odd_rows(spark):
    learn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:8]
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "s", 1) for i in learn]
    odd = [(1000, None, "en", None, None), (1001, "", None, None, None), (1002, "12 !?\n", "zz", None, None), (1003, "hund " * 30_000, None, None, None), (None, "the dog", "en", None, None), (learn[0], rows[0][1], rows[0][2], "s", 1)]
    docs = spark.createDataFrame(rows + odd, DOCS).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    out = cross_parse.predict(docs, cross_parse.fit(docs)).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert len(out) == len(rows) + len(odd)
    assert [got[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and got[1003][0] == "de" and got[None][0] == "en"
    empty = spark.createDataFrame([], DOCS)
    assert cross_parse.predict(empty, cross_parse.fit(empty)).collect() == []
    assert {r["lang_pred"] for r in cross_parse.predict(docs, cross_parse.fit(empty)).collect()} == {"und"}


# manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_by_hand(rows, fan):
    """``rows``: (id, group, leaf, changed leaf) → by place: (id, leaf, subroot, root, proof, folded root)."""

    def tree(leaves):
        """The top, and for each leaf its steps (before, after)."""
        steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
        while len(nodes) > 1:
            for i, k in enumerate(at):
                low = k - k % fan
                steps[i].append(("".join(nodes[low:k]), "".join(nodes[k + 1 : low + fan])))
                at[i] = k // fan
            nodes = [sha(*nodes[k : k + fan]) for k in range(0, len(nodes), fan)]
        return nodes[0], steps

    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([r[2] for r in groups[g]]) for g in names}
    root, crown = tree([made[g][0] for g in names])
    out = []
    for g, up in zip(names, crown, strict=True):
        for r, own in zip(groups[g], made[g][1], strict=True):
            acc = r[3]
            for before, after in own + up:
                acc = sha(before, acc, after)
            out.append((r[0], r[2], made[g][0], root, sha(*[x for s in own + up for x in s]), acc))
    return out


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_manifest_equals_that_by_hand(spark, fan):
    r = random.Random(fan)
    rows = [(i, r.choice((None, "", "Ab", "é\n1:")), r.choice(("en", None)), r.choice(("hot", "hot", "hot", f"s{r.randint(0, 30)}", None, "", "Z", "é")), r.choice((None, 3))) for i in range(400)]
    rows += [rows[0], rows[0], (None, "t", None, "hot", 1), (-5, "t", None, "hot", 1), (7, "one", None, "lone", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit("clash")).withColumn("g", F.lit(1))
    docs = docs.repartition(5)
    leaf = lambda d, t: sha(*map(field, (d[0], d[3], d[2], d[4], t)))
    lower = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lower("text")).otherwise(F.col("text"))
    changed = merkle_manifest.leaf(*[lower if c == "text" else F.col(c) for c in merkle_manifest.FIELDS])
    want = manifest_by_hand([(d[0], d[3], leaf(d, d[1]), leaf(d, d[1].lower() if d[1] and d[0] is not None and d[0] % 3 == 0 else d[1])) for d in rows], fan)
    found = merkle_manifest.manifest(docs, fan=fan, changed=changed)
    path = F.col("path")
    got = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.proof(path), 256), merkle_manifest.fold(F.col("changed"), path)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert any(x[5] != x[3] for x in want) and any(x[5] == x[3] for x in want)


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, "T", "en", None, 1)], DOCS)
    r = merkle_manifest.query(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == sha() and r["verified"] == (zlib.crc32(b"1") % 5 != 0)
    assert merkle_manifest.query(one.limit(0)).collect() == []


def test_nodes_of_a_tree(spark):
    rows = merkle_manifest.place(spark.range(20).select(F.lit("").alias("g"), F.col("id"), merkle_manifest.digest(F.col("id").cast("string")).alias("h")), "id")
    tree = merkle_manifest.grow(rows, 3)
    count = Counter(r["level"] for r in tree.nodes().collect())
    assert count == {0: 20, 1: 7, 2: 3, 3: 1}


# tokenizers


ODD = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "中", "▁", "\x1c", "\x85", "　", "<s>", "<|endoftext|>", "'s", "'LL", "1", "23", "!", "...", "\xa0", "\x00", "😀", "the", "ing", " x", "word", "Mixed"]


def tools():
    a = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def align_by_hand(rows):
    a_tool, b_tool = tools()
    value = {c: b for b, c in enumerate(byte_symbols())}
    done, count, best = [], Counter(), Counter()
    for i, t in rows:
        a, b = (a_tool.encode(" " + t, add_special_tokens=False).ids, b_tool.encode(t)) if t else ([], [])
        a_bytes = [bytes(value[c] for c in a_tool.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_tool.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [b_tool.id_to_piece(x)]]
        if not t or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            done.append((i, [], [], [], []))
            continue
        ends = [{int(e): k for k, e in enumerate(np.cumsum([len(x) for x in side]))} for side in (a_bytes, b_bytes)]
        groups, links, p, q = [], [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            x, y = ends[0][e] + 1, ends[1][e] + 1
            groups.append(f"{','.join(map(str, a[p:x]))}|{','.join(map(str, b[q:y]))}")
            links.append((a[x - 1], b[y - 1]))
            p, q = x, y
        count.update(links)
        done.append((i, a, b, groups, links))
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted((str(i), len(a), len(b), len(g), len(k), sum(count[x] == best[x[1]] for x in k), sum(count[x] for x in k), sha(";".join(g)) if a else "") for i, a, b, g, k in done)


def rows_of(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in token_align.OUT), r["groups_sha256"]) for r in df.collect())


@pytest.mark.parametrize("limit", [token_align.LIMIT, 40])
def test_alignment_equals_that_by_hand(spark, limit):
    r = random.Random(4)
    rows = [(i, "".join(r.choice(ODD) for _ in range(r.randint(0, 14)))) for i in range(600)]
    rows += [(None, "the end "), (1_000, None), (1_001, ""), (1_002, " "), (1_003, "a  b"), (1_004, "word " * 20_000), (5, rows[5][1]), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("x")).repartition(3)
    assert rows_of(token_align.links(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), limit=limit)) == align_by_hand(rows)
    assert token_align.links(docs.limit(0), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), limit=limit).collect() == []


def test_alignment_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert rows_of(QUERIES["op13_token_align"](spark, data)) == align_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_aligner_forgets_and_still_counts():
    pair, r = token_align.Pair(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")), random.Random(6)
    texts = [" ".join(r.choice(("the", "of", f"w{r.randint(0, 3_000)}")) for _ in range(20)) for _ in range(300)]
    got = []
    for room in (10**6, 300):
        aligner, total = token_align.Aligner(pair, room=room), Counter()

        def gather(aligner=aligner, total=total):
            for k, n in zip(*(x.tolist() for x in aligner.counts()), strict=True):
                total[k] += n

        for low in range(0, len(texts), 10):
            for own in aligner.read(texts[low : low + 10], gather):
                np.add.at(aligner.times, own, 1)
        gather()
        got.append(total)
        assert room == 10**6 or len(aligner.at) < 1_000
    assert got[0] == got[1] and sum(got[0].values()) > 5_000


def test_hash_is_perfect_and_minimal(spark):
    keys = np.random.default_rng(1).choice(10**9, 5_000, replace=False)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    for bucket in (token_align.BUCKET, 700):
        token_align.BUCKET, old = bucket, token_align.BUCKET
        try:
            found = token_align.hashed(df, len(keys))
        finally:
            token_align.BUCKET = old
        assert sorted(found.number(keys).tolist()) == list(range(len(keys)))
        assert 64 * len(found.words) < 6 * len(keys)
    other = np.setdiff1d(np.arange(2_000), keys)
    held = token_align.Counts("", found, np.zeros(found.size, np.int64) - 1, np.ones(found.size, np.int64), np.zeros(1))
    held.keys[found.number(keys)] = keys
    assert (held.get(other) == -1).all() and (held.get(keys) == 1).all()
