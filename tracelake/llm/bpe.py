"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round all neighbours of a word are looked up by binary search
in the sorted keys of the merge table, the lowest rank of each word is taken, and all words merge at once. Words that
have no pair left leave the array. The vocabulary file is read on the driver and sent to the executors; its size is
that of the file, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable
from itertools import chain
from pathlib import Path

import numpy as np
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from tracelake.llm.common import map_texts

#: Chunks between white space whose ids a worker keeps; beyond that, only those of the current texts stay.
CACHE_CHUNKS = 200_000
#: Characters of text that are split into words before their new words are merged together.
CHUNK_CHARS = 1_000_000
NONE = np.int64(1) << 60
#: White space for Python, but not for the word pattern.
SEPARATORS = "\x1c\x1d\x1e\x1f"
SOLID = regex.compile(r"\S+")
#: White space of Unicode, as a class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What ``regex``, which has the latest tables, knows as a letter or a number.
KNOWN = regex.compile(r"[\p{L}\p{N}]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return [out[b] for b in range(256)]


class WordBpe:
    """The ids that a ``tokenizers`` JSON file of kind BPE with word ends gives to texts, and back.

    Fixed by the file's kind: NFC, white space to blanks, lower case character by character; words by the file's
    pattern; words as byte symbols, the last with the suffix.
    """

    def __init__(self, path: str):
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab, suffix = data["model"]["vocab"], data["model"]["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.special = special
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        self._follow(tokenizers.Tokenizer.from_file(path), data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.size = 1 + max([*vocab.values(), *special.values()])
        self.tokens = [""] * self.size
        for t, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = t
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        first = np.full(self.size, NONE)
        np.minimum.at(first, left, np.arange(len(pairs)))
        np.minimum.at(first, right, np.arange(len(pairs)))
        # A merge whose result takes part in a merge of lower rank is done once a round, as a queue would; any other
        # at all its places in the word at once.
        self.once = first[self.made] < self.rank
        self.same = (left == right)[order]
        self.cache: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def _follow(self, library: tokenizers.Tokenizer, pattern: str) -> None:
        """Set the word pattern and case changes as in the library's version of Unicode.

        Python and ``regex`` may know an older or a newer one, so each character that is unassigned in Python's tables
        is tried once: how a pair of it splits between letters, and what normalization makes of it.
        """
        self.lower, kinds = {}, {"L": [], "N": []}
        for i, c in enumerate(map(chr, range(0x110000))):
            kind = unicodedata.category(c)
            if kind == "Cn" and KNOWN.match(c):
                kind = {1: "L", 4: "N"}.get(len(library.pre_tokenizer.pre_tokenize_str(f"a{c}{c}a")), "")
                if (low := library.normalizer.normalize_str(c)) != c.lower():
                    self.lower[i] = low
            if kind[:1] in kinds:
                kinds[kind[0]].append(i)
        for k, found in kinds.items():
            at = np.array(found)
            starts, ends = at[np.r_[True, np.diff(at) > 1]], at[np.r_[np.diff(at) > 1, True]]
            pattern = pattern.replace(rf"\p{{{k}}}", "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)))
        self.word_re = re.compile(pattern.replace(r"\s", SPACE))

    def normalized(self, text: str) -> str:
        """NFC and lower case, character by character."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").translate(self.lower)
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """The pieces between white space; no word and no special token crosses one."""
        return SOLID.findall(text) if any(c in text for c in SEPARATORS) else text.split()

    def special_pieces(self, chunk: str) -> list[str | int]:
        """The words of a chunk and the ids of its special tokens, which match as they stand."""
        out: list[str | int] = []
        for k, part in enumerate(self.special_re.split(chunk)):
            out += [self.special[part]] if k % 2 else self.word_re.findall(self.normalized(part))
        return out

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers; the words are not empty."""
        raw = [w.encode("utf-8", "replace") for w in words]
        size = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), size)
        sym = self.inner[data]
        ends = np.cumsum(size) - 1
        sym[ends] = self.final[data[ends]]
        done_word, done_sym = [], []
        while len(sym):
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            key = np.r_[sym[:-1] * self.size + sym[1:], -1]
            key[np.r_[begins[1:] - 1, len(sym) - 1]] = -1
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.rank[at], NONE)
            counts = np.diff(np.r_[begins, len(sym)])
            low = np.repeat(np.minimum.reduceat(rank, begins), counts)
            live = low < NONE
            if not live.all():
                done_word.append(word[~live])
                done_sym.append(sym[~live])
                sym, word, at, rank, low = sym[live], word[live], at[live], rank[live], low[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            keep = first | ~self.once[at[hit]]
            run = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(word[hit]) != 0)])
            offset = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            keep &= ~self.same[at[hit]] | (offset % 2 == 0)
            hit = hit[keep]
            sym[hit] = self.made[at[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, word = sym[stay], word[stay]
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        data = sym[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(raw)))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        block: list[list[str]] = []
        chars = 0
        for t in texts:
            block.append(self.chunks(t))
            chars += len(t)
            if chars > CHUNK_CHARS:
                out += self._known(block)
                block, chars = [], 0
        return out + self._known(block)

    def _known(self, block: list[list[str]]) -> list[np.ndarray]:
        seen = set(chain.from_iterable(block))
        new = seen.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_CHUNKS:  # what this block uses is likely to come again
            self.cache = {c: self.cache[c] for c in seen.difference(new)}
        odd = {c: self.special_pieces(c) for c in new if "<" in c}
        plain = list(new.difference(odd))
        find = self.word_re.findall
        split = [find(c) for c in self.normalized("\n".join(plain)).split("\n")] if plain else []
        words = list({w for ws in chain(split, odd.values()) for w in ws if isinstance(w, str)})
        ids: dict[str | int, bytes] = {i: np.array(i, "<u4").tobytes() for i in self.special.values()}
        if words:
            ids |= zip(words, self.merge(words), strict=True)
        at = ids.__getitem__
        for c, ws in zip(chain(plain, odd), chain(split, odd.values()), strict=True):
            self.cache[c] = at(ws[0]) if len(ws) == 1 else b"".join(map(at, ws))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, chunks)), "<u4") for chunks in block]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of the ids, as the file has no decoder: joined by blanks, word ends and specials kept."""
        return " ".join(map(self.tokens.__getitem__, ids))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids`` (array of int) and ``decoded`` of every row.

    Null texts count as empty: no ids, empty decoded text. Texts are encoded whole, however long. Repeated rows each
    come out; a null id is kept; other columns are not read. ``path`` names a vocabulary file on the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(WordBpe(path))

    def run(texts: list[str]) -> list[list]:
        bpe = shared.value
        ids = [x.tolist() for x in bpe.encode(texts)]
        return [[len(x) for x in ids], ids, [bpe.decode(x) for x in ids]]

    return map_texts(docs, [id_col], text_col, [StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())], run)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: the ids and the round trip of ``encode``, as
    digests made where the ids are made, so that no ids travel."""
    shared = docs.sparkSession.sparkContext.broadcast(WordBpe(path))

    def run(texts: list[str]) -> list[list]:
        bpe = shared.value
        n, first, second = [], [], []
        for x in bpe.encode(texts):
            n.append(len(x))
            first.append(hashlib.sha256(x.tobytes()).hexdigest())
            second.append(hashlib.sha256(bpe.decode(x.tolist()).encode()).hexdigest())
        return [n, first, second]

    return map_texts(docs, [id_col], text_col, [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())], run)
