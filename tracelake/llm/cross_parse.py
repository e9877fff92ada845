"""Language by cross-parsing entropy.

A suffix automaton of labelled text of each language tells how long the text at hand goes on as some passage of it does. A text is
parsed into such longest matches, one phrase after the other; phrases times the logarithm of the labelled text's length, for each
character, estimate the cross entropy (Ziv and Merhav), and the language with the least wins. Automata are made from a bounded sample
on the driver; texts are parsed by the executors, the blocks of many texts side by side.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField
from pyspark.sql.window import WindowSpec

from tracelake.llm.common import held_out, map_texts
from tracelake.scratch import cut

#: Characters of labelled text of each language that an automaton is made of, rows that are looked at for them, and the longest text among these.
CHARS, ROWS, LONGEST = 60_000, 400, 10_000
#: Parts of a language's rows that are ranked on their own.
PARTS = 64
#: A phrase ends at every so many characters of a text, for all languages alike, so that long texts are parsed side by side too.
BLOCK = 1_024
#: Blocks that are parsed at once.
LANES = 8_192
#: Slots of a table that are searched at once for a state's transitions.
WINDOW = 1_024
UNDETERMINED = "und"

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """1 for every code point that is a letter or a mark on one, else 0."""
    if "letter" not in _tables:
        kinds = [unicodedata.category(chr(i)) for i in range(sys.maxunicode + 1)]
        _tables["letter"] = np.array([k[0] == "L" for k in kinds])
        _tables["word"] = np.array([k[0] in "LM" for k in kinds])
    return _tables["letter"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def has_letter(text: str) -> bool:
    return bool(_letters()[code_points(text)].any())


def plain(text: str) -> np.ndarray:
    """Code points in lower case; every run of others than letters and marks is one blank, also at both ends."""
    _letters()
    points = code_points(text)
    word = _tables["word"][points]
    out = np.where(word, points, 32)
    keep = word | np.r_[True, word[:-1]] if len(points) else word
    out = out[keep]
    first = [] if len(out) and out[0] == 32 else [32]
    last = [] if not len(out) or out[-1] == 32 else [32]
    return np.r_[first, out, last].astype(np.uint32)


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in go[p]:
            go[p][s] = cur
            p = link[p]
        if p >= 0:
            q = go[p][s]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(s) == q:
                    go[p][s] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go


@dataclass(frozen=True)
class Reference:
    """One language's automaton as flat tables: the transition of a state by a symbol lies at the state's base plus the symbol, if the
    state stands there as owner. ``start`` has those of the start by symbol; symbol 0 is any that the labelled text lacks."""

    lang: str
    size: int
    symbols: np.ndarray
    start: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray

    @classmethod
    def of(cls, lang: str, texts: list[str]) -> Reference:
        points = np.concatenate([plain(t) for t in texts])
        symbols, seq = np.unique(points, return_inverse=True)
        go = automaton((seq + 1).tolist())
        room = len(symbols) + 1
        start = np.zeros(room, np.int32)
        for s, q in go[0].items():
            start[s] = q
        # States of several transitions lie where all of these find a free slot; those of one, most of them, fill the slots between.
        slots = 2 * sum(map(len, go)) + 4 * WINDOW + 2 * room
        owner, to, base, low = np.full(slots, -1, np.int32), np.zeros(slots, np.int32), np.zeros(len(go), np.int32), room
        for q in sorted((q for q in range(1, len(go)) if len(go[q]) > 1), key=lambda q: -len(go[q])):
            own = np.fromiter(go[q], np.int64)
            while True:
                if low + WINDOW + room > len(owner):
                    owner, to = np.r_[owner, np.full(len(owner), -1, np.int32)], np.r_[to, np.zeros(len(to), np.int32)]
                free = np.flatnonzero(owner[low : low + WINDOW] < 0) + low - own[0]
                fits = np.flatnonzero((owner[free[:, None] + own] < 0).all(axis=1))
                if len(fits):
                    break
                low += WINDOW // 2
            b = free[fits[0]]
            base[q], owner[b + own], to[b + own] = b, q, np.fromiter(go[q].values(), np.int32)
        ones = np.array([q for q in range(1, len(go)) if len(go[q]) == 1], np.int64)
        if len(ones):
            s, q = (np.array(x) for x in zip(*[next(iter(go[i].items())) for i in ones], strict=True))
            gaps = np.flatnonzero(owner[room:] < 0) + room  # from room on, so that no base is negative
            if len(gaps) < len(ones):
                more = len(ones) - len(gaps)
                gaps = np.r_[gaps, len(owner) + np.arange(more)]
                owner, to = np.r_[owner, np.full(more, -1, np.int32)], np.r_[to, np.zeros(more, np.int32)]
            at = gaps[: len(ones)]
            base[ones], owner[at], to[at] = at - s, ones, q
        used = np.flatnonzero(owner >= 0)
        end = (int(used[-1]) if len(used) else 0) + 1 + room
        pad = max(0, end - len(owner))
        return cls(lang, len(points), symbols, start, base, np.r_[owner, np.full(pad, -1, np.int32)][:end], np.r_[to, np.zeros(pad, np.int32)][:end])

    def coded(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.symbols, points), len(self.symbols) - 1)
        return np.where(self.symbols[at] == points, at + 1, 0).astype(np.int32)

    def phrases(self, grid: np.ndarray, active: np.ndarray) -> np.ndarray:
        """For each column of ``grid`` (symbols, downwards) the phrases it is parsed into; row t has ``active[t]`` columns, the longest first."""
        state, count = np.zeros(grid.shape[1], np.int32), np.zeros(grid.shape[1], np.int64)
        for row, k in zip(grid, active.tolist(), strict=True):
            s, here = row[:k], state[:k]
            at = self.base[here] + s
            new = self.owner[at] != here
            new |= here == 0
            count[:k] += new
            state[:k] = np.where(new, self.start[s], self.to[at])
        return count


@dataclass(frozen=True)
class Model:
    references: tuple[Reference, ...]

    def costs(self, texts: list[str]) -> np.ndarray:
        """Bits for each character of the texts (rows) by language (columns)."""
        parts = [plain(t) for t in texts]
        sizes = np.array([len(p) for p in parts])
        flat, ends = np.concatenate(parts), np.cumsum(sizes)
        begins = np.concatenate([np.arange(e - n, e, BLOCK) for e, n in zip(ends, sizes, strict=True)])
        owner = np.repeat(np.arange(len(texts)), -(-sizes // BLOCK))
        length = np.minimum(BLOCK, ends[owner] - begins)
        order = np.argsort(-length, kind="stable")
        points, place = np.unique(flat, return_inverse=True)
        out = np.zeros((len(texts), len(self.references)))
        for low in range(0, len(order), LANES):
            lanes = order[low : low + LANES]
            n = length[lanes]
            active = np.searchsorted(-n, -np.arange(n[0]), side="left")
            grid = np.zeros((n[0], len(lanes)), np.int32)
            for j, (b, m) in enumerate(zip(begins[lanes].tolist(), n.tolist(), strict=True)):
                grid[:m, j] = place[b : b + m]
            for i, r in enumerate(self.references):
                found = r.phrases(r.coded(points)[grid], active)
                np.add.at(out[:, i], owner[lanes], found * np.log2(max(r.size, 2)))
        return out / sizes[:, None]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text: the share of the other best language in the bits of both, 1 if there is but one language, 0 for ``und``."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if self.references and has_letter(t)]
        if not known:
            return out
        for i, bits in zip(known, self.costs([texts[i] for i in known]), strict=True):
            best = int(np.argmin(bits))  # languages are in order, so ties go to the smaller name
            rest = np.delete(bits, best)
            out[i] = (self.references[best].lang, float(rest.min() / (rest.min() + bits[best])) if len(rest) else 1.0)
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """An automaton for each language that documents that are not held out are labelled with.

    For each language ROWS documents of at most LONGEST characters are drawn by hash of the id, equal texts once, and taken whole until CHARS
    characters are reached; this is what comes to the driver, for each language. Null ids, null labels and texts without letters give
    nothing; without labelled text all documents are ``und``. A repeated id counts once, with the smallest label and text.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    own = own.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")) & F.length("text").between(1, LONGEST) & F.col("text").rlike(r"\p{L}"))
    # Ranks of ids only, first in each of PARTS parts of a language: at most ROWS of a part are left, whatever the rows.
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PARTS)).alias("part")
    some = own.select("id", "lang", part).withColumn("k", F.row_number().over(_by_hash("lang", "part"))).where(F.col("k") <= ROWS)
    drawn = some.withColumn("k", F.row_number().over(_by_hash("lang"))).where(F.col("k") <= ROWS).select("id", "lang").distinct()
    texts = cut(own.join(F.broadcast(drawn), ["id", "lang"]).groupBy("id").agg(F.min(F.struct("lang", "text")).alias("s")).select("id", "s.*"))
    taken: dict[str, list[str]] = {}
    sizes: Counter[str] = Counter()
    for r in texts.orderBy("lang", F.xxhash64("id"), "id").collect():  # at most ROWS texts of LONGEST characters for each language
        if sizes[r["lang"]] < CHARS and r["text"] not in (held := taken.setdefault(r["lang"], [])):
            held.append(r["text"])
            sizes[r["lang"]] += len(r["text"])
    return Model(tuple(Reference.of(lang, taken[lang]) for lang in sorted(taken)))


def _by_hash(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id")


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred`` and ``score`` (0 to 1) of every row.

    Whole texts are parsed, however long. A text that is null or has no letter is ``und`` with score 0. Ties go to the smaller language. Rows
    with a null id and repeated rows come out like any other; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 40 bytes for each of CHARS characters and language

    def run(texts: list[str]) -> list[list]:
        found = shared.value.predict(texts)
        return [[x[0] for x in found], [x[1] for x in found]]

    own = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text")) if id_col != "__text" else docs
    made = map_texts(own, [id_col], "__text", [StructField("lang_pred", StringType()), StructField("score", DoubleType())], run)
    return made.select(id_col, held_out(F.col(f"`{id_col}`")).cast(BooleanType()).alias("held_out"), "lang_pred", "score")
