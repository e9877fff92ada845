"""Alignment of two tokenizers over a corpus, with counts of linked id pairs by minimal perfect hashing.

First pass: texts are encoded by both tokenizers and cut where tokens of both end; each task counts the linked pairs it meets. The distinct
pairs get a minimal perfect hash: buckets of keys, each hashed to the slots of a few levels by one task, a key's number being the rank
of its slot. Counts are summed in dense vectors indexed by that number, task by task and then in a tree. Second pass: documents are
aligned again and their links looked up; the key that stands at a number is compared, so a pair that is not there is noticed.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField

from tracelake.llm.bpe import SPACE, byte_symbols
from tracelake.llm.common import BATCH_ROWS, map_texts
from tracelake.scratch import cut

#: Chunks whose alignment a worker keeps; beyond that, half of them, the most used, and those of the current texts stay.
CACHE_CHUNKS = 500_000
#: New chunks that are encoded as one text.
JOINED = 4_000
#: Distinct pairs that a task counts before it gives them out.
FLUSH_PAIRS = 1_000_000
#: Pairs whose counts are sent to all executors (16 bytes each): all of them, or else the most frequent; the others are then joined.
LIMIT = 4_000_000
#: Keys of a bucket of the hash, on average, and slots of a level for each key that is left.
BUCKET, ROOM = 200_000, 2.0
#: Entries of the pieces in which dense vectors travel.
PIECE = 4_096
#: White space before a blank or a line feed: there a chunk must not end, as both belong to one run for the first tokenizer.
RUN = regex.compile(f"[{SPACE}][ \\n]")
START = regex.compile(f"(?<![{SPACE}])(?=[ \\n])")


def chunks(text: str) -> list[str]:
    """``text`` with a blank before it, cut before every blank or line feed that follows no white space; the first blank of a chunk is
    left out where no blank or line feed follows it (``whole`` puts it back).

    No token of either kind crosses such a place: words of the first end there, and no piece of the second has a blank sign behind
    another character, or a line feed. So a chunk's tokens, groups and links are the same in all texts.
    """
    if text[:1] not in (" ", "\n") and not RUN.search(text):
        return text.replace("\n", " \n").split(" ")
    return [c[1:] if c[0] == " " and c[1:2] not in ("", " ", "\n") else c for c in START.split(" " + text) if c]


def whole(chunk: str) -> str:
    return chunk if chunk[:1] in (" ", "\n") else " " + chunk


class Pair:
    """Both tokenizers: ids of chunks and the bytes of ids."""

    def __init__(self, byte_path: str, piece_path: str):
        self.paths = byte_path, piece_path
        data = json.loads(Path(byte_path).read_text(encoding="utf-8"))
        value = {c: b for b, c in enumerate(byte_symbols())}
        vocab = data["model"]["vocab"] | {x["content"]: x["id"] for x in data["added_tokens"]}
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(value[c] for c in t) if all(c in value for c in t) else t.encode()
        self._load()
        n = self.pieces.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.pieces.id_to_piece, range(n)))]
        if not all(self.a_bytes) or not all(self.b_bytes) or any("▁" in p.lstrip("▁") or "\n" in p for p in map(self.pieces.id_to_piece, range(n))):
            raise ValueError("tokens without bytes, and pieces with a blank inside or a line feed, are not aligned by chunks")
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))

    def _load(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.words = tokenizers.Tokenizer.from_file(self.paths[0]) if isinstance(self.paths[0], str) else tokenizers.Tokenizer.from_str(self.paths[0].decode())
        self.words.encode_special_tokens = True
        self.words.no_truncation()
        self.words.no_padding()
        self.pieces = sentencepiece.SentencePieceProcessor(**({"model_file": self.paths[1]} if isinstance(self.paths[1], str) else {"model_proto": self.paths[1]}))

        self.blank = self.pieces.piece_to_id("▁")

    def __getstate__(self):
        """The files themselves travel: executors do not see the driver's folders."""
        held = tuple(Path(p).read_bytes() if isinstance(p, str) else p for p in self.paths)
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "pieces", "_kept")} | {"paths": held}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._load()

    def kept(self, name: str, make: Callable[[], Aligner]) -> Aligner:
        """The aligner of that name, which a worker keeps from task to task; one at a time."""
        if self.__dict__.get("_kept", ("", None))[0] != name:
            self._kept = name, make()
        return self._kept[1]

    @property
    def wide(self) -> int:
        return len(self.b_bytes)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``text``, a chunk or chunks in a row, as they are within a text."""
        a = self.words.encode(text, add_special_tokens=False).ids
        if text[:1] == " ":  # the library adds the blank, but not to an empty text
            b = self.pieces.encode(text[1:]) or [self.blank]
        else:
            b = self.pieces.encode(text)[1:]
        return np.array(a, np.int64), np.array(b, np.int64)


@dataclass(frozen=True)
class Groups:
    """How the tokens of some chunks fall into groups. ``a``, ``b``: ids; ``i``, ``j``: the place of each group's last token of either side; ``ends``:
    groups up to the end of each chunk. Tokens have a byte at least, so at a place ends one of each side at most: a group has one link."""

    a: np.ndarray
    b: np.ndarray
    i: np.ndarray
    j: np.ndarray
    ends: np.ndarray

    def rows(self) -> np.ndarray:
        """Tokens of A, tokens of B and links of each chunk."""
        last = self.ends - 1
        return np.diff(np.c_[self.i[last] + 1, self.j[last] + 1, self.ends], axis=0, prepend=0)

    def keys(self, wide: int) -> np.ndarray:
        return self.a[self.i] * wide + self.b[self.j]

    def texts(self, names: tuple[np.ndarray, ...]) -> list[str]:
        """The groups of each chunk as text, a semicolon behind each."""
        first, last, second, final = names
        made = np.empty(len(self.a) + len(self.b), object)
        of_a, of_b = np.searchsorted(self.i, np.arange(len(self.a))), np.searchsorted(self.j, np.arange(len(self.b)))
        at_a, at_b = np.arange(len(self.a)) + np.r_[0, self.j[:-1] + 1][of_a], np.arange(len(self.b)) + (self.i + 1)[of_b]
        made[at_a], made[at_b] = first[self.a], second[self.b]
        made[at_a[self.i]], made[at_b[self.j]] = last[self.a[self.i]], final[self.b[self.j]]
        parts, ends = made.tolist(), (self.i + self.j + 2)[self.ends - 1].tolist()
        return ["".join(parts[x:y]) for x, y in zip([0, *ends], ends, strict=False)]


def align(pair: Pair, made: list[str]) -> Groups | None:
    """The groups of chunks that can stand in a row; None if the bytes of either side differ from theirs."""
    text = "".join(made)
    raw = text.encode("utf-8", "replace")
    a, b = pair.ids(text)
    if b"".join(map(pair.a_bytes.__getitem__, a.tolist())) != raw or b"".join(map(pair.b_bytes.__getitem__, b.tolist())) != raw:
        return None
    sizes = list(map(len, made)) if len(raw) == len(text) else [len(c.encode("utf-8", "replace")) for c in made]
    places, i, j = np.intersect1d(np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b]), assume_unique=True, return_indices=True)
    return Groups(a, b, i, j, np.searchsorted(places, np.cumsum(sizes)) + 1)


class Aligner:
    """Aligns texts chunk by chunk and keeps what it knows of chunks, by number: ``columns`` (tokens of A, of B and links, all -1 if the bytes differ, and
    what ``extra`` gives for the links), the groups as text if ``extra`` is given, and else the links' keys and how often they were counted."""

    def __init__(self, pair: Pair, extra=None, room: int = CACHE_CHUNKS):
        self.pair, self.extra, self.room = pair, extra, room
        self.at: dict[str, int] = {}
        self.columns = np.zeros((0, 3 if extra is None else 6), np.int64)
        self.keys, self.groups = np.zeros(0, np.int64), []
        self.used, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if extra is not None:
            count = [np.arange(len(x)).astype(str).astype(object) for x in (pair.a_bytes, pair.b_bytes)]
            self.names = count[0] + ",", count[0] + "|", count[1] + ",", count[1] + ";"

    def links(self) -> np.ndarray:
        return np.maximum(self.columns[:, 2], 0)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys counted since the last call and their counts; a key may come several times."""
        n = np.repeat(self.times, self.links())
        self.times[:] = 0
        return self.keys[n > 0], n[n > 0]

    def _shrink(self, seen: set[str]) -> None:
        hot = self.used >= max(1, int(np.sort(self.used)[-(self.room // 2) :][0])) if len(self.used) > self.room // 2 else np.ones(len(self.used), bool)
        if hot.sum() > 3 * self.room // 4:  # many are used equally often
            hot[:] = False
        hot[[self.at[c] for c in seen if c in self.at]] = True
        new = np.cumsum(hot) - 1
        self.at = {c: int(new[k]) for c, k in self.at.items() if hot[k]}
        self.keys = self.keys[np.repeat(hot, self.links())] if self.extra is None else self.keys
        self.groups = [g for g, h in zip(self.groups, hot.tolist(), strict=True) if h] if self.extra is not None else self.groups
        self.columns, self.used, self.times = self.columns[hot], self.used[hot] // 2, self.times[hot]

    def _learn(self, made: list[str], found: Groups | None) -> None:
        if found is None:
            rows, texts, keys = np.full((len(made), self.columns.shape[1]), -1, np.int64), [""] * len(made), np.zeros(0, np.int64)
        else:
            rows, keys = found.rows(), found.keys(self.pair.wide)
            texts = found.texts(self.names) if self.extra is not None else []
            if self.extra is not None:
                total = [np.r_[0, np.cumsum(v)] for v in self.extra(keys)]
                rows = np.c_[rows, *[t[found.ends] - t[np.r_[0, found.ends[:-1]]] for t in total]]
        self.at.update(zip(made, range(len(self.columns), len(self.columns) + len(made)), strict=True))
        self.columns = np.r_[self.columns, rows]
        self.used, self.times = (np.r_[x, np.zeros(len(made), np.int64)] for x in (self.used, self.times))
        if self.extra is None:
            self.keys = np.r_[self.keys, keys]
        else:
            self.groups += texts

    def read(self, texts: list[str], before_shrink=None) -> list[np.ndarray]:
        """For each text the numbers of its chunks, valid until the next call; empty if the text is, or its bytes differ."""
        split = [chunks(t) if t else [] for t in texts]
        seen = set().union(*split)
        new = list(seen.difference(self.at))
        if len(self.at) + len(new) > self.room and self.at:
            if before_shrink is not None:
                before_shrink()
            self._shrink(seen)
        alone = [c for c in new if not c or "▁" in c or c[-1].isspace()]  # their bytes may differ, or they end a text
        rest = list(set(new).difference(alone))
        for low in range(0, len(rest), JOINED):
            some = rest[low : low + JOINED]
            found = align(self.pair, list(map(whole, some)))
            if found is None:
                alone += some
            else:
                self._learn(some, found)
        for c in alone:
            self._learn([c], align(self.pair, [whole(c)]))
        get = self.at.__getitem__
        out = [np.fromiter(map(get, s), np.int64, len(s)) for s in split]
        for own in out:
            np.add.at(self.used, own, 1)
        return [own if len(own) and int(self.columns[own, 0].min()) >= 0 else own[:0] for own in out]


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of integer keys (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def levels(keys: np.ndarray) -> list[np.ndarray]:
    """Minimal perfect hash of distinct keys: in each level those that have a slot of their own stay, the others go on to the next. A level is its slots as
    64-bit words."""
    out: list[np.ndarray] = []
    while len(keys):
        size = 64 * max(1, int(np.ceil(ROOM * len(keys) / 64)))
        at = (mix(keys, len(out)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        out.append(np.packbits(alone, bitorder="little").view("<u8"))
        keys = keys[~alone[at]]
    return out


class PerfectHash:
    """The buckets' levels side by side. ``number`` gives distinct keys distinct numbers from 0 to their count less one, and other keys any number or -1."""

    def __init__(self, buckets: list[list[np.ndarray]]):
        self.words = np.concatenate([w for b in buckets for w in b] or [np.zeros(0, "<u8")]).astype(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones  # buckets and levels are in order, so a rank over all words is a number over all keys
        self.size = int(ones.sum())
        self.n = len(buckets)
        sizes = np.array([[len(b[k]) if k < len(b) else 0 for b in buckets] for k in range(max(map(len, buckets), default=0))], np.int64).reshape(-1, self.n)
        flat = np.array([len(w) for b in buckets for w in b], np.int64)
        starts = iter((np.cumsum(flat) - flat).tolist())
        self.sizes, self.starts = sizes, np.zeros_like(sizes)
        for j, b in enumerate(buckets):
            for k in range(len(b)):
                self.starts[k, j] = next(starts)

    def number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if not self.n:
            return out
        bucket, left = bucket_of(keys, self.n), np.arange(len(keys))
        for k in range(len(self.sizes)):
            size = self.sizes[k][bucket[left]]
            left = left[size > 0]
            if not len(left):
                break
            size = size[size > 0]
            at = (mix(keys[left], k) % (64 * size).astype(np.uint64)).astype(np.int64)
            word, bit = self.starts[k][bucket[left]] + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys, 10_000) % np.uint64(n)).astype(np.int64)


def hashed(keys: DataFrame, n: int) -> PerfectHash:
    """The hash of the distinct ``key`` of ``keys``, ``n`` of them: a bucket of about BUCKET keys is one task's work; under 4 bits a key come to the driver."""
    many = max(1, -(-n // BUCKET))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bucket_of(b.column(0).to_numpy(), many))], ["key", "bucket"])

    def build(t: pa.Table) -> pa.Table:
        made = levels(t["key"].to_numpy())
        return pa.table({"bucket": t["bucket"][:1], "sizes": pa.array([[len(w) for w in made]], pa.list_(pa.int64())), "words": pa.array([b"".join(w.tobytes() for w in made)], pa.binary())})

    dealt = keys.select("key").mapInArrow(deal, "key long, bucket long")
    rows = {r["bucket"]: r for r in dealt.groupBy("bucket").applyInArrow(build, "bucket long, sizes array<long>, words binary").collect()}
    buckets = []
    for j in range(many):
        r = rows.get(j)
        cuts = np.cumsum(r["sizes"])[:-1] if r else []
        buckets.append(list(np.split(np.frombuffer(r["words"], "<u8"), cuts)) if r else [])
    return PerfectHash(buckets)


def count_links(docs: DataFrame, pair, text_col: str) -> DataFrame:
    """``key`` and ``n``: the links that each task meets, counted by task (and by FLUSH_PAIRS keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = pair.value.kept("first", lambda: Aligner(pair.value))
        aligner.times[:] = 0
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def gather() -> None:
            keys, n = (np.concatenate(x) for x in zip(*held, aligner.counts(), strict=True))
            key, at = np.unique(keys, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, n)
            held[:] = [(key, total)]

        for b in (w.slice(i, BATCH_ROWS) for w in batches for i in range(0, w.num_rows, BATCH_ROWS)):
            for own in aligner.read([t or "" for t in b.column(0).to_pylist()], gather):
                np.add.at(aligner.times, own, 1)
            if len(held[0][0]) > FLUSH_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["key", "n"])
                held[:] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        gather()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["key", "n"])

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "key long, n long")


def dense(counted: DataFrame, shared, tree: int = 16) -> DataFrame:
    """``piece`` and ``n`` (PIECE 64-bit counts): the counts by number, in pieces of the dense vector. Tasks add up what they read, ``tree`` of them
    what these gave, and one task for a piece what those gave."""
    kind = "piece long, part int, n binary"

    def given(total: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
        full = np.r_[total, np.zeros(-len(total) % PIECE, np.int64)].reshape(-1, PIECE)
        some = np.flatnonzero(full.any(axis=1))
        for low in range(0, len(some), 256):
            at = some[low : low + 256]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array([full[k].tobytes() for k in at], pa.binary())], ["piece", "part", "n"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found, total = shared.value, np.zeros(shared.value.size, np.int64)
        for b in batches:
            at = found.number(b.column(0).to_numpy())
            np.add.at(total, at, b.column(1).to_numpy())
        yield from given(total, TaskContext.get().partitionId() % tree)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of the piece; one sum is held."""
        piece, part, total = None, 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "part", "n"])

        for b in batches:
            for p, q, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if p != piece:
                    if piece is not None:
                        yield row()
                    piece, part, total = p, q, np.zeros(PIECE, np.int64)
                total += np.frombuffer(n, np.int64)
        if piece is not None:
            yield row()

    some = counted.mapInArrow(first, kind)
    for keys in (["piece", "part"], ["piece"]):
        some = some.repartition(*keys).sortWithinPartitions(*reversed(keys)).mapInArrow(add, kind)
    return some.select("piece", "n")


@dataclass(frozen=True)
class Counts:
    """Counts of the pairs that all executors hold, by number, with the keys that stand there; and the highest count of each id of B."""

    name: str
    found: PerfectHash
    keys: np.ndarray
    n: np.ndarray
    best: np.ndarray

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The counts of the keys; -1 for those that are not held."""
        at = self.found.number(keys)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        return np.where((at >= 0) & (self.keys[at] == keys), self.n[at], -1)


def placed(counted: DataFrame, shared) -> np.ndarray:
    """The keys by number."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.number(b.column(0).to_numpy()))], ["key", "at"])

    rows = counted.select("key").mapInArrow(number, "key long, at long").toArrow()  # at most LIMIT
    out = np.full(shared.value.size, -1, np.int64)
    out[rows["at"].to_numpy()] = rows["key"].to_numpy()
    return out


def linked(groups: str, wide: int) -> np.ndarray:
    """The keys of groups that are written as text: the last id of either side."""
    sides = [g.split("|") for g in groups.split(";")]
    return np.array([int(a.rpartition(",")[2]) * wide + int(b.rpartition(",")[2]) for a, b in sides], np.int64)


OUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def links(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose count is the highest of their id of B, ties included), ``count_sum`` (the
    counts of all links) and ``groups_sha256`` of every row.

    Texts are encoded whole, however long, special tokens as plain text. A text that is null, empty or not given back byte by byte by
    both tokenizers has zeros and an empty digest, and counts nothing. Repeated rows count and come out each; a null id is kept; other columns
    are not read. An empty table gives an empty result. The files are read on the driver and sent along (6 MB).

    Up to ``limit`` distinct pairs all executors get hash, keys and counts. Beyond it they get those of the most frequent pairs, and the links
    of others are joined with the table of counts; no such pair has more than 1/``limit`` of all links, so none is a hot key.
    """
    spark = docs.sparkSession
    pair = spark.sparkContext.broadcast(Pair(byte_path, piece_path))
    wide = pair.value.wide
    local = cut(count_links(docs, pair, text_col))
    pairs = cut(local.select("key").distinct())
    many = pairs.count()
    if many <= limit:
        shared = spark.sparkContext.broadcast(hashed(pairs, many))
        keys, n = placed(pairs, shared), np.zeros(-(-many // PIECE) * PIECE, np.int64)
        for r in dense(local, shared).toArrow().to_pylist():
            n[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["n"], np.int64)
        n = n[:many]
        best = np.zeros(wide, np.int64)
        np.maximum.at(best, keys % wide, n)
        return _second(docs, pair, spark.sparkContext.broadcast(Counts(uuid.uuid4().hex, shared.value, keys, n, best)), id_col, text_col)
    total = cut(local.groupBy("key").agg(F.sum("n").alias("n")))
    best = np.zeros(wide, np.int64)
    for r in total.groupBy((F.col("key") % wide).alias("b")).agg(F.max("n")).collect():  # a row for each id of B at most
        best[r[0]] = r[1]
    head = cut(total.orderBy(F.desc("n"), "key").limit(limit))
    shared = spark.sparkContext.broadcast(hashed(head, limit))
    rows = head.toArrow()
    at = shared.value.number(rows["key"].to_numpy())
    keys, n = np.zeros(limit, np.int64), np.zeros(limit, np.int64)
    keys[at], n[at] = rows["key"].to_numpy(), rows["n"].to_numpy()
    return _second(docs, pair, spark.sparkContext.broadcast(Counts(uuid.uuid4().hex, shared.value, keys, n, best)), id_col, text_col, total)


def _second(docs: DataFrame, pair, counts, id_col: str, text_col: str, total: DataFrame | None = None) -> DataFrame:
    wide, held = pair.value.wide, total is None

    def look(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each link: whether its count is the highest, its count, whether it is not held."""
        c = counts.value
        n = c.get(keys)
        return (n >= 0) & (n == c.best[keys % wide]), np.maximum(n, 0), n < 0

    def run(texts: list[str]) -> list[list]:
        aligner = pair.value.kept(counts.value.name, lambda: Aligner(pair.value, look))
        sums, digests, rest = np.zeros((len(texts), 6), np.int64), [], []
        for i, own in enumerate(aligner.read(texts)):
            if not len(own):
                digests.append("")
                rest.append([])
                continue
            sums[i] = aligner.columns[own].sum(axis=0)
            groups = "".join(map(aligner.groups.__getitem__, own.tolist()))[:-1]
            digests.append(hashlib.sha256(groups.encode()).hexdigest())
            if not held:
                keys = linked(groups, wide)
                rest.append(keys[counts.value.get(keys) < 0].tolist())
        if held and sums[:, 5].any():  # chunks of texts that count nothing may have pairs that are not held
            raise RuntimeError("a pair of the second pass was not met in the first")
        a, b, n, best, total_n, _ = sums.T.tolist()
        made = [a, b, n, n, best, total_n, digests]
        return made if held else [*made, rest]

    fields = [*(StructField(c, LongType()) for c in OUT), StructField("groups_sha256", StringType())]
    own = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text"))
    if held:
        return map_texts(own, [id_col], "__text", fields, run)
    made = cut(map_texts(own, [id_col], "__text", [*fields, StructField("rest", ArrayType(LongType()))], run).withColumn("row", F.monotonically_increasing_id()))
    top = F.broadcast(docs.sparkSession.createDataFrame([(i, int(v)) for i, v in enumerate(counts.value.best)], "b long, top long"))  # a row for each id of B
    tail = made.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count("*").alias("m")).join(total, "key").withColumn("b", F.col("key") % wide).join(top, "b")
    more = tail.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("m")).otherwise(0)).alias("more_best"), F.sum(F.col("m") * F.col("n")).alias("more_sum"))
    new = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return made.drop("rest").join(more, "row", "left").withColumns(new).select(id_col, *OUT, "groups_sha256")
