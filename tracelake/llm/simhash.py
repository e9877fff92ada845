"""SimHash near-duplicates by pigeonring filtering.

The 64 bits are five segments on a ring. If two fingerprints differ in at most four bits, some segment starts a chain
whose first segment is equal, whose first two segments differ in at most one bit, the first three in at most two, the
first four in at most three, and all five in at most four (the budgets are l * 4 / 5, rounded down). The first two
conditions make the join key: the whole first segment and the second one without a piece. The others prune
candidates before the full Hamming check. The filter is exact: no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from tracelake.llm.common import components, cut, map_texts

BITS, DISTANCE = 64, 4
WIDTHS = (13, 13, 13, 13, 12)
#: Distinct fingerprints beyond which the second segment is cut into more pieces: longer keys, more keys a row. Beyond the
#: last, the second and third segment together are cut into PAIR_PIECES, of which a key leaves out two.
PIECES, PAIR_PIECES = ((1 << 22, 2), (1 << 26, 4), (1 << 28, 13), (1 << 62, 0)), 7
#: Buckets up to this many fingerprints are joined by SQL; larger ones are compared block against block.
SMALL, BLOCK = 32, 2048
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, width: int = 4) -> bytes:
    """Eight bytes, most significant first, of the SimHash of the text's word shingles (repeats counted)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= width:
        hashes = xxhash.xxh64_digest(joined, 42)
    else:
        starts = [0, *(ends[: len(words) - width] + 1).tolist()]
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    n = len(hashes) // 8
    at = np.frombuffer(hashes, np.uint8).reshape(n, 8) + (np.arange(8) * 256)
    seen = np.bincount(at.ravel(), minlength=2048).reshape(8, 256)
    return np.packbits((seen @ BYTE_BITS).ravel() * 2 > n).tobytes()


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", width: int = 4) -> DataFrame:
    """The columns ``keep``, ``fingerprint`` (16 hex digits) and ``fp`` (the same bits as a signed long) of every row."""

    def run(texts: list[str]) -> list[list]:
        made = [fingerprint(t, width) for t in texts]
        return [[x.hex() for x in made], [int.from_bytes(x, "big", signed=True) for x in made]]

    return map_texts(docs, keep, text_col, [StructField("fingerprint", StringType()), StructField("fp", LongType())], run)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def ring() -> list[list[int]]:
    """For each start, the masks of the chain's first one, two, ... five segments."""
    at = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
    seg = [((1 << w) - 1) << a for w, a in zip(WIDTHS, at, strict=True)]
    return [[sum(seg[(i + k) % len(seg)] for k in range(n)) for n in range(1, len(seg) + 1)] for i in range(len(seg))]


def key_masks(pieces: int) -> list[int]:
    """The mask of each kind of key: a segment and, of the next one, all but one of ``pieces`` pieces."""
    masks = []
    for i, chain in enumerate(ring()):
        j = (i + 1) % len(WIDTHS)
        low, w = sum(WIDTHS[:j]), WIDTHS[j]
        cuts = [low + w * p // min(pieces, w) for p in range(min(pieces, w) + 1)]
        masks += [chain[1] & ~(((1 << b) - (1 << a))) for a, b in zip(cuts, cuts[1:], strict=False)]
    return masks


def key_starts(pieces: int) -> list[int]:
    """The chain that each of ``key_masks`` belongs to."""
    return [i for i in range(len(WIDTHS)) for _ in range(min(pieces, WIDTHS[(i + 1) % len(WIDTHS)]))]


def long_masks(pieces: int = PAIR_PIECES) -> tuple[list[int], list[int]]:
    """Masks of longer keys, and the chain of each: a segment and, of the next two, all but two of ``pieces`` pieces.

    The first three segments of a chain differ in at most two bits, and the first in none, so two pieces hold them.
    """
    masks, starts = [], []
    for i, chain in enumerate(ring()):
        bits = [b for b in range(BITS) if (chain[2] & ~chain[0]) >> b & 1]
        for p, q in combinations(range(pieces), 2):
            out = [b for k, b in enumerate(bits) if k * pieces // len(bits) not in (p, q)]
            masks.append(chain[0] | sum(1 << b for b in out))
            starts.append(i)
    return masks, starts


def _budget(n: int) -> int:
    return n * DISTANCE // len(WIDTHS)


def chain_ok(x: np.ndarray, masks: list[int]) -> np.ndarray:
    """Where the XORs ``x`` keep each budget along the chain; the last mask is the full Hamming check."""
    ok = np.ones(len(x), bool)
    for n, m in enumerate(masks, 1):
        ok &= np.bitwise_count(x & np.uint64(m)) <= _budget(n)
    return ok


def forest(a: np.ndarray, b: np.ndarray, masks: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``a`` and ``b`` (unsigned; the same array for links within one)."""
    nodes = np.unique(np.concatenate([a, b]))
    root, out = np.arange(len(nodes)), []
    right = np.searchsorted(nodes, b)
    for x, i in zip(a, np.searchsorted(nodes, a), strict=True):
        hit = right[chain_ok(b ^ x, masks)]
        for r in np.unique(root[hit]):
            if r != root[i]:
                out.append((int(x), int(nodes[hit[root[hit] == r][0]])))
                root[root == r] = root[i]
    return out


def links(prints: DataFrame, pieces: int) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints (column ``fp``) whose graph has the components of all links.

    Within a bucket of up to SMALL fingerprints all links are made by an equi-join; in larger ones every block of
    about BLOCK fingerprints meets every other in a task of its own, which returns a spanning forest of their links.
    """
    chains = ring()
    masks, start = (key_masks(pieces), key_starts(pieces)) if pieces else long_masks()
    of = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)])
    keys = prints.select("fp", F.explode(of).alias("key")).select("fp", "key.t", "key.k")
    sizes = keys.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    full = cut(keys.join(sizes, ["t", "k"]))
    few = full.where(F.col("n") <= SMALL)

    def mask(n: int) -> Column:
        return F.element_at(F.array(*[F.lit(_signed(chains[i][n - 1])) for i in start]), F.col("t") + 1)

    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = few.select("t", "k", F.col("fp").alias("a")).join(few.select("t", "k", F.col("fp").alias("b")), ["t", "k"]).where("a < b")
    for n in range(2, len(WIDTHS)):
        pairs = pairs.where(F.bit_count(x.bitwiseAND(mask(n))) <= _budget(n))
    pairs = pairs.where(F.bit_count(x) <= DISTANCE).select("a", "b")

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = full.where(F.col("n") > SMALL).withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    many = many.select("t", "k", "fp", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    many = many.select("t", "k", "fp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(group):
        t, lo, hi = group["t"].iloc[0], group["lo"].iloc[0], group["hi"].iloc[0]
        fp, own = group["fp"].to_numpy().view(np.uint64), group["own"].to_numpy()
        found = forest(fp[own == lo], fp[own == hi], chains[start[t]])
        return type(group)(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return pairs.union(many.groupBy("t", "k", "lo", "hi").applyInPandas(compare, "a long, b long"))


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """The rows (``__id``, ``fingerprint``, ``fp``, ``h``, a hash of the text) and, by ``fp``, ``component`` and ``component_id``."""
    marked = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.xxhash64(f"`{text_col}`").alias("h"))
    rows = cut(fingerprints(marked, ["__id", "h"], "__text", width))
    prints = cut(rows.groupBy("fp").agg(F.min("__id").alias("first")))
    n = prints.count()
    pieces = next(p for most, p in PIECES if n <= most)
    joined = components(links(prints, pieces), "a", "b").select(F.col("node").alias("fp"), "component")
    named = prints.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows, named.join(lowest, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``id_col``, ``fingerprint`` and ``component_id`` of every row.

    Fingerprints link at DISTANCE or fewer differing bits; ``component_id`` is the smallest id reachable over links,
    the row's own included. Null and empty texts, and those of white space, have fingerprint zero, which links like
    any other; texts of fewer than ``width`` words are one shingle. Repeated rows each come out. Rows with a null id
    take part and get the smallest id reachable, or null if there is none. Other columns of ``docs`` are not read.
    An empty table gives an empty result.
    """
    rows, named = _classes(docs, id_col, text_col, width)
    return rows.join(named, "fp").select(F.col("__id").alias(id_col), "fingerprint", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays, in all its columns.

    It is that of the smallest id, then of the smallest fingerprint, then of the smallest hash of the text; of rows that
    share id and text the one of the smallest hash over all columns. So of different texts that share an id each is
    judged on its own. Rows with a null id cannot be named as a copy and all stay. Null, empty and white texts are
    copies of each other. An empty table gives an empty result.
    """
    rows, named = _classes(docs, id_col, text_col, width)
    known = rows.where("__id is not null").join(named, "fp")
    stay = known.groupBy("component").agg(F.min(F.struct("__id", "fingerprint", "h")).alias("m")).select(F.col("m.__id").alias("__id"), F.col("m.h").alias("h"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`").alias("__id"), F.xxhash64(f"`{text_col}`").alias("h"))
    packed = packed.withColumn("__all", F.xxhash64(*[F.col(f"__row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]))
    kept = packed.where("__id is not null").join(stay, ["__id", "h"], "left_semi").groupBy("__id", "h").agg(F.min_by("__row", "__all").alias("__row"))
    every = kept.select("__row").union(packed.where("__id is null").select("__row"))
    return every.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
