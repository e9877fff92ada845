"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives, any text is unlabelled. The risk of a classifier g under the class prior p is
p * E+[l(g)] + max(0, Eu[l(-g)] - p * E+[l(-g)]); where the second part falls below zero, its gradient is turned round
(Kiryo et al. 2017). The classifier is linear over marks of single words and word beginnings: that a text holds
one at least once, twice, three times, or at some rate. Marks are chosen by how much more often positives have them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from tracelake.llm.common import cut, held_out, map_texts

#: The bounded sample that a fit reads: rows of each kind, chosen by a hash of the id alone, their texts whole.
POSITIVES, UNLABELLED = 1_500, 6_000
#: Beginnings, times and rates that make a mark; marks kept, least number and share of positives with one, least z score.
BEGINNINGS, TIMES, RATES = (4, 5, 6, 7), (1, 2, 3), (1 / 256, 1 / 128, 1 / 64, 1 / 32)
MARKS, SUPPORT, SUPPORT_SHARE, LEAST_Z = 300, 3, 0.015, 4.0
EPOCHS, STEP, RIDGE = 150, 0.02, 1e-3
CACHE = 120_000
EDGE = ".,;:!?\"'`()[]{}<>|*#$%&@^~_+=/\\-"


def words(text: str) -> Counter:
    """Times of each piece between white space, in lower case; punctuation at its edges is taken off later."""
    return Counter(text.lower().split())


def bases(piece: str) -> list[str]:
    """A word and its beginnings, each marked by its kind."""
    w = piece.strip(EDGE)
    return [f"w{w}", *(f"b{w[:n]}" for n in BEGINNINGS if len(w) > n)] if w else []


def levels(times: int, n_words: int) -> list[int]:
    """Which of the times and rates a base reaches."""
    out = [i for i, least in enumerate(TIMES) if times >= least]
    return out + [len(TIMES) + i for i, rate in enumerate(RATES) if times >= 2 and times >= rate * n_words]


@dataclass
class Model:
    """``weights``: by base, that of each level; ``bias``."""

    weights: dict[str, list[float]]
    bias: float
    cache: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def margin(self, text: str) -> float:
        pieces = words(text)
        n, total, found = sum(pieces.values()), self.bias, Counter()
        for piece, times in pieces.items():
            hit = self.cache.get(piece)
            if hit is None:
                if len(self.cache) > CACHE:
                    self.cache.clear()
                hit = self.cache[piece] = tuple(b for b in bases(piece) if b in self.weights)
            for b in hit:
                found[b] += times
        for b, times in found.items():
            own = self.weights[b]
            total += sum(own[i] for i in levels(times, n))
        return total

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(text), -30, 30))))


def _counts(text: str) -> tuple[Counter, int]:
    pieces, out = words(text), Counter()
    for piece, times in pieces.items():
        for b in bases(piece):
            out[b] += times
    return out, sum(pieces.values())


def nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam steps over all rows."""

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    w = np.zeros(xp.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for e in range(1, epochs + 1):
        zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        dp_neg, du = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        if negative >= 0:
            dp = dp_neg - prior * (1 - sigmoid(zp)) / len(zp)
        else:
            dp, du = -dp_neg, -du
        grad = np.r_[dp @ xp + du @ xu + RIDGE * w[:-1], dp.sum() + du.sum()]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= STEP * (first / (1 - 0.9**e)) / (np.sqrt(second / (1 - 0.999**e)) + 1e-8)
    return w[:-1], float(w[-1])


def _per_text(table: DataFrame, out: str, make: Callable[[str, Counter, int], Iterable]) -> DataFrame:
    """``y``, ``id`` and ``out``, one row for each value that ``make`` gives for a text's own bases and number of words."""
    names = ["y", "id", out.split(" ")[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (w.slice(i, 64) for w in batches for i in range(0, w.num_rows, 64)):
            made = [list(make(t, *_counts(t))) for t in b.column(2).to_pylist()]
            at = np.repeat(np.arange(len(made)), [len(m) for m in made])
            values = [v for m in made for v in m]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(values, pa.string())], names)

    return table.select("y", "id", "text").mapInArrow(run, f"y int, id {table.schema['id'].dataType.simpleString()}, {out}")


def _mark_counts(table: DataFrame) -> DataFrame:
    """``mark``, ``p`` and ``u``: in how many positive and unlabelled texts each mark is, summed up over a few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (w.slice(i, 64) for w in batches for i in range(0, w.num_rows, 64)):
            seen = (Counter(), Counter())
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts, n = _counts(text)
                seen[y].update(f"{i}{base}" for base, times in counts.items() for i in levels(times, n))
            marks = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(marks, pa.string()), *(pa.array([seen[y][m] for m in marks], pa.int64()) for y in (1, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["mark", "p", "u"])

    return table.select("y", "text").mapInArrow(run, "mark string, p bigint, u bigint")


def _sample(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of a fit as a table: ``id``, ``y`` (1: positive, 0: unlabelled), ``text``."""
    order = [F.xxhash64("id"), F.col("id")]
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and length(text) > 0").where(~held_out(F.col("id")))
    positive = own.select("id").join(known.where("y = 1"), "id", "left_semi").distinct().orderBy(*order).limit(POSITIVES)
    any_kind = own.select("id").orderBy(*order).limit(UNLABELLED).distinct()
    wanted = positive.select("id", F.lit(1).alias("y")).union(any_kind.select("id", F.lit(0).alias("y")))
    found = own.join(F.broadcast(wanted), "id")  # at most POSITIVES + UNLABELLED ids
    return cut(found.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the rows that are not held out: at most POSITIVES labelled 1 and UNLABELLED of any kind, by hash of the id.

    Texts are read whole, by the executors, which also rank the marks: the driver gets MARKS marks at most, and of each row of the sample those that
    it has, at most (POSITIVES + UNLABELLED) * MARKS names, whatever the length of texts. The
    class prior is the share of 1 among the labels that are not held out. A repeated id counts once, by the greatest of
    its labels and the text of the smallest hash; null ids, null labels and empty texts are left out. Without positives,
    rows or marks every text gets the prior.
    """
    train = labels.where(~held_out(F.col(f"`{id_col}`"))).where(F.col(label_col).isNotNull() & F.col(f"`{id_col}`").isNotNull())
    known = train.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    prior = min(max(known.select(F.avg("y")).first()[0] or 0.0, 1e-3), 0.999)
    flat = Model({}, float(np.log(prior / (1 - prior))))
    sample = _sample(docs, known, id_col, text_col)
    sizes = dict(sample.groupBy("y").count().collect())
    n_pos, n_any = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_any:
        return flat
    support = max(SUPPORT, SUPPORT_SHARE * n_pos)
    p, u = F.col("p"), F.col("u")
    pool = (p + u) / (n_pos + n_any)
    z = (p / n_pos - u / n_any) / F.sqrt(pool * (1 - pool) * (1 / n_pos + 1 / n_any) + 1e-12)
    counted = _mark_counts(sample).groupBy("mark").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(p >= support).withColumn("z", z)
    names = [r["mark"] for r in counted.where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "mark").limit(MARKS).collect()]
    if not names:
        return flat
    at = {m: i for i, m in enumerate(names)}
    bases_ = {m[1:] for m in names}
    own_marks = _per_text(sample, "mark string", lambda t, c, n: (m for b in bases_ & c.keys() for i in levels(c[b], n) if (m := f"{i}{b}") in at))
    held = own_marks.toPandas()  # at most MARKS for each row of the sample
    x = {1: np.zeros((n_pos, len(names)), np.float32), 0: np.zeros((n_any, len(names)), np.float32)}
    for y, own in held.groupby("y"):
        x[y][np.unique(own["id"].to_numpy(), return_inverse=True)[1], own["mark"].map(at).to_numpy()] = 1
    w, bias = nnpu(x[1], x[0], prior)
    weights: dict[str, list[float]] = {}
    for name, value in zip(names, w, strict=True):
        weights.setdefault(name[1:], [0.0] * (len(TIMES) + len(RATES)))[int(name[0])] = float(value)
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` (all) of every row and ``name``: the model's score between 0 and 1.

    Whole texts are scored, however long; null counts as empty and gets the score of a text without marks. Rows with
    a null id and repeated rows are scored like any other; equal texts get equal scores. A column called ``name``
    is replaced. An empty table gives an empty result.
    """
    own = [c for c in (keep if keep is not None else docs.columns) if c != name]
    return map_texts(docs, own, text_col, [StructField(name, DoubleType())], lambda texts: [[model.score(t) for t in texts]])
