"""Quality by a sparse rule ensemble (Friedman and Popescu 2008).

Boosted small trees over statistics of a text give paths; each path is a rule, a conjunction of comparisons. A
lasso logistic regression weighs the rules and drops most. What remains is compiled into one Spark column expression, so
scoring is a projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import held_out

#: Labelled rows that a fit reads at most; trees, their depth, share of rows each sees, cuts tried per statistic.
SAMPLE, TREES, DEPTH, SHARE, CUTS, LEAST_LEAF = 20_000, 40, 3, 0.5, 32, 10
#: Shrinkage of each tree, weight of the lasso, steps of its descent, and rules kept at most.
SHRINK, LASSO, STEPS, MOST = 0.2, 3e-3, 600, 80


def statistics(text: Column) -> dict[str, Column]:
    """The statistics by name, each a native expression over a text that is not null."""
    t = text
    n_chars = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.split(t, "\n", -1)
    n_words = F.size(words)
    solid = F.length(F.translate(t, " \t\n\r\x0b\x0c", ""))

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / n_chars

    def without(chars: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, chars, ""))) / n_chars

    return {
        "words": n_words.cast("double"),
        "word_length": solid / F.greatest(n_words, F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(n_words, F.lit(1)),
        "lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.length(t) / F.size(lines),
        "upper": share(r"\p{Lu}"),
        "marks": share(r"[^\p{L}\p{N}\s]"),
        "digits": without("0123456789"),
        "bars": without("|"),
        "signs": without("*#$%&@^~_=+<>{}[]\\"),
        "bangs": without("!?"),
        "stops": without(".,;:"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, cut): the statistic lies above the cut, or not."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, cut in self.tests:
            out = out & (stats[name] > cut if above else stats[name] <= cut)
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, cut in self.tests:
            v = x[:, names.index(name)]
            out &= v > cut if above else v <= cut
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grow(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, names: list[str], path: tuple, out: list[Rule], value: np.ndarray, held: np.ndarray) -> None:
    """Split ``rows`` where the squared residual falls most; paths go to ``out``, leaf means to ``value`` of ``held`` rows."""
    best = (1e-9, -1, 0.0)
    r = residual[rows]
    if len(path) < DEPTH and len(rows) >= 2 * LEAST_LEAF:
        whole = r.sum() ** 2 / len(r)
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            at = np.searchsorted(edges, x[rows, f], side="left")  # how many cuts lie below
            n = np.cumsum(np.bincount(at, minlength=len(edges) + 1))[:-1]
            s = np.cumsum(np.bincount(at, weights=r, minlength=len(edges) + 1))[:-1]
            ok = (n >= LEAST_LEAF) & (len(r) - n >= LEAST_LEAF)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(r) - n, 1) - whole, -np.inf)
            if (k := int(gain.argmax())) >= 0 and gain[k] > best[0]:
                best = (float(gain[k]), f, float(edges[k]))
    if best[1] < 0:
        value[held] = r.mean() if len(r) else 0.0
        return
    _, f, cut = best
    for above in (False, True):
        step = (*path, (names[f], above, cut))
        out.append(Rule(step))
        own, rest = (x[rows, f] > cut) == above, (x[held, f] > cut) == above
        _grow(x, cuts, residual, rows[own], names, step, out, value, held[rest])


def extract(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 3) -> list[Rule]:
    """The distinct paths of boosted trees for the logistic loss, shorter ones first."""
    rng, rules = np.random.default_rng(seed), []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    every = np.arange(len(y))
    for _ in range(TREES):
        rows = np.sort(rng.choice(len(y), max(1, int(SHARE * len(y))), replace=False))
        residual, value = y - _sigmoid(z), np.zeros(len(y))
        _grow(x, cuts, residual, rows, names, (), rules, value, every)
        z += SHRINK * 4 * value  # a Newton step at even odds
    return sorted(dict.fromkeys(rules), key=lambda r: len(r.tests))


def lasso(m: np.ndarray, y: np.ndarray, weight: float = LASSO) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-penalised logistic regression on the rule matrix, by accelerated proximal steps."""
    n, k = m.shape
    step = 4 * n / (np.linalg.norm(m, 2) ** 2 + n)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        d = _sigmoid(m @ v + c) - y
        new = v - step * (m.T @ d) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * weight, 0)
        new_b, new_t = c - step * d.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return w, b


@dataclass
class Ensemble:
    rules: list[tuple[Rule, float]]
    bias: float

    def column(self, stats: dict[str, Column]) -> Column:
        z = F.lit(self.bias)
        for rule, w in self.rules:
            z = z + F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit_rows(x: np.ndarray, y: np.ndarray, names: list[str]) -> Ensemble:
    """The ensemble of a matrix of statistics and labels 0 or 1; with one label only, the constant share."""
    if not len(y):
        return Ensemble([], 0.0)
    if y.min() == y.max():
        return Ensemble([], 3.0 if y[0] else -3.0)
    rules = extract(x, y.astype(float), names)
    m = np.stack([r.holds(x, names) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    w, b = lasso(m, y.astype(float))
    keep = np.argsort(-np.abs(w) * m.std(0), kind="stable")[:MOST]
    keep = np.sort(keep[w[keep] != 0])
    if len(keep):
        w, b = lasso(m[:, keep], y.astype(float), LASSO / 10)  # less shrinkage on the rules that stay
    return Ensemble([(rules[k], float(v)) for k, v in zip(keep, w, strict=False) if v], b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ensemble:
    """Fit on at most SAMPLE labelled rows that are not held out, by hash of the id.

    A repeated id counts once: by the greatest of its labels and the text of the smallest hash. Null texts count as
    empty; null ids and labels are left out. Without labels every text scores 1/2.
    """
    train = labels.where(~held_out(F.col(f"`{id_col}`"))).where(F.col(label_col).isNotNull() & F.col(f"`{id_col}`").isNotNull())
    known = train.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    wanted = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE))  # at most SAMPLE ids
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(f"`{text_col}`", F.lit("")).alias("text")).join(wanted, "id")
    stats = statistics(F.col("text"))
    row = F.struct(F.xxhash64("text").alias("h"), *[c.cast("double").alias(n) for n, c in stats.items()])
    found = texts.select("id", "y", row.alias("r")).groupBy("id", "y").agg(F.min("r").alias("r")).select("id", "y", "r.*").toPandas().sort_values("id")
    return fit_rows(found[list(stats)].to_numpy(float), found["y"].to_numpy(), list(stats))


def score(docs: DataFrame, model: Ensemble, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and ``name``: the ensemble's score between 0 and 1.

    Whole texts are measured, however long; null counts as empty. Rows with null ids and repeated rows are scored like
    any other; equal texts get equal scores. A column called ``name`` is replaced. An empty table gives an empty result.
    """
    # One array, so that the optimizer computes each statistic once and not once in each rule that tests it; the caller's
    # row in one struct, so that no name of its columns can clash.
    stats = statistics(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    used = sorted({t[0] for rule, _ in model.rules for t in rule.tests})
    own = [c for c in docs.columns if c != name]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.array(*[stats[n].cast("double") for n in used]).alias("stats"))
    return held.select(*[F.col(f"row.`{c}`").alias(c) for c in own], model.column({n: F.get("stats", F.lit(i)) for i, n in enumerate(used)}).alias(name))
