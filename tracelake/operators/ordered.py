"""Looking back along an order within a key, also for keys that hold a large share of all rows.

A plain window sends a key's rows to one task. With ``split_ns`` a key's history is cut into spans of time that are sorted
on their own; what a span needs from those before it is one small row a span, its last, looked up over the spans alone and
joined with the rows that their own span tells nothing. ``Rows`` cuts by number instead of time: a count finds the keys that hold too many rows, only their
histories are cut, and every span has the same number of rows however crowded a time is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.scratch import cut

ORDER = ("time_ns", "seq")


def null_safe(a: DataFrame, b: DataFrame, by: Sequence[str]) -> Column:
    """Whether the keys of ``a`` equal those of ``b``, which stand there behind two underscores; nulls are equal."""
    out = F.lit(True)
    for k in by:
        out = out & a[k].eqNullSafe(b[f"__{k}"])
    return out


#: ``monotonically_increasing_id`` counts within a partition in its lower bits.
_IN_PARTITION = (1 << 33) - 1
#: Tasks that a sort may have however few rows they hold, and the rows beyond which it gets more.
TASKS, TASK_ROWS = 200, 1_000_000


@dataclass(frozen=True)
class Rows:
    """Spans of at most ``most`` rows for the keys that hold more than that; other keys stay whole.

    The spans come from a range sort of those keys' rows by key and order, so they follow the order itself, and rows of one time are told
    apart by what else is in the order. The sort's borders are sampled: it gets twice the tasks that ``most`` rows each would need, but beyond TASKS only if a task would
    hold over TASK_ROWS: many small spans make no more tasks than the rows need. Spans are counted off in sorted rows and never hold more. Keys may be null.
    """

    most: int = 1_000_000

    def __post_init__(self) -> None:
        if self.most < 1:
            raise ValueError("a span holds one row at least")

    def tasks(self, held: int) -> int:
        """The tasks of the sort of ``held`` rows."""
        return min(-(-2 * held // self.most), max(TASKS, -(-held // TASK_ROWS)))

    def crowded(self, df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, int]:
        """The keys with more than ``most`` rows, as ``__<key>``, and how many rows they hold together."""
        counts = df.groupBy(*[F.col(k).alias(f"__{k}") for k in by]).agg(F.count("*").alias("__rows")).where(F.col("__rows") > self.most)
        keys = cut(counts)  # at most one key for each ``most`` rows
        return keys, keys.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]

    def parts(self, df: DataFrame, by: Sequence[str], order: Sequence[str]) -> tuple[DataFrame | None, DataFrame]:
        """The rows of crowded keys with ``__span``, ascending within the key, or None if there are none; and the rest."""
        keys, held = self.crowded(df.select(*by), by)
        if not held:
            return None, df
        rows = cut(df)  # read for both parts, and for the borders of the sort
        same = null_safe(rows, keys, by)
        sorted_ = rows.join(keys, same, "left_semi").repartitionByRange(self.tasks(held), *by, *order).sortWithinPartitions(*by, *order)
        numbered = sorted_.withColumn("__at", F.monotonically_increasing_id())
        span = F.col("__at") - F.col("__at").bitwiseAND(F.lit(_IN_PARTITION)) % F.lit(self.most)
        return cut(numbered.withColumn("__span", span).drop("__at")), rows.join(keys, same, "left_anti")


def look_back(
    df: DataFrame, by: Sequence[str], value: Column, name: str, order: Sequence[str] = ORDER, split_ns: int | Rows | None = None, current: bool = False, keep: Column | None = None, asks: Column | None = None,
) -> DataFrame:
    """``df`` and ``name``: the last ``value`` that is not null in an earlier row of the key (``current``: or in this one).

    Give a struct to look at the row just before: a struct is not null even if its fields are. ``keep`` and ``asks`` as in ``look_backs``.
    """
    return look_backs(df, by, {name: value}, order, split_ns, current, keep, asks)


def look_backs(
    df: DataFrame, by: Sequence[str], values: Mapping[str, Column | str], order: Sequence[str] = ORDER, split_ns: int | Rows | None = None, current: bool = False, keep: Column | None = None, asks: Column | None = None,
) -> DataFrame:
    """``look_back`` for several values (or columns) at once, by name.

    ``keep``, over the columns of ``df`` and the new ones, leaves out rows of the result; they are still looked back at. As values may come late, it must be false or null
    for a row that is out whatever it finds, and may not be false because of a value that is null. Rows that are not in ``asks`` do not read their values: these may stay null.
    """
    end = 0 if current else -1
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    if split_ns is None:
        whole = df.withColumns({n: F.last(v, ignorenulls=True).over(w) for n, v in values.items()})
        return whole if keep is None else whole.where(keep)
    valued = df.withColumns({f"__value_{n}": F.col(v) if isinstance(v, str) else v for n, v in values.items()})
    if isinstance(split_ns, Rows):
        crowded, rest = split_ns.parts(valued, by, order)
        plain = rest.withColumns({n: F.last(f"__value_{n}", ignorenulls=True).over(w) for n in values}).drop(*[f"__value_{n}" for n in values])
        plain = plain if keep is None else plain.where(keep)
        return plain if crowded is None else _over_spans(crowded, by, list(values), order, end, keep, asks).unionByName(plain)
    return _over_spans(valued.withColumn("__span", F.floor(F.col(order[0]) / split_ns)), by, list(values), order, end, keep, asks)


def _over_spans(parts: DataFrame, by: Sequence[str], names: Sequence[str], order: Sequence[str], end: int, keep: Column | None, asks: Column | None) -> DataFrame:
    """``look_backs`` over rows with ``__value_<name>`` and ``__span``: within the span, else what the spans before it carry.

    Rows are read once and written once, after the window and without those that ``keep`` rules out. Only rows that ask and find nothing in their span are joined.
    """
    inner = Window.partitionBy(*by, "__span").orderBy(*order)
    told, found = F.lit(False), F.lit(True)
    for n in names:
        told, found = told | F.col(f"__last_{n}").isNotNull(), found & F.col(n).isNotNull()
    columns = [c for c in parts.columns if c not in ("__span", *[f"__value_{n}" for n in names])] + list(names)
    near = parts.withColumns({n: F.last(f"__value_{n}", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, end)) for n in names} | {"__ends": F.lead(F.lit(1)).over(inner).isNull()})
    near = near.withColumn("__asks", ~found if asks is None else F.coalesce(asks, F.lit(False)) & ~found)
    near = near.withColumns({f"__last_{n}": F.when(F.col("__ends"), F.coalesce(f"__value_{n}", n)) for n in names} | {"__kept": F.lit(True) if keep is None else F.coalesce(keep, F.col("__asks"))})
    if asks is not None:  # spans that neither tell nor ask need no end
        near = near.withColumn("__asked", F.max("__asks").over(inner.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__ends", F.col("__ends") & (told | F.col("__asked")))
    table = cut(near.where("__kept or __ends").select(*columns, "__span", "__asks", "__kept", "__ends", *[f"__last_{n}" for n in names]))

    outer = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.last(f"__last_{n}", ignorenulls=True).over(outer).alias(f"__carried_{n}") for n in names]
    carried = table.where("__ends").select(*[F.col(k).alias(f"__{k}") for k in by], F.col("__span").alias("__its_span"), *lasts)
    open_ = table.where("__kept and __asks")
    late = open_.join(carried, null_safe(open_, carried, by) & open_["__span"].eqNullSafe(carried["__its_span"]), "left").withColumns({n: F.coalesce(n, f"__carried_{n}") for n in names})
    late = late if keep is None else late.where(keep)
    return table.where("__kept and not __asks").select(*columns).unionByName(late.select(*columns))


def places(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, split: int | Rows | None = None) -> DataFrame:
    """``df`` and ``name``: each row's place in its key, from 0. With ``split``, spans of the first column of the order (or of so many rows) are
    numbered on their own, and the rows before a span are counted over the spans alone."""
    place = (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint")
    if split is None:
        return df.withColumn(name, place)
    if isinstance(split, Rows):
        crowded, rest = split.parts(df, by, order)
        plain = rest.withColumn(name, place)
        return plain if crowded is None else _places_over_spans(crowded, by, order, name).unionByName(plain)
    return _places_over_spans(df.withColumn("__span", F.floor(F.col(order[0]) / split)), by, order, name)


def _places_over_spans(parts: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    near = parts.withColumn("__near", F.row_number().over(Window.partitionBy(*by, "__span").orderBy(*order)) - 1)
    counts = parts.groupBy(*by, "__span").agg(F.count("*").alias("__n"))
    outer = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("__span").alias("__its_span"), F.coalesce(F.sum("__n").over(outer), F.lit(0)).alias("__before"))
    found = near.join(before, null_safe(near, before, by) & F.col("__span").eqNullSafe(F.col("__its_span")))
    return found.withColumn(name, (F.col("__near") + F.col("__before")).cast("bigint")).drop("__span", "__near", "__its_span", "__before", *[f"__{k}" for k in by])
