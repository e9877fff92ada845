"""Latency and size profiles of groups of calls: counts, sums, extremes, means, and quantiles by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.ordered import Rows, places
from tracelake.operators.patterns import micros

QUANTILES = (0.95, 0.99)


def _place(n: Column, p: float) -> Column:
    """The 0-based place of a quantile in the sorted values: the whole part of n * p, the last one at most."""
    return F.least(F.floor(n * F.lit(p)), n - 1)


def _running(counted: DataFrame, keys: list[str], split: int | None) -> DataFrame:
    """``counted`` (keys, v, n) with ``end``, the rows up to each value, and ``all``; spans of values of ``split`` are summed
    up on their own, and what lies before a span is summed over the spans alone."""
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("all"))
    if split is None:
        upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        return counted.withColumn("end", F.sum("n").over(upto)).join(totals, keys)
    parts = counted.withColumn("span", F.floor(F.col("v") / split))
    near = parts.withColumn("near", F.sum("n").over(Window.partitionBy(*keys, "span").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    outer = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy(*keys, "span").agg(F.sum("n").alias("own")).select(*keys, "span", F.coalesce(F.sum("own").over(outer), F.lit(0)).alias("before"))
    return near.join(before, [*keys, "span"]).withColumn("end", F.col("near") + F.col("before")).join(totals, keys)


def io_profile(rows: DataFrame, by: Sequence[str], latency: str = "latency_ns", size: str = "bytes", split: int | None = None) -> DataFrame:
    """One row a group: count, totals, least, greatest, means, medians and the quantiles 0.95 and 0.99 of both columns.

    The mean latency is cut to a whole number. The median is the upper one. Quantiles are values that occur, at the places
    n div 2 and floor(n * p) of the sorted group. They come from counting equal values: each value's number of
    rows is summed before the shuffle, and only the distinct values are sorted; ``split`` spreads the values of a group
    over spans of that width. Nulls are left out of their column; groups and keys that are null have no row.
    """
    keys = list(by)
    both = F.array(F.struct(F.lit(0).alias("what"), F.col(latency).cast("bigint").alias("v")), F.struct(F.lit(1).alias("what"), F.col(size).cast("bigint").alias("v")))
    values = rows.select(*keys, F.explode(both).alias("x")).select(*keys, "x.what", "x.v").where("v is not null")
    counted = values.groupBy(*keys, "what", "v").agg(F.count("*").alias("n"))
    ranked = _running(counted, [*keys, "what"], split)

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("end") > place, F.col("v")))

    total = F.sum(F.col("v").cast("decimal(38,0)") * F.col("n"))
    cells = ranked.groupBy(*keys, "what").agg(
        F.max("all").alias("count"), total.alias("total"), F.min("v").alias("min"), F.max("v").alias("max"), at(F.floor(F.col("all") / 2)).alias("median"),
        *[at(_place(F.col("all"), p)).alias(f"p{round(100 * p)}") for p in QUANTILES],
    )

    def pick(what: int, c: str) -> Column:
        return F.max(F.when(F.col("what") == what, F.col(c)))

    names = ("count", "total", "min", "max", "median", "p95", "p99")
    wide = cells.groupBy(*keys).agg(*[pick(w, c).alias(f"{p}_{c}") for w, p in ((0, "latency"), (1, "bytes")) for c in names])
    return wide.select(
        *keys, F.greatest("latency_count", "bytes_count").alias("count"), F.col("bytes_total").cast("bigint").alias("total_bytes"), F.col("latency_total").cast("bigint").alias("total_latency"),
        "latency_min", "latency_max", F.expr("CAST(latency_total div latency_count AS BIGINT)").alias("latency_mean"), "latency_median", "latency_p95", "latency_p99",
        "bytes_min", "bytes_max", (F.col("bytes_total").cast("double") / F.col("bytes_count")).alias("bytes_mean"), "bytes_median", "bytes_p95", "bytes_p99",
    )


def stats_map(profile: DataFrame, by: Sequence[str]) -> DataFrame:
    """The profile with its two columns' figures in a struct each."""
    names = ("min", "max", "mean", "median", "p95", "p99")
    nested = [F.struct(*[F.col(f"{c}_{n}").alias(n) for n in names]).alias(c) for c in ("latency", "bytes")]
    return profile.select(*by, "count", "total_bytes", "total_latency", *nested)


def approx_profile(rows: DataFrame, by: Sequence[str], latency: str = "latency_ns", size: str = "bytes", accuracy: int = 10_000) -> DataFrame:
    """Quantiles from a sketch, in one pass and bounded memory."""
    cells = [F.percentile_approx(c, [0.5, *QUANTILES], accuracy).alias(f"{n}_quantiles") for n, c in (("latency", latency), ("bytes", size))]
    return rows.groupBy(*by).agg(F.count("*").alias("count"), *cells)


#: Entries that bound the size of a sketch, and so its error.
SKETCH_K = 800


def rank_error(k: int = SKETCH_K) -> float:
    """How far, as a share of the rows, a quantile's place may be from that asked for, in 99 of 100 sketches of size ``k``."""
    return 2.296 / k**0.9723


def sketch_profile(rows: DataFrame, by: Sequence[str], latency: str = "latency_ns", size: str = "bytes", k: int = SKETCH_K) -> DataFrame:
    """A row for each group that can be stored and merged later (``merge_sketches``): ``count``, the rows with a latency; for both columns total,
    least and greatest, and a KLL sketch of its values.

    A sketch holds a few thousand numbers at most, however many rows it has seen, and partial sketches are made before the
    shuffle, so no group is sorted or gathered. Nulls are left out of their column; a group without values of a column has no
    sketch of it. Null keys make a group of their own.
    """
    cells = []
    for name, c in (("latency", latency), ("bytes", size)):
        v = F.col(c).cast("bigint")
        cells += [F.count(v).alias(f"{name}_count"), F.sum(v).alias(f"{name}_total"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"), F.kll_sketch_agg_bigint(v, k).alias(f"{name}_sketch")]
    return rows.groupBy(*by).agg(*cells)


def merge_sketches(parts: DataFrame, by: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """One row a group from the rows of any number of runs or days; the same columns, so merged ones merge again. ``parts`` may hold coarser
    keys than they were made with: what is not in ``by`` is summed up."""
    cells = []
    for name in ("latency", "bytes"):
        cells += [F.sum(f"{name}_count").alias(f"{name}_count"), F.sum(f"{name}_total").alias(f"{name}_total"), F.min(f"{name}_min").alias(f"{name}_min"), F.max(f"{name}_max").alias(f"{name}_max")]
        cells.append(F.kll_merge_agg_bigint(f"{name}_sketch", k).alias(f"{name}_sketch"))
    return parts.groupBy(*by).agg(*cells)


def sketch_quantiles(profile: DataFrame, by: Sequence[str], quantiles: Sequence[float] = (0.5, *QUANTILES)) -> DataFrame:
    """``by``, ``what`` (latency or bytes), ``count``, ``q`` and ``value``: a value that occurs, whose place is within ``rank_error`` of q.

    The places 0 and 1 are the exact extremes, which travel beside the sketches.
    """
    what = [F.struct(F.lit(n).alias("what"), F.col(f"{n}_count").alias("count"), F.col(f"{n}_min").alias("low"), F.col(f"{n}_max").alias("high"), F.col(f"{n}_sketch").alias("sketch")) for n in ("latency", "bytes")]
    rows = profile.select(*by, F.explode(F.array(*what)).alias("x")).select(*by, "x.*").where("count > 0")

    def value(q: float) -> Column:
        return F.col("low") if q <= 0 else F.col("high") if q >= 1 else F.kll_sketch_get_quantile_bigint("sketch", F.lit(q))

    places = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), value(q).alias("value")) for q in map(float, quantiles)])).alias("p")
    return rows.select(*by, "what", "count", places).select(*by, "what", "count", "p.q", "p.value")


def rank_bounds(rows: DataFrame, found: DataFrame, by: Sequence[str], latency: str = "latency_ns", size: str = "bytes") -> DataFrame:
    """``found`` (of ``sketch_quantiles``) with the exact places of its values: ``below`` and ``upto``, the shares of rows less than the value, and not more.

    Equal values are counted before the join, so a group's rows never meet the quantiles one by one.
    """
    both = F.array(F.struct(F.lit("latency").alias("what"), F.col(latency).cast("bigint").alias("v")), F.struct(F.lit("bytes").alias("what"), F.col(size).cast("bigint").alias("v")))
    counted = rows.select(*by, F.explode(both).alias("x")).select(*by, "x.*").where("v is not null").groupBy(*by, "what", "v").agg(F.count("*").alias("n"))
    met = counted.join(found, [*by, "what"])
    places = [F.sum(F.when(test, F.col("n")).otherwise(0)) for test in (F.col("v") < F.col("value"), F.col("v") <= F.col("value"))]
    return met.groupBy(*by, "what", "count", "q", "value").agg(*[(p / F.col("count")).alias(n) for p, n in zip(places, ("below", "upto"), strict=True)])


def time_series(rows: DataFrame, by: Sequence[str], ts: str = "ts", tie: Sequence[str] = (), latency: str = "latency_ns", size: str = "bytes", split_us: int | Rows | None = None) -> DataFrame:
    """The rows in the order of time within each group, with their places from 1."""
    d = rows.select(*by, *tie, micros(ts).alias("__us"), F.col(ts).alias("ts"), F.col(latency).alias("latency_ns"), F.col(size).alias("bytes"))
    return places(d, list(by), ("__us", *tie), "__i", split_us).select(*by, (F.col("__i") + 1).alias("place"), "ts", "latency_ns", "bytes")
