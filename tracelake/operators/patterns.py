"""Bursts, periodicity and trend of value series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.ordered import Rows, look_back, places

BURST, PERIODIC, STABLE = 1000, 0.7, 0.1
#: Microseconds from 1970 to 2000.
ORIGIN = 946_684_800_000_000
#: Nanoseconds in each unit of time that a slope can be given in.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a column of timestamps with or without zone, or of dates."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def bursts(rows: DataFrame, by: Sequence[str], ts: str = "ts", tie: Sequence[str] = (), size: str = "bytes", threshold: int = BURST, split_us: int | Rows | None = None) -> DataFrame:
    """``burst_count`` and ``burst_us`` of each group.

    A burst is a run of rows above ``threshold``; it lasts from its first row to the first row after it. A run that is
    open at the end does not count, nor do groups of one row. Starts and ends take turns, so the times of all bursts are
    the sum of the ends less that of the starts, without the last start if its run is open: one look at the row
    before tells both, and no run is gathered. ``split_us`` spreads a group over spans of that many microseconds.
    Of rows that ``ts`` and ``tie`` leave equal those above come first, so that reruns agree and a run does not end and begin among them.
    """
    keys, order = list(by), ("__us", *tie, "__low")
    high = F.coalesce(F.col(size) > threshold, F.lit(False))
    d = rows.select(*keys, *tie, micros(ts).alias("__us"), high.alias("__high"), (~high).alias("__low"))
    d = look_back(d, keys, F.col("__high"), "__was", order=order, split_ns=split_us).withColumn("__was", F.coalesce("__was", F.lit(False)))
    start = F.when(F.col("__high") & ~F.col("__was"), F.col("__us"))
    end = F.when(~F.col("__high") & F.col("__was"), F.col("__us"))
    edges = d.groupBy(*keys).agg(
        F.count(end).alias("burst_count"), F.count(start).alias("starts"), F.sum(F.coalesce(end, -start, F.lit(0)).cast("decimal(38,0)")).alias("sum_us"), F.max(start).alias("last_us")
    )
    open_us = F.when(F.col("starts") > F.col("burst_count"), F.col("last_us")).otherwise(0)
    return edges.select(*keys, "burst_count", (F.col("sum_us") + open_us).cast("bigint").alias("burst_us"))


#: Values of a series in one block, when all lags are tried, and the share of the variance below which correlations are equal.
BLOCK, EQUAL = 65_536, 1e-10


def _every_lag(d: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``lag`` and ``correlation`` for all lags below half of each group's rows, from ``d`` (keys, i, dev, n, variance).

    Blocks of a series are rows with an array each. Every block meets those at most half the series ahead by an
    equi-join on its number; a pair's products at all lags are one correlation by Fourier transform, and the
    pairs' sums add up by lag.
    """
    packed = d.where("n >= 4").groupBy(*keys, F.floor(F.col("i") / block).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "dev"))).alias("x"), F.first("n").alias("n"))
    packed = packed.select(*keys, "b", "n", F.transform("x", lambda p: p["dev"]).alias("x"))
    steps = F.floor(F.col("n") / 2 / block) + 1
    ahead = packed.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), steps))).select(*keys, (F.col("b") + F.col("step")).alias("b"), "step", "n", F.col("x").alias("x0"))
    pairs = ahead.join(packed.select(*keys, "b", F.col("x").alias("x1")), [*keys, "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                a, b = np.asarray(row["x0"], float), np.asarray(row["x1"], float)
                size = 1 << int(len(a) + len(b) - 1).bit_length()
                c = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)
                apart = np.r_[np.arange(len(b)), np.arange(-len(a) + 1, 0)]
                lag, value = row["step"] * block + apart, c[apart]
                own = (lag >= 1) & (lag < row["n"] // 2)
                yield pd.DataFrame({k: row[k] for k in keys} | {"n": row["n"], "lag": lag[own], "s": value[own]})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name in keys)
    made = pairs.mapInPandas(run, f"{kinds}, n bigint, lag bigint, s double")
    return made.groupBy(*keys, "n", "lag").agg(F.sum("s").alias("s")).select(*keys, "lag", (F.col("s") / (F.col("n") - F.col("lag"))).alias("correlation"))


def periodicity(rows: DataFrame, by: Sequence[str], ts: str = "ts", tie: Sequence[str] = (), size: str = "bytes", max_lag: int | None = None, normalized: bool = False, split_us: int | Rows | None = None, block: int = BLOCK) -> DataFrame:
    """``is_periodic``, ``best_lag``, ``period_us`` and ``correlation`` of each group.

    For each lag below half the group's rows, the mean of the products of deviations that far apart; the best is the
    first of the greatest above zero, and counts as periodic above 0.7. The period is the time from the first row to
    the row best_lag after it. By definition this is a covariance; ``normalized`` divides it by the variance. With
    ``max_lag`` only lags up to it are tried: rows meet by place, as many products a row as there are lags. Without, all are
    tried, by Fourier transforms of pairs of blocks of ``block`` rows; correlations that differ by less than EQUAL of the
    variance then count as equal. A group spreads over all tasks either way; ``split_us`` spreads its numbering too.
    Groups of fewer than four rows have no period.
    """
    keys = list(by)
    d = places(rows.select(*keys, *tie, micros(ts).alias("us"), F.col(size).cast("double").alias("v")), keys, ("us", *tie), "i", split_us)
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(size).cast("double")).alias("mean"))
    d = d.join(whole, keys).withColumn("dev", F.col("v") - F.col("mean"))
    groups = d.groupBy(*keys).agg(F.max("n").alias("n"), F.avg(F.col("dev") * F.col("dev")).alias("variance"))
    if max_lag is None:
        per_lag = _every_lag(d, keys, block)
    else:
        lags = F.least(F.floor(F.col("n") / 2) - 1, F.lit(max_lag))
        ahead = d.where("n >= 4").withColumn("lag", F.explode(F.when(lags >= 1, F.sequence(F.lit(1).cast("bigint"), lags))))
        a = ahead.select(*keys, "lag", (F.col("i") + F.col("lag")).alias("i"), F.col("dev").alias("dev0"))
        products = a.join(d.select(*keys, "i", "dev"), [*keys, "i"])
        per_lag = products.groupBy(*keys, "lag").agg(F.avg(F.col("dev0") * F.col("dev")).alias("correlation"))
    per_lag = per_lag.join(groups.select(*keys, "variance"), keys).withColumn("height", F.when(F.col("variance") > 0, F.col("correlation") / F.col("variance")))
    if max_lag is None:
        per_lag = per_lag.withColumn("height", F.round(F.col("height") / EQUAL) * EQUAL)
    else:
        per_lag = per_lag.withColumn("height", F.col("correlation"))
    if normalized:
        per_lag = per_lag.withColumn("correlation", F.when(F.col("variance") > 0, F.col("correlation") / F.col("variance")))
    top = per_lag.where("correlation > 0 and height > 0").groupBy(*keys).agg(F.max(F.struct("height", (-F.col("lag")).alias("back"), "correlation")).alias("top"))
    best = top.select(*keys, F.col("top.correlation").alias("correlation"), (-F.col("top.back")).cast("bigint").alias("best_lag"))
    times = d.select(*keys, F.col("i").cast("bigint").alias("best_lag"), F.col("us").alias("at"))
    first = d.where("i = 0").select(*keys, F.col("us").alias("from"))
    j = groups.join(best, keys, "left").join(times, [*keys, "best_lag"], "left").join(first, keys, "left")
    periodic = F.coalesce(F.col("correlation") > PERIODIC, F.lit(False))
    period = F.when(periodic & (F.col("best_lag") < F.col("n") - 1), F.col("at") - F.col("from")).otherwise(F.lit(0))
    return j.select(*keys, periodic.alias("is_periodic"), F.coalesce("best_lag", F.lit(0)).alias("best_lag"), period.cast("bigint").alias("period_us"), F.coalesce("correlation", F.lit(0.0)).alias("correlation"))


def trend(rows: DataFrame, by: Sequence[str], ts: str = "ts", size: str = "bytes", unit: str = "ns", threshold: float = STABLE) -> DataFrame:
    """``slope`` (per ``unit`` of time) and ``direction`` of each group: stable below ``threshold``, else increasing or decreasing.

    Times are counted from ORIGIN, which leaves the slope as it is: the sums are of deviations from running means, so they
    keep their digits, and one aggregate does. One row has no direction; a group without spread in time is stable.
    """
    keys = list(by)
    d = rows.select(*keys, ((micros(ts) - F.lit(ORIGIN)) * 1000 / F.lit(float(UNITS[unit]))).alias("x"), F.col(size).cast("double").alias("y"))
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"))
    slope = F.coalesce("slope", F.lit(0.0))
    direction = F.when(F.col("n") < 2, F.lit("")).when(F.abs(slope) < threshold, F.lit("stable")).when(slope > 0, F.lit("increasing")).otherwise(F.lit("decreasing"))
    return out.select(*keys, F.when(F.col("n") < 2, 0.0).otherwise(slope).alias("slope"), direction.alias("direction"))


def analyze(rows: DataFrame, by: Sequence[str], ts: str = "ts", tie: Sequence[str] = (), size: str = "bytes", max_lag: int | None = None, split_us: int | Rows | None = None) -> DataFrame:
    """One row a group with its bursts, period and trend."""
    run, period = bursts(rows, by, ts, tie, size, split_us=split_us), periodicity(rows, by, ts, tie, size, max_lag, split_us=split_us)
    return run.join(period, list(by)).join(trend(rows, by, ts, size), list(by))
