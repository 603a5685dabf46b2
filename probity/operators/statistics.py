"""Consistency tests of reported statistics and digit distributions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from probity.functions import tails

#: chi-square at which the tail of df 8 is 0.001, and of df 9 is 0.01.
BENFORD_LIMIT = 26.12448155837614
TERMINAL_LIMIT = 21.665994333461924


def grim_consistent(mean: Column, n: Column, decimals: int = 2) -> Column:
    """A mean of n integers, reported to some decimals, must be near a multiple of 1/n."""
    product = mean * n
    return (n < 2) | (F.abs(product - F.rint(product)) <= 0.5 / 10**decimals)


@lru_cache(maxsize=128)
def square_masks(n: int, most: int, top: int) -> list[int]:
    """For each total up to ``top``, the sums of squares of n integers in [0, most], as a bit mask.

    Adding an item is a shift.
    """
    table = [1] + [0] * top
    for _ in range(n):
        nxt = [0] * (top + 1)
        for t, squares in enumerate(table):
            if squares:
                for v in range(min(most, top - t) + 1):
                    nxt[t + v] |= squares << (v * v)
        table = nxt
    return table


def _squares(n: int, total: int) -> int:
    """The mask of n non-negative integers with a total; totals share a table by steps of 32."""
    if total < 0:
        return 0
    top = -(-total // 32) * 32
    return square_masks(n, top, top)[total]


def achievable(n: int, total: int) -> frozenset[int]:
    """Sums of squares that n non-negative integers with a given total can have."""
    bits = bin(_squares(n, total))[:1:-1]
    return frozenset(i for i, b in enumerate(bits) if b == "1")


def _has_sd(mask: int, total: int, n: int, sd: float, tol: float) -> bool:
    """Whether a sum of squares in the mask has this SD; only sums near the SD are looked at."""
    if not 0 <= sd + tol < math.inf:
        return False
    low = math.floor(max(sd - tol, 0) ** 2 * (n - 1) + total**2 / n) - 1
    high = math.ceil((sd + tol) ** 2 * (n - 1) + total**2 / n) + 1
    near = range(max(low, 0), min(high + 1, mask.bit_length()))
    return any(mask >> s & 1 and abs(math.sqrt(max((s - total**2 / n) / (n - 1), 0)) - sd) <= tol for s in near)


def grimmer(mean: float, sd: float, n: int, decimals: int = 2) -> bool:
    """Whether integers exist with this mean, SD and n. Over 20 items, bounds of the SD decide."""
    if n is None or n < 3:
        return True
    tol = 0.5 / 10**decimals
    total = round(mean * n)
    if n > 20:
        low_item, rest = divmod(total, n)
        ss = (n - rest) * low_item**2 + rest * (low_item + 1) ** 2
        low = math.sqrt(max((ss - total**2 / n) / (n - 1), 0))
        high = math.sqrt(max((total**2 - total**2 / n) / (n - 1), 0))
        return low - tol <= sd <= high + tol
    return _has_sd(_squares(n, total), total, n, sd, tol)


@F.pandas_udf(BooleanType())
def grimmer_consistent(mean: pd.Series, sd: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([grimmer(float(m), float(s), int(k)) for m, s, k in zip(mean, sd, n, strict=True)])


def grimmer_bounds(mean: Column, sd: Column, n: Column, decimals: int = 2) -> Column:
    """The decision for more than 20 items, without Python."""
    total = F.rint(mean * n)
    item = F.floor(total / n)
    rest = total - item * n
    ss = (n - rest) * item * item + rest * (item + 1) * (item + 1)
    root = lambda x: F.sqrt(F.greatest((x - total * total / n) / (n - 1), F.lit(0.0)))
    tol = 0.5 / 10**decimals
    return (root(ss) - tol <= sd) & (sd <= root(total * total) + tol)


def leading_digit(value: Column) -> Column:
    """First significant digit of a positive number, of its 15-digit decimal text."""
    return F.substring(F.format_string("%.14e", value), 1, 1).cast("int")


def benford(frame: DataFrame, group: str, value: str) -> DataFrame:
    """Chi-square of leading digits against Benford's law, per group; groups without positive
    values don't appear (they conform)."""
    d = frame.filter(F.col(value) > 0).select(group, leading_digit(F.col(value)).alias("digit"))
    per = d.groupBy(group, "digit").agg(F.count("*").alias("o"))
    counts = per.groupBy(group).agg(F.sum("o").alias("n"), *[F.sum(F.when(F.col("digit") == k, F.col("o")).otherwise(0)).alias(f"o{k}") for k in range(1, 10)])
    expected = [F.col("n") * math.log10(1 + 1 / k) for k in range(1, 10)]
    chi = sum(((F.col(f"o{k}") - e) * (F.col(f"o{k}") - e) / e for k, e in zip(range(1, 10), expected, strict=True)), F.lit(0.0))
    return counts.select(group, "n", F.round(chi, 6).alias("chi_square"), (chi <= BENFORD_LIMIT).alias("conforms"))


def terminal_digit(value: Column) -> Column:
    """Last significant digit of the shortest 15-digit text: last non-zero decimal, else units."""
    text = F.format_string("%.14e", F.abs(value))
    digits = F.concat(F.substring(text, 1, 1), F.substring(text, 3, 14))
    exponent = F.substring(text, 18, 6).cast("int")
    trimmed = F.regexp_replace(digits, "0+$", "")
    fraction = F.length(trimmed) > exponent + 1
    units = F.when(exponent < 0, "0").otherwise(F.substring(F.rpad(digits, 40, "0"), exponent + 1, F.lit(1)))
    return F.when(value == 0, 0).when(fraction | (exponent >= 15), F.right(trimmed, F.lit(1)).cast("int")).otherwise(units.cast("int"))


def terminal_digits(frame: DataFrame, group: str, value: str) -> DataFrame:
    """Uniformity of last digits per group; under ten values nothing is suspicious."""
    d = frame.filter(F.col(value).isNotNull()).select(group, terminal_digit(F.col(value)).alias("digit"))
    per = d.groupBy(group, "digit").agg(F.count("*").alias("o"))
    chi = per.groupBy(group).agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o")).alias("oo"))
    stat = F.col("oo") * 10.0 / F.col("n") - F.col("n")
    return chi.select(group, "n", F.round(stat, 6).alias("chi_square"), ((F.col("n") >= 10) & (stat > TERMINAL_LIMIT)).alias("suspicious"))


@F.pandas_udf(DoubleType())
def test_p_value(kind: pd.Series, statistic: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Two-tailed t and r, upper F and chi-square; null where the statistic allows none."""
    s, a, b = statistic.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)
    out = np.full(len(s), np.nan)
    k = kind.to_numpy()
    with np.errstate(all="ignore"):
        for name, f in (("t", lambda i: tails.t_two_tailed(s[i], b[i])), ("F", lambda i: tails.f_sf(s[i], a[i], b[i])), ("chi2", lambda i: tails.chi2_sf(s[i], a[i])), ("r", lambda i: tails.t_two_tailed(s[i] * np.sqrt(b[i] / (1 - s[i] ** 2)), b[i]))):
            i = np.flatnonzero((k == name) & ~np.isnan(s) & (b > 0) & (a > 0) & ((k != "r") | (np.abs(s) < 1)))
            if len(i):
                out[i] = f(i)
    return pd.Series(out)


def check_p_values(tests: DataFrame, one_tailed: bool = False) -> DataFrame:
    """Adds the computed p, and whether the report agrees: within .01 and on the same side of .05.
    What can't be computed (|r| of 1 and more, no degrees of freedom) counts as consistent.
    ``one_tailed`` halves the p of correlations."""
    p = tests.withColumn("computed_p", test_p_value("test_type", "statistic", "df1", "df2"))
    if one_tailed:
        p = p.withColumn("computed_p", F.when(F.col("test_type") == "r", F.col("computed_p") / 2).otherwise(F.col("computed_p")))
    changed = (F.col("reported_p") < 0.05) != (F.col("computed_p") < 0.05)
    ok = (F.abs(F.col("reported_p") - F.col("computed_p")) <= 0.01) & ~changed
    return p.withColumns({"significance_changed": F.coalesce(changed, F.lit(False)), "consistent": F.col("computed_p").isNull() | ok})


def duplicate_cells(cells: DataFrame, group: str, cell: str, pos: str) -> DataFrame:
    """Repeated and round values of a table's cells, with the three most common (ties: first seen, then by text)."""
    c = cells.select(group, F.trim(cell).alias("cell"), pos).filter("cell != ''")
    number = F.when(F.rlike("cell", F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), F.col("cell").cast("double"))
    tenth = F.rint(number * 10)
    is_round = (number == F.rint(number)) | ((F.abs(number * 10 - tenth) < 1e-9) & (F.pmod(tenth, F.lit(5)) == 0))
    per = c.groupBy(group, "cell").agg(F.count("*").alias("k"), F.min(pos).alias("first"))
    per = per.withColumns({"numeric": number.isNotNull(), "round": F.coalesce(is_round, F.lit(False))})
    order = Window.partitionBy(group).orderBy(F.desc("k"), "first", "cell")
    top = per.withColumn("rank", F.row_number().over(order))
    out = top.groupBy(group).agg(
        F.sum("k").alias("n"), F.sum(F.col("k") - 1).alias("duplicates"),
        F.sum(F.when(F.col("numeric"), F.col("k")).otherwise(0)).alias("n_numeric"), F.sum(F.when(F.col("round"), F.col("k")).otherwise(0)).alias("n_round"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "cell")))), lambda x: x["cell"]), ",").alias("most_common"),
    )
    dup, rnd = F.col("duplicates") / F.col("n"), F.when(F.col("n_numeric") > 0, F.col("n_round") / F.col("n_numeric")).otherwise(0.0)
    return out.select(group, "n", "duplicates", "n_numeric", "n_round", "most_common", ((dup > 0.3) | ((rnd > 0.7) & (F.col("n_numeric") >= 5))).alias("suspicious"))


@F.pandas_udf(DoubleType())
def chi2_cdf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(1 - tails.chi2_sf(x.to_numpy(float), k.to_numpy(float)))


def variance_ratio(pairs: DataFrame, group: str, sd: str = "sd", n: str = "n") -> DataFrame:
    """Whether reported SDs vary less than sampling allows (left tail under .05; three pairs at least).

    The spread of SDs comes from sums, so that one partial aggregation does.
    """
    g = pairs.groupBy(group).agg(
        F.count("*").alias("k"), F.sum((F.col(n) - 1) * F.col(sd) * F.col(sd)).alias("ss"), F.sum(F.col(n) - 1).alias("df"),
        F.var_samp(sd).alias("observed"), F.sum(1 / (2.0 * F.col(n))).alias("inv"),
    )
    expected = F.col("ss") / F.col("df") * F.col("inv") / F.col("k")
    g = g.withColumn("ratio", F.when(F.col("k") < 3, F.lit(None).cast("double")).when(expected == 0, F.lit(float("inf"))).otherwise(F.col("observed") / expected))
    p = F.when(F.col("ratio").isNotNull(), chi2_cdf((F.col("k") - 1) * F.coalesce("ratio", F.lit(0.0)), F.col("k") - 1))
    return g.select(group, "k", F.round("ratio", 6).alias("ratio"), F.round(p, 6).alias("p"), F.coalesce(p < 0.05, F.lit(False)).alias("suspicious"))


def sprite(mean: float, sd: float, n: int, low: int = 1, high: int = 7, attempts: int = 1000, seed: int = 42, tol: float = 0.005) -> bool:
    """Whether a sample of integers in [low, high] with this mean, SD and n can be found.

    Exact: all sums of squares that samples with this total reach are known, so that no feasible
    SD is missed (a random search can miss some).
    """
    if n < 2:
        return True
    if not low <= mean <= high:
        return False
    total = round(mean * n)
    if not low * n <= total <= high * n or abs(total / n - mean) > tol:
        return False
    shift = total - low * n  # values counted from low
    return _has_sd(square_masks(n, high - low, (high - low) * n)[shift], shift, n, sd, tol)


@F.pandas_udf(BooleanType())
def sprite_feasible(mean: pd.Series, sd: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([sprite(float(m), float(s), int(k)) for m, s, k in zip(mean, sd, n, strict=True)])


#: 5 % points of Anderson and Darling's statistic, before the correction for n.
ANDERSON = {"norm": 0.787, "expon": 1.341}
#: Ranges of the fitted distribution in which a group's values are numbered, so that no task sorts a group.
RANGES = 64


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(tails.normal_cdf(z))


def distribution_fit(frame: DataFrame, group: str, value: str, distribution: str = "norm") -> DataFrame:
    """(group, n, ks, p, anderson, critical, suspicious): each group's values against a normal (norm) or an
    exponential (expon) of their own parameters.

    Suspicious are a Kolmogorov-Smirnov p under .01 and an Anderson-Darling statistic over its 5 %
    point. Groups under five values or without spread are left out; nulls don't count.
    """
    v, n, i = F.col("v"), F.col("n"), F.col("i")
    key = "fitted_group"  # the group's own name may be one of those below
    rows = frame.filter(F.col(value).isNotNull()).select(F.col(group).alias(key), F.col(value).cast("double").alias("v"))
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.stddev_samp("v").alias("s1"), F.min("v").alias("lo"))
    fit = rows.join(sums.filter("s > 0 and n >= 5"), key)
    if distribution == "norm":
        fit = fit.withColumns({"f": normal_cdf((v - F.col("m")) / F.col("s")), "g": normal_cdf((v - F.col("m")) / F.col("s1"))})
        critical = ANDERSON["norm"] / (1 + 4 / n - 25 / n / n)
    elif distribution == "expon":
        rate = lambda x, scale: F.when(x > 0, 1 - F.exp(-x / scale)).otherwise(0.0)
        fit = fit.withColumns({"f": rate(v - F.col("lo"), F.col("m") - F.col("lo")), "g": rate(v, F.col("m"))})
        critical = ANDERSON["expon"] / (1 + 0.6 / n)
    else:
        raise ValueError(f"no fit for {distribution}")
    fit = fit.withColumn("range", F.least(F.floor(F.col("f") * RANGES), F.lit(RANGES - 1)))
    ahead = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = fit.groupBy(key, "range").agg(F.count("*").alias("c"))
    offsets = counts.select(key, "range", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("before"))
    fit = fit.withColumn("i", F.row_number().over(Window.partitionBy(key, "range").orderBy("v"))).join(offsets, [key, "range"]).withColumn("i", i + F.col("before"))
    low = lambda c: F.log(F.greatest(c, F.lit(1e-300)))
    apart = F.greatest(i / n - F.col("f"), F.col("f") - (i - 1) / n)
    d = fit.groupBy(key).agg(F.max(apart).alias("d"), F.first("n").alias("n"), F.sum((2 * i - 1) * low(F.col("g")) + (2 * n + 1 - 2 * i) * low(1 - F.col("g"))).alias("t"))
    d = d.withColumn("anderson", -n - F.col("t") / n).withColumn("critical", critical).withColumn("p", _kolmogorov("d", "n"))
    suspicious = (F.col("p") < 0.01) & (F.col("anderson") > F.col("critical"))
    return d.select(F.col(key).alias(group), "n", F.round("d", 6).alias("ks"), F.round("p", 6).alias("p"), F.round("anderson", 6).alias("anderson"), F.round("critical", 6).alias("critical"), suspicious.alias("suspicious"))


@F.pandas_udf(DoubleType())
def _kolmogorov(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([tails.kolmogorov_sf(float(a), int(b)) for a, b in zip(d, n, strict=True)])
