"""Golden cases of the consistency tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.functions import tails
from probity.operators import statistics as S


@pytest.mark.parametrize(("mean", "n", "ok"), [(3.50, 10, True), (3.47, 12, False), (3.33, 3, False), (1.234, 1, True)])
def test_grim(spark, mean, n, ok):
    row = spark.createDataFrame([(mean, n)], "m double, n int").select(S.grim_consistent(F.col("m"), F.col("n")).alias("ok")).first()
    assert row.ok is ok


def test_grimmer_small_samples():
    assert S.grimmer(3.50, 1.58, 10)
    assert not S.grimmer(3.50, 1.37, 4)
    assert S.grimmer(3.5, 9.9, 2)


def test_achievable_is_brute_force():
    import itertools

    for n, total in ((3, 5), (4, 6), (2, 0)):
        brute = {sum(x * x for x in c) for c in itertools.product(range(total + 1), repeat=n) if sum(c) == total}
        assert S.achievable(n, total) == brute


def test_tails():
    assert tails.chi2_sf(26.12448, 8) == pytest.approx(0.001, abs=1e-6)
    assert tails.t_two_tailed(2.0, 30) == pytest.approx(0.054625, abs=1e-6)
    assert tails.f_sf(4, 2, 50) == pytest.approx((1 + 8 / 50) ** -25, abs=1e-9)


def test_p_value_check(spark):
    t = spark.createDataFrame([(1, "t", 2.0, 1, 30, 0.001), (2, "r", 1.0, 1, 8, 0.5)], "id long, test_type string, statistic double, df1 int, df2 int, reported_p double")
    rows = {r.id: r for r in S.check_p_values(t).collect()}
    assert not rows[1].consistent
    assert rows[1].significance_changed
    assert rows[2].consistent


def test_benford_and_terminal_digits(spark):
    v = spark.createDataFrame([(1, 50 + 0.1 * i) for i in range(500)] + [(2, None)], "g int, v double")
    got = {r.g: r for r in S.benford(v, "g", "v").collect()}
    assert not got[1].conforms
    assert 2 not in got
    digits = spark.createDataFrame([(0.25,), (120.0,), (0.0,), (3.1,), (1e-5,), (100.05,)], "v double").select(S.terminal_digit(F.col("v")).alias("d"))
    assert [r.d for r in digits.collect()] == [5, 0, 0, 1, 1, 5]


def test_duplicates(spark):
    rows = [(1, i, "3.14") for i in range(6)] + [(2, i, str(i + 0.37)) for i in range(4)]
    got = {r.t: r for r in S.duplicate_cells(spark.createDataFrame(rows, "t int, p int, c string"), "t", "c", "p").collect()}
    assert got[1].suspicious
    assert got[1].duplicates == 5
    assert not got[2].suspicious


def test_variance_ratio(spark):
    rows = [(1, s, n) for s, n in zip((1.2, 1.5, 0.9, 1.8), (30, 28, 32, 25), strict=True)] + [(2, s, 30) for s in (1.50, 1.51, 1.49, 1.50)] + [(3, 1.0, 9)]
    got = {r.t: r.suspicious for r in S.variance_ratio(spark.createDataFrame(rows, "t int, sd double, n int"), "t").collect()}
    assert got == {1: False, 2: True, 3: False}


def test_sprite():
    assert S.sprite(4.0, 0.0, 5)
    assert not S.sprite(9.0, 1.0, 5)
    sample = np.array([1, 2, 3, 4, 7, 7])
    assert S.sprite(round(sample.mean(), 2), round(sample.std(ddof=1), 2), 6)
    assert not S.sprite(4.0, 9.0, 5)


@pytest.mark.parametrize("distribution", ["norm", "expon"])
def test_distribution_fit(spark, distribution):
    r = np.random.default_rng(3)
    groups = {"normal": r.normal(5, 2, 400).round(3), "waiting": r.exponential(3, 400).round(3), "ties": np.repeat([1.0, 2.0, 9.0], 40), "few": np.array([1.0, 2.0]), "flat": np.full(20, 4.0)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("normal", None)]
    got = {x.g: x for x in S.distribution_fit(spark.createDataFrame(rows, "g string, v double"), "g", "v", distribution).collect()}
    assert set(got) == {"normal", "waiting", "ties"}
    for g, x in got.items():
        v = np.sort(groups[g])
        n, i = len(v), np.arange(1, len(v) + 1)
        if distribution == "norm":
            f, h = tails.normal_cdf((v - v.mean()) / v.std()), tails.normal_cdf((v - v.mean()) / v.std(ddof=1))
            critical = 0.787 / (1 + 4 / n - 25 / n**2)
        else:
            f, h = 1 - np.exp(-(v - v.min()) / (v.mean() - v.min())), np.where(v > 0, 1 - np.exp(-v / v.mean()), 0.0)
            critical = 1.341 / (1 + 0.6 / n)
        assert x.ks == pytest.approx(np.maximum(i / n - f, f - (i - 1) / n).max(), abs=1e-5)
        assert x.anderson == pytest.approx(-n - ((2 * i - 1) * (np.log(np.maximum(h, 1e-300)) + np.log(1 - h[::-1]))).sum() / n, abs=1e-4)
        assert x.critical == pytest.approx(critical, abs=1e-6)
    assert [got[g].suspicious for g in ("normal", "waiting", "ties")] == ([False, True, True] if distribution == "norm" else [True, False, True])


def test_one_tailed_correlations(spark):
    t = spark.createDataFrame([(1, "r", 0.5, 1, 18, 0.0125), (2, "t", 2.0, 1, 30, 0.05)], "id long, test_type string, statistic double, df1 int, df2 int, reported_p double")
    two, one = (S.check_p_values(t, x).orderBy("id").collect() for x in (False, True))
    assert one[0].computed_p == pytest.approx(two[0].computed_p / 2)
    assert one[1].computed_p == two[1].computed_p
    assert (one[0].consistent, two[0].consistent) == (True, False)
