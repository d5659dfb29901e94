import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import fits, panel, report
from tagloom.operators.enzymes import usable
from tests import fits_by_numpy as est
from tests.fits_by_numpy import Stratum


def strata(a, n=1_000_000, geometries=((32, 6, 0, 0), (27, 7, 0, 0), (28, 6, 1, 0), (27, 4, 1, 1)), tol=2):
    out = []
    for k, (length, e, d2, d3) in enumerate(geometries):
        p = est.found_with(Stratum(str(k), length, e, d2, d3, (0,) * (tol + 1), 0), a)
        h = tuple(int(round(n * x)) for x in p)
        out.append(Stratum(str(k), length, e, d2, d3, h, n - sum(h)))
    return out


@pytest.mark.parametrize("a", [0.85, 0.9, 0.95, 0.98, 0.99, 0.995])
def test_recovery(a):
    s = strata(a)
    f = est.estimate(s)
    assert abs(f.ani - a) < 5e-4 and abs(f.from_loss - a) < 5e-4 and abs(f.from_hist - a) < 5e-4 and not f.inconsistent and f.std_err > 0
    assert abs(est.estimate_heterogeneous(s)[0] - a) < 2e-3
    assert abs(est.retention(s, a) - sum(x.found for x in s) / sum(x.total for x in s)) < 1e-3


@pytest.mark.parametrize("d,alpha", [(0.02, 0.5), (0.05, 1.0), (0.1, 2.0)])
def test_gamma_recovery(d, alpha):
    k, e, n = 32, 6, 1_000_000
    m = np.arange(3)
    lp = m * np.log((k - e) * d) - est._lgamma(m + 1.0) + alpha * np.log(alpha) - math.lgamma(alpha) + est._lgamma(alpha + m) - (alpha + m) * np.log(alpha + d * k)
    h = tuple(int(round(n * x)) for x in np.exp(lp))
    ani, shape = est.estimate_heterogeneous([Stratum("x", k, e, 0, 0, h, n - sum(h))])
    assert abs(ani - (1 + d / alpha) ** -alpha) < 2e-3 and math.isfinite(shape)


def test_uniform_data_need_no_shape():
    assert math.isinf(est.estimate_heterogeneous(strata(0.97, 5000))[1])


def test_gate(spark):
    rows = [(0.97, 0.975, 0.930, 0.979), (0.88, 0.91, 0.861, 0.912), (0.88, 0.91, 0.925, 0.875), (0.88, 0.91, 0.90, math.nan), (0.88, 0.91, math.nan, 0.7)]
    df = spark.createDataFrame(rows, "het double, uniform double, loss double, hist double")
    assert [r.g for r in df.select(report.gated_estimate(*map(F.col, df.columns)).alias("g")).collect()] == [0.97, 0.91, 0.88, 0.88, 0.88]
    assert est.estimate([Stratum("x", 32, 6, 0, 0, (400_000, 0, 0), 300_000)]).inconsistent and math.isnan(est.estimate([]).ani)


def test_upper_bound():
    assert abs(est.upper_bound([Stratum("x", 32, 6, 0, 0, (0,), 1000)]) - (1 - 0.05 ** (1 / 1000)) ** (1 / 32)) < 1e-6
    assert est.upper_bound([Stratum("x", 32, 6, 0, 0, (10,), 0)]) == 1.0
    assert math.isnan(est.upper_bound([]))
    rng = np.random.default_rng(3)
    ok = 0
    for _ in range(400):
        h = rng.binomial(300, est.found_with(Stratum("x", 32, 6, 0, 0, (0, 0, 0), 0), 0.9).sum())
        ok += est.upper_bound([Stratum("x", 32, 6, 0, 0, (int(h), 0, 0), 300 - int(h))]) >= 0.9
    assert ok >= 372


def test_agreement():
    a = est.agreement(strata(0.95, 2000))
    assert a["dof"] == 3 and abs(a["mean"] - 0.95) < 0.01 and a["chi2"] < 1
    assert est.agreement([])["dof"] == 0


def observed(rng, names, a, n, shape):
    """Strata of genomes of identity a whose rates are gamma-distributed."""
    out = []
    for e in names:
        k, exact, d2, d3 = fits.sites().get(e, fits.UNKNOWN)
        h, total = np.zeros(3, int), 20 * max(n // 20, 1)
        for _ in range(20):
            rate = rng.gamma(shape, 1 / shape) if math.isfinite(shape) else 1
            p = est.found_with(Stratum(e, k, exact, d2, d3, (0, 0, 0), 0), max(1 - (1 - a) * rate, 0.3))
            h += rng.multinomial(total // 20, np.append(p, 1 - p.sum()))[:3]
        out.append(Stratum(e, k, exact, d2, d3, tuple(map(int, h)), int(total - h.sum())))
    return sorted(out, key=lambda s: s.enzyme)


def test_plans_equal_numpy(spark):
    """Every estimate of the folds against golden sections in numpy: all registered enzymes, an unknown one, none and all found."""
    rng = np.random.default_rng(3)
    names = [e.name for e in usable()]
    want = {}
    for k in range(40):
        own = ["nobody"] if k == 0 else list(map(str, rng.choice(names, rng.integers(1, 5), replace=False)))
        want[k] = observed(rng, own, rng.choice([0.6, 0.75, 0.85, 0.9, 0.95, 0.98, 0.995, 0.9999]), int(rng.choice([3, 20, 300, 5000, 20_000])), rng.choice([0.5, 2, math.inf]))
        if k % 10 in (3, 4):
            found = lambda s: (0, 0, 0) if k % 10 == 3 else (s.total, 0, 0)  # noqa: B023, E731
            want[k] = [Stratum(s.enzyme, s.k, s.exact, s.d2, s.d3, found(s), s.total - sum(found(s))) for s in want[k]]
    rows = [(k, s.enzyme, list(s.hist), s.miss) for k, own in want.items() for s in own] + [(99, "BcgI", [0, 0, 0], 0)]
    arrays = fits.gathered(spark.createDataFrame(rows, "p int, enzyme string, hist array<long>, n_miss long"), ["p"], 2)
    got = {r.p: r for r in fits.fitted(arrays, ["p"], 2).collect()}
    both = {r.p: r for r in fits.agreement(fits.by_enzyme(arrays, ["p"], 2), ["p"]).collect()}
    assert set(got) == set(want)
    same = lambda x, y, tol: x == y or (x != x and y != y) or math.isclose(x, y, rel_tol=tol, abs_tol=tol)
    for k, own in want.items():
        f, g, a = est.estimate(own), got[k], est.agreement(own)
        het, shape = est.estimate_heterogeneous(own)
        pairs = [(g.ani_uniform, f.ani, 1e-7), (g.from_loss, f.from_loss, 1e-7), (g.from_hist, f.from_hist, 1e-7), (g.het, het, 1e-6), (g.shape, shape, 1e-6), (g.upper, est.upper_bound(own), 1e-9), (g.retention, est.retention(own, f.ani), 1e-6), (g.n_tags, f.n_tags, 0), (g.std_err, f.std_err, 1e-3)]
        if a["fits"]:
            pairs += [(both[k].enzyme_mean, a["mean"], 1e-6), (both[k].enzyme_spread, a["spread"], 1e-6), (both[k].enzyme_chi2, a["chi2"], 1e-3)]
        assert all(same(*x) for x in pairs), (k, pairs)


def test_bounds_of_shares(spark):
    cases = [(0, 7), (1, 7), (6, 7), (7, 7), (3, 1000), (999, 1000), (250_000, 500_000), (12, 3_000_000), (0, 0)]
    df = spark.createDataFrame([(float(k), float(n)) for k, n in cases], "k double, n double")
    got = [r.x for r in df.select(fits.binomial_upper(F.col("k"), F.col("n")).alias("x")).collect()]
    for (k, n), x in zip(cases, got, strict=True):
        want = est._binomial_upper(k, n)
        assert math.isclose(x, want, rel_tol=1e-8) or (x != x and want != want), (k, n, x, want)
    lg = [r.x for r in spark.createDataFrame([(x,) for x in (1.0, 1.5, 2.0, 7.0, 100.0, 1e7)], "v double").select(fits.log_gamma(F.col("v")).alias("x")).collect()]
    assert all(math.isclose(a, math.lgamma(b), rel_tol=1e-12, abs_tol=1e-12) for a, b in zip(lg, (1.0, 1.5, 2.0, 7.0, 100.0, 1e7), strict=True))


def test_panels(spark):
    s = observed(np.random.default_rng(8), ["AlfI", "BcgI", "FalI"], 0.94, 3000, 1.0)
    df = spark.createDataFrame([("a", "b", x.enzyme, list(x.hist), x.miss) for x in s], "query string, reference string, enzyme string, hist array<long>, n_miss long")
    got = {r.panel: r.ani for r in panel.estimates(df, {"all": None, "two": ["BcgI", "FalI"], "none": ["CjeI"]}).collect()}
    assert math.isclose(got["all"], 100 * est.estimate_heterogeneous(s)[0], rel_tol=1e-6) and math.isclose(got["two"], 100 * est.estimate_heterogeneous(s[1:])[0], rel_tol=1e-6) and math.isnan(got["none"])
