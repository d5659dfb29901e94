"""Likelihood estimators of identity from per-enzyme mismatch histograms.

A stratum is (tag length k, exact site e, d2, d3, histogram of mismatches of found
tags, number of missing tags). All estimators take a list of strata and are
vectorised over mismatch counts and over grids; they are called once a pair.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

LOW, HIGH = 0.5, 0.999999
_PHI = (math.sqrt(5) - 1) / 2
NAN = float("nan")


@dataclass(frozen=True)
class Stratum:
    enzyme: str
    k: int
    exact: int
    d2: int
    d3: int
    hist: tuple[int, ...]
    miss: int

    @property
    def body(self) -> int:
        return self.k - self.exact - self.d2 - self.d3

    @property
    def found(self) -> int:
        return sum(self.hist)

    @property
    def total(self) -> int:
        return self.found + self.miss


@lru_cache(4096)
def _comb(n: int, m: int) -> float:
    return float(math.comb(n, m)) if 0 <= m <= n else 0.0


def found_with(s: Stratum, a: float) -> np.ndarray:
    """P(a tag is found with m mismatches), m = 0 .. tolerance: the site intact, degenerate places changed within their class, m' changes in the body."""
    a = min(max(a, 1e-9), 1 - 1e-12)
    d, tol = 1 - a, len(s.hist) - 1
    body = np.array([_comb(s.body, m) * d**m * a ** (s.body - m) for m in range(tol + 1)])
    two = np.array([_comb(s.d2, m) * (d / 3) ** m * a ** (s.d2 - m) if m <= s.d2 else 0.0 for m in range(tol + 1)])
    three = np.array([_comb(s.d3, m) * (2 * d / 3) ** m * a ** (s.d3 - m) if m <= s.d3 else 0.0 for m in range(tol + 1)])
    return a**s.exact * np.convolve(np.convolve(body, two)[: tol + 1], three)[: tol + 1]


def _nll(strata: list[Stratum], a: float) -> float:
    out = 0.0
    for s in strata:
        p = found_with(s, a)
        h = np.array(s.hist)
        out -= float((h[h > 0] * np.log(np.maximum(p[h > 0], 1e-300))).sum())
        if s.miss:
            out -= s.miss * math.log(max(1 - p.sum(), 1e-300))
    return out


def minimise(f, lo: float = LOW, hi: float = HIGH, tol: float = 1e-10, most: int = 200) -> float:
    """Golden section search; each step reuses one value."""
    x, y = hi - _PHI * (hi - lo), lo + _PHI * (hi - lo)
    fx, fy = f(x), f(y)
    for _ in range(most):
        if hi - lo < tol:
            break
        if fx < fy:
            hi, y, fy = y, x, fx
            x = hi - _PHI * (hi - lo)
            fx = f(x)
        else:
            lo, x, fx = x, y, fy
            y = lo + _PHI * (hi - lo)
            fy = f(y)
    return (lo + hi) / 2


def retention(strata: list[Stratum], a: float) -> float:
    """Share of tags expected to be found at identity a."""
    n = sum(s.total for s in strata)
    return sum(s.total * found_with(s, a).sum() for s in strata) / n if n and math.isfinite(a) else NAN


def from_loss(strata: list[Stratum]) -> float:
    """Identity at which as many tags as were found are expected; NaN if none was."""
    found = sum(s.found for s in strata)
    return minimise(lambda a: abs(sum(s.total * found_with(s, a).sum() for s in strata) - found)) if found else NAN


def from_histogram(strata: list[Stratum]) -> float:
    """Identity from the mismatches of found tags alone."""
    some = [s for s in strata if s.found]
    if not some:
        return NAN

    def f(a: float) -> float:
        out = 0.0
        for s in some:
            p, h = np.maximum(found_with(s, a), 1e-300), np.array(s.hist)
            out -= float((h * (np.log(p) - math.log(p.sum()))).sum())
        return out

    return minimise(f)


@dataclass
class Fit:
    ani: float
    from_loss: float
    from_hist: float
    n_tags: int
    std_err: float
    inconsistent: bool


def estimate(strata: list[Stratum]) -> Fit:
    """One identity for all strata, with its error from the curvature."""
    strata = [s for s in strata if s.total]
    if not strata:
        return Fit(NAN, NAN, NAN, 0, NAN, True)
    f = lambda a: _nll(strata, a)
    ani = minimise(f)
    h = min(1e-5, max(1 - ani, 1e-9) / 4)
    bend = (f(ani + h) - 2 * f(ani) + f(ani - h)) / h**2
    se = 1 / math.sqrt(bend) if bend > 0 else NAN
    loss, hist = from_loss(strata), from_histogram(strata)
    off = False
    if math.isfinite(loss) and math.isfinite(hist) and retention(strata, ani) >= 0.2:
        off = abs(loss - hist) > (max(5 * se, 0.01) if math.isfinite(se) else 0.01)
    return Fit(ani, loss, hist, sum(s.total for s in strata), se, off)


_lgamma = np.vectorize(math.lgamma)


class _Gamma:
    """Negative log likelihood of gamma-distributed rates for many shapes at once; what depends on the shape alone is computed once."""

    def __init__(self, strata: list[Stratum], alpha: np.ndarray) -> None:
        self.alpha, self.parts = alpha, []
        for s in strata:
            m = np.arange(len(s.hist))[:, None]
            fixed = alpha * np.log(alpha) - _lgamma(alpha) + _lgamma(alpha + m) - _lgamma(m + 1.0)
            self.parts.append((s, m, np.array(s.hist)[:, None], fixed, s.body + s.d2 / 3 + 2 * s.d3 / 3, 2 * s.d2 / 3 + s.d3))

    def __call__(self, d: np.ndarray) -> np.ndarray:
        a, out = self.alpha, np.zeros(len(d))
        for s, m, h, fixed, wide, extra in self.parts:
            lp = fixed + m * np.log(wide * d) - (a + m) * np.log(a + d * s.k)
            if extra:
                lp = lp + a * np.log(a / (a + d * extra))
            out -= (h * lp).sum(0)
            if s.miss:
                out -= s.miss * np.log(np.maximum(1 - np.exp(lp).sum(0), 1e-300))
        return out


def _best_rate(strata: list[Stratum], alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best mean rate of every shape, by golden section on all shapes at once."""
    f = _Gamma(strata, alpha)
    lo, hi = np.full(len(alpha), 1e-6), np.ones(len(alpha))
    x, y = hi - _PHI * (hi - lo), lo + _PHI * (hi - lo)
    fx, fy = f(x), f(y)
    for _ in range(48):
        left = fx < fy
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
        nx, ny = hi - _PHI * (hi - lo), lo + _PHI * (hi - lo)
        new = f(np.where(left, nx, ny))
        fx, fy = np.where(left, new, fy), np.where(left, fx, new)
        x, y = nx, ny
    d = (lo + hi) / 2
    return d, f(d)


def estimate_heterogeneous(strata: list[Stratum]) -> tuple[float, float]:
    """(identity, shape) under gamma rates; the homogeneous identity and an infinite shape where the data do not ask for more."""
    strata = [s for s in strata if s.total]
    if not strata:
        return NAN, NAN
    grid = np.linspace(math.log(0.1), math.log(200), 49)
    _, cost = _best_rate(strata, np.exp(grid))
    at = grid[int(np.argmin(cost))]
    fine = np.linspace(at - 0.35, at + 0.35, 25)
    rate, cost = _best_rate(strata, np.exp(fine))
    k = int(np.argmin(cost))
    alpha, d = float(np.exp(fine[k])), float(rate[k])
    _, flat = _best_rate(strata, np.array([1e6]))
    if 2 * (flat[0] - cost[k]) > 3.841 and alpha < 198:
        return (1 + d / alpha) ** -alpha, alpha
    return estimate(strata).ani, math.inf


def gated(het: float, uniform: float, loss: float, hist: float) -> tuple[float, bool]:
    """The heterogeneous identity, unless loss and histogram disagree by more than 0.05."""
    fallback = math.isfinite(loss) and math.isfinite(hist) and abs(loss - hist) > 0.05 + 1e-12
    return (uniform, True) if fallback else (het, False)


def agreement(strata: list[Stratum]) -> dict:
    """Fits of each enzyme alone, their inverse-variance mean, spread and Cochran's Q over its degrees of freedom."""
    fits = []
    for s in strata:
        if s.found:
            f = estimate([s])
            if math.isfinite(f.std_err) and f.std_err > 0:
                fits.append({"enzyme": s.enzyme, "ani": f.ani, "std_err": f.std_err, "n_tags": f.n_tags})
    if len(fits) < 2:
        return {"fits": fits, "mean": fits[0]["ani"] if fits else NAN, "spread": 0.0, "chi2": NAN, "dof": 0}
    w = np.array([f["std_err"] ** -2 for f in fits])
    x = np.array([f["ani"] for f in fits])
    mean = float((w * x).sum() / w.sum())
    dof = len(fits) - 1
    return {"fits": fits, "mean": mean, "spread": float(x.max() - x.min()), "chi2": float((w * (x - mean) ** 2).sum() / dof), "dof": dof}


def _binomial_upper(found: int, n: int, alpha: float = 0.05) -> float:
    """The one-sided exact upper bound of a share."""
    if n <= 0:
        return NAN
    if found >= n:
        return 1.0
    if found == 0:
        return 1 - alpha ** (1 / n)
    k = np.arange(found + 1)
    logs = math.lgamma(n + 1) - _lgamma(k + 1.0) - _lgamma(n - k + 1.0)
    lo, hi = found / n, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        terms = logs + k * math.log(max(mid, 1e-300)) + (n - k) * math.log(max(1 - mid, 1e-300))
        top = terms.max()
        if top + math.log(np.exp(terms - top).sum()) > math.log(alpha):
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def upper_bound(strata: list[Stratum], alpha: float = 0.05) -> float:
    """The identity whose expected retention is the upper bound of the share found; 0.5 and 1.0 where it saturates."""
    n = sum(s.total for s in strata)
    if not n:
        return NAN
    share = _binomial_upper(sum(s.found for s in strata), n, alpha)
    if share >= 1:
        return 1.0
    if retention(strata, LOW) >= share:
        return 0.5
    if retention(strata, HIGH) <= share:
        return 1.0
    lo, hi = LOW, HIGH
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if retention(strata, mid) < share else (lo, mid)
    return (lo + hi) / 2
