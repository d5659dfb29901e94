"""Likelihood fits of identity as folds over arrays: expressions of a plan, no row leaves the JVM.

A pair's strata are one array, an element an enzyme: of ``total`` tags tested,
``h[m]`` were found with m mismatches and ``miss`` were not. A place keeps its
base with probability a, so a tag of length k is found with m mismatches with
probability c[m] (1 - a)^m a^(k - m); c counts the ways, with a third (two
thirds) of the changes at two-base (three-base) places keeping the site.

Every optimum is a fold over halving steps: a step is taken where the slope of
the log likelihood still rises. That is the place a golden section closes in on,
to full precision, as it is not found by comparing nearly equal values.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.enzymes import LONGEST_TAG, Enzyme, usable

LOW, HIGH, STEPS = 0.5, 0.999999, 44
RATE_LOW, RATE_HIGH = 1e-6, 1.0
#: The grid of gamma shapes, the shape that stands for uniform rates, and what the second parameter must gain.
SHAPE_LOW, SHAPE_HIGH, COARSE, FINE, REACH = 0.1, 200.0, 48, 24, 0.35
UNIFORM_SHAPE, WORTH = 1e6, 3.841
#: Site of a tag whose enzyme nobody registered.
UNKNOWN = (32, 6, 0, 0)
ALPHA = 0.05
NAN = float("nan")
_TINY = 1e-300


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ways(k: int, exact: int, d2: int, d3: int, tolerance: int) -> list[float]:
    """c[m]: weighted ways to place m visible changes outside the exact site."""
    body = k - exact - d2 - d3
    return [sum(math.comb(body, m - i - j) * math.comb(d2, i) * math.comb(d3, j) / 3**i * (2 / 3) ** j for i in range(m + 1) for j in range(m + 1 - i)) for m in range(tolerance + 1)]


def sites(panel: list[Enzyme] | None = None) -> dict[str, tuple[int, int, int, int]]:
    """(tag length, exact, two-base, three-base places) by enzyme."""
    return {e.name: (min(e.tag_len, LONGEST_TAG), e.exact_site, e.d2, e.d3) for e in {e.name: e for e in [*usable(), *(panel or [])]}.values()}


def gathered(strata: DataFrame, keys: list[str], tolerance: int, panel: list[Enzyme] | None = None) -> DataFrame:
    """keys, s: the strata with any tag as one array, sorted by enzyme (as many elements as there are enzymes).

    strata: keys, enzyme, hist (array of tolerance + 1), n_miss. An enzyme
    that is not registered has a site of 6 exact places in 32.
    """

    def site(g: tuple[int, int, int, int]) -> str:
        k, exact, d2, d3 = g
        c = ", ".join(f"{x!r}D" for x in ways(*g, tolerance))
        return f"named_struct('tag_len', {k}, 'exact_site', {exact}, 'd2', {d2}, 'd3', {d3}, 'body_len', {k - exact - d2 - d3}, 'k', {float(k)}D, 'c', array({c}), 'wide', {k - exact - 2 * d2 / 3 - d3 / 3!r}D, 'kill', {2 * d2 / 3 + float(d3)!r}D)"

    table = ", ".join(f"'{name}', {site(g)}" for name, g in sites(panel).items())
    own = F.expr(f"coalesce(try_element_at(map({table}), enzyme), {site(UNKNOWN)})")
    found = F.aggregate("hist", F.lit(0).cast("long"), lambda a, x: a + x)
    s = strata.select(*keys, "enzyme", "hist", "n_miss", own.alias("g"), found.alias("found")).where("found + n_miss > 0")
    element = F.struct("enzyme", "g.*", F.col("hist").cast("array<double>").alias("h"), F.col("n_miss").cast("double").alias("miss"), F.col("found").cast("double").alias("found"), (F.col("found") + F.col("n_miss")).cast("double").alias("total"))
    return s.groupBy(*keys).agg(F.sort_array(F.collect_list(element)).alias("s"))


class Fits:
    """The estimators of one array column of strata (see ``gathered``); all are NaN for an empty one."""

    def __init__(self, strata: Column, tolerance: int) -> None:
        self.s, self.n = strata, tolerance

    # --- pieces ---

    def _sum(self, term: Callable[[Column], Column]) -> Column:
        return F.aggregate(self.s, F.lit(0.0), lambda acc, t: acc + term(t))

    @staticmethod
    def _climb(lo: float, hi: float, rises: Callable[[Column], Column]) -> Column:
        """The last place from lo on up to which the slope rises."""
        widths = F.expr(f"transform(sequence(1, {STEPS}), i -> {hi - lo!r}D / power(2D, i))")
        return F.aggregate(widths, F.lit(lo), lambda x, w: let(x + w, lambda y: F.when(rises(y), y).otherwise(x)))

    @staticmethod
    def _power(x: Column, m: int) -> Column:
        out = F.lit(1.0)
        for _ in range(m):
            out = out * x
        return out

    def _shares(self, t: Column, a: Column) -> Column:
        """p[m] of a stratum at identity a."""
        n = self.n
        return let(F.pow(a, t["k"] - n), lambda b: F.array(*[F.get(t["c"], F.lit(m)) * self._power(1 - a, m) * self._power(a, n - m) * b for m in range(n + 1)]))

    @staticmethod
    def _total(p: Column, n: int) -> Column:
        out = F.get(p, F.lit(0))
        for m in range(1, n + 1):
            out = out + F.get(p, F.lit(m))
        return out

    def _weighted(self, p: Column, t: Column, a: Column) -> Column:
        """sum of p[m] d/da ln p[m]."""
        out = F.lit(0.0)
        for m in range(self.n + 1):
            out = out + F.get(p, F.lit(m)) * ((t["k"] - m) / a - F.lit(float(m)) / (1 - a))
        return out

    # --- one identity for all strata ---

    def _slope(self, t: Column, a: Column) -> Column:
        lost = lambda p: F.when(t["miss"] > 0, t["miss"] * self._weighted(p, t, a) / F.greatest(1 - self._total(p, self.n), F.lit(_TINY))).otherwise(0.0)
        return self._weighted(t["h"], t, a) - let(self._shares(t, a), lost)

    def uniform(self) -> Column:
        return F.when(F.size(self.s) > 0, self._climb(LOW, HIGH, lambda a: self._sum(lambda t: self._slope(t, a)) > 0)).otherwise(NAN)

    def retention(self, a: Column) -> Column:
        """The share of tags that is expected to be found at identity a."""
        return F.when(F.size(self.s) > 0, self.expected(a) / self._sum(lambda t: t["total"])).otherwise(NAN)

    def expected(self, a: Column) -> Column:
        return self._sum(lambda t: t["total"] * self._total(self._shares(t, a), self.n))

    def std_err(self, a: Column) -> Column:
        """From the second difference of the log likelihood, in steps of 1e-5 at most."""

        def bend(h: Column) -> Column:
            def part(t: Column) -> Column:
                out = F.lit(0.0)
                for m in range(self.n + 1):
                    # ln(x + h) - 2 ln x + ln(x - h) = ln(1 - (h / x)^2)
                    out = out - F.get(t["h"], F.lit(m)) * ((t["k"] - m) * F.log1p(-(h / a) * (h / a)) + F.lit(float(m)) * F.log1p(-(h / (1 - a)) * (h / (1 - a))))
                lost = lambda x: F.greatest(1 - self._total(self._shares(t, x), self.n), F.lit(_TINY))
                return out - F.when(t["miss"] > 0, t["miss"] * F.log(lost(a + h) / lost(a) * (lost(a - h) / lost(a)))).otherwise(0.0)

            return self._sum(part) / (h * h)

        step = F.least(F.lit(1e-5), F.greatest(1 - a, F.lit(1e-9)) / 4)
        return F.when((F.size(self.s) > 0) & ~F.isnan(a), let(let(step, bend), lambda b: F.when(b > 0, 1 / F.sqrt(b)).otherwise(NAN))).otherwise(NAN)

    def from_loss(self) -> Column:
        """The identity at which as many tags as were found are expected; NaN if none was."""
        return let(self._sum(lambda t: t["found"]), lambda n: F.when(n > 0, self._climb(LOW, HIGH, lambda a: self.expected(a) < n)).otherwise(NAN))

    def from_histogram(self) -> Column:
        """The identity from the mismatches of found tags alone; NaN if none was found."""

        def slope(t: Column, a: Column) -> Column:
            return F.when(t["found"] > 0, self._weighted(t["h"], t, a) - let(self._shares(t, a), lambda p: t["found"] * self._weighted(p, t, a) / self._total(p, self.n))).otherwise(0.0)

        return F.when(self._sum(lambda t: t["found"]) > 0, self._climb(LOW, HIGH, lambda a: self._sum(lambda t: slope(t, a)) > 0)).otherwise(NAN)

    # --- gamma rates ---

    def _gamma(self, t: Column, d: Column, alpha: Column) -> Column:
        """p[m] at mean rate d and shape alpha."""
        first = F.exp(-alpha * (F.log(1 + d * t["k"] / alpha) + F.log(1 + d * t["kill"] / alpha)))
        ratio = t["wide"] * d / (alpha + d * t["k"])

        def rising(q: Column) -> Column:
            out = [F.lit(1.0)]
            for m in range(1, self.n + 1):
                out.append(out[-1] * (alpha + (m - 1)) / m * F.get(q, F.lit(1)))
            return F.array(*[F.get(q, F.lit(0)) * x for x in out])

        return let(F.array(first, ratio), rising)

    def _gamma_slope(self, t: Column, d: Column, alpha: Column) -> Column:
        def weighted(p: Column) -> Column:
            out = F.lit(0.0)
            for m in range(self.n + 1):
                out = out + F.get(p, F.lit(m)) * (F.lit(float(m)) / d - (alpha + m) * t["k"] / (alpha + d * t["k"]) - alpha * t["kill"] / (alpha + d * t["kill"]))
            return out

        return weighted(t["h"]) - let(self._gamma(t, d, alpha), lambda p: F.when(t["miss"] > 0, t["miss"] * weighted(p) / F.greatest(1 - self._total(p, self.n), F.lit(_TINY))).otherwise(0.0))

    def _gamma_cost(self, t: Column, d: Column, alpha: Column) -> Column:
        def cost(p: Column) -> Column:
            out = F.when(t["miss"] > 0, -t["miss"] * F.log(F.greatest(1 - self._total(p, self.n), F.lit(_TINY)))).otherwise(0.0)
            for m in range(self.n + 1):
                out = out - F.when(F.get(t["h"], F.lit(m)) > 0, F.get(t["h"], F.lit(m)) * F.log(F.greatest(F.get(p, F.lit(m)), F.lit(_TINY)))).otherwise(0.0)
            return out

        return let(self._gamma(t, d, alpha), cost)

    def _best_rate(self, alpha: Column) -> Column:
        return self._climb(RATE_LOW, RATE_HIGH, lambda d: self._sum(lambda t: self._gamma_slope(t, d, alpha)) > 0)

    def _scan(self, logs: Column) -> Column:
        """(cost, place in the grid, log shape, rate) of the best of some log shapes; the first of equals."""

        def one(x: Column, i: Column) -> Column:
            return let(F.struct(F.exp(x).alias("a"), self._best_rate(F.exp(x)).alias("d")), lambda v: F.struct(self._sum(lambda t: self._gamma_cost(t, v["d"], v["a"])).alias("cost"), i.alias("i"), x.alias("log"), v["d"].alias("rate")))

        return F.array_min(F.transform(logs, one))

    def heterogeneous(self, uniform: Column) -> Column:
        """struct(ani, shape): the mean identity under gamma rates, or ``uniform`` and an infinite shape where a second parameter gains too little."""
        lo, hi = math.log(SHAPE_LOW), math.log(SHAPE_HIGH)
        coarse = F.array(*[F.lit(lo + (hi - lo) * i / COARSE) for i in range(COARSE + 1)])
        best = let(self._scan(coarse)["log"], lambda at: self._scan(F.transform(F.sequence(F.lit(0), F.lit(FINE)), lambda i: at - REACH + 2 * REACH * i / FINE)))
        flat_rate = F.lit(UNIFORM_SHAPE)
        flat = let(self._best_rate(flat_rate), lambda d: self._sum(lambda t: self._gamma_cost(t, d, flat_rate)))

        def result(b: Column) -> Column:
            shape = F.exp(b["log"])
            gamma = F.struct(F.pow(1 + b["rate"] / shape, -shape).alias("ani"), shape.alias("shape"))
            return F.when((2 * (flat - b["cost"]) > WORTH) & (shape < 0.99 * SHAPE_HIGH), gamma).otherwise(F.struct(uniform.alias("ani"), F.lit(math.inf).alias("shape")))

        return F.when(F.size(self.s) > 0, let(best, result)).otherwise(F.struct(F.lit(NAN).alias("ani"), F.lit(NAN).alias("shape")))

    # --- the bound ---

    def upper_bound(self) -> Column:
        """The identity whose expected retention is the exact upper bound of the share found; 0.5 and 1.0 where it saturates."""
        share = let(F.struct(self._sum(lambda t: t["found"]).alias("k"), self._sum(lambda t: t["total"]).alias("n")), lambda v: binomial_upper(v["k"], v["n"]))

        def identity(x: Column) -> Column:
            at = lambda a: self.retention(F.lit(a))
            return F.when(x >= 1, 1.0).when(at(LOW) >= x, 0.5).when(at(HIGH) <= x, 1.0).otherwise(self._climb(LOW, HIGH, lambda a: self.retention(a) < x))

        return F.when(F.size(self.s) > 0, let(share, identity)).otherwise(NAN)


def log_gamma(x: Column) -> Column:
    """ln gamma of x >= 1: Stirling's series from x + 8 on, less the factors in between."""
    y = x + 8
    z = 1 / (y * y)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    less = F.lit(0.0)
    for i in range(8):
        less = less + F.log(x + i)
    return series - less


def binomial_upper(found: Column, n: Column, alpha: float = ALPHA) -> Column:
    """The one-sided exact upper bound of a share, by a fold of halvings of the tail P(X <= found).

    The tail is summed downwards from ``found`` in ratios of neighbouring terms;
    beyond ten deviations they add nothing that a double holds.
    """
    width = F.least(found, F.ceil(5 * F.sqrt(n)) + 50).cast("long")

    def above(choose: Column) -> Callable[[Column], Column]:
        def tail(p: Column) -> Column:
            top = choose + found * F.log(p) + (n - found) * F.log(1 - p)
            terms = F.when(width < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("long"), width - 1))
            sums = F.aggregate(terms, F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")), lambda s, i: let(s["term"] * (found - i) / (n - found + i + 1) * (1 - p) / p, lambda t: F.struct((s["sum"] + t).alias("sum"), t.alias("term"))))
            return top + F.log(sums["sum"])

        return lambda p: tail(p) > math.log(alpha)

    def search(choose: Column) -> Column:
        start = found / n
        widths = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: (1 - start) / F.pow(F.lit(2.0), i))
        # at the very end no double lies between p and 1
        return F.aggregate(widths, start, lambda x, w: let(x + w, lambda y: F.when((y < 1) & above(choose)(F.least(y, F.lit(1 - 2.0**-53))), y).otherwise(x)))

    choose = log_gamma(n + 1) - log_gamma(found + 1) - log_gamma(n - found + 1)
    return F.when(n <= 0, NAN).when(found >= n, 1.0).when(found <= 0, 1 - F.pow(F.lit(alpha), 1 / n)).otherwise(let(choose, search))


def dealt(arrays: DataFrame) -> DataFrame:
    """Rows dealt out by number: the work of a fit is out of proportion to its bytes, by which partitions would be put together."""
    spark = arrays.sparkSession
    return arrays.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def once(struct: Column) -> Column:
    """The fields of a struct as columns; the generator keeps the optimizer from copying what makes them into every use."""
    return F.inline(F.array(struct))


def fitted(arrays: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """keys and every estimate of ``arrays`` (keys, s): ani_uniform, std_err, from_loss, from_hist, retention, het, shape, upper, n_tags."""
    f = Fits(F.col("s"), tolerance)

    def all_(a: Column) -> Column:
        return F.struct(
            a.alias("ani_uniform"), f.std_err(a).alias("std_err"), f.from_loss().alias("from_loss"), f.from_histogram().alias("from_hist"), f.retention(a).alias("retention"), f.heterogeneous(a).alias("h"), f.upper_bound().alias("upper"),
            F.aggregate("s", F.lit(0.0), lambda n, t: n + t["total"]).cast("long").alias("n_tags"),
        )

    d = dealt(arrays).select(*keys, once(let(f.uniform(), all_)))
    return d.select(*keys, "ani_uniform", "std_err", "from_loss", "from_hist", "retention", F.col("h.ani").alias("het"), F.col("h.shape").alias("shape"), "upper", "n_tags")


def by_enzyme(arrays: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """keys, enzyme, ani, std_err, n_tags: fits of each enzyme alone, where tags were found and the error is finite."""
    one = dealt(arrays).select(*keys, F.explode("s").alias("t")).where("t.found > 0").select(*keys, F.col("t.enzyme").alias("enzyme"), F.col("t.total").cast("long").alias("n_tags"), F.array("t").alias("s"))
    f = Fits(F.col("s"), tolerance)
    one = one.select(*keys, "enzyme", "n_tags", once(let(f.uniform(), lambda a: F.struct(a.alias("ani"), f.std_err(a).alias("std_err")))))
    return one.where(~F.isnan("std_err") & (F.col("std_err") > 0) & (F.col("std_err") < math.inf))


def agreement(fits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, per_enzyme, enzyme_mean, enzyme_spread, enzyme_chi2 of ``by_enzyme``: the inverse-variance mean, the spread, and Cochran's Q over its degrees of freedom (NaN for one enzyme)."""
    w = 1 / (F.col("std_err") * F.col("std_err"))
    g = fits.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("enzyme", "ani", "std_err", "n_tags"))).alias("per_enzyme"), F.sum(w).alias("_w"), F.sum(w * F.col("ani")).alias("_wx"),
        (F.max("ani") - F.min("ani")).alias("enzyme_spread"), F.count(F.lit(1)).alias("_n"),
    )
    g = g.withColumn("enzyme_mean", F.when(F.col("_n") > 1, F.col("_wx") / F.col("_w")).otherwise(F.get("per_enzyme", F.lit(0))["ani"]))
    q = F.aggregate("per_enzyme", F.lit(0.0), lambda a, t: a + (t["ani"] - F.col("enzyme_mean")) * (t["ani"] - F.col("enzyme_mean")) / (t["std_err"] * t["std_err"]))
    return g.select(*keys, "per_enzyme", "enzyme_mean", "enzyme_spread", F.when(F.col("_n") > 1, q / (F.col("_n") - 1)).otherwise(NAN).alias("enzyme_chi2"))
