"""Panel scoring from strata: error of the estimate for each enzyme, for named panels, and greedily."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators import fits
from tagloom.operators.anchors import TOLERANCE


def estimates(strata: DataFrame, panels: dict[str, list[str] | None], tolerance: int = TOLERANCE) -> DataFrame:
    """query, reference, panel, ani (percent): the heterogeneous fit on each panel's strata (None: all enzymes); NaN where a pair has none of them."""
    arrays = fits.gathered(strata, ["query", "reference"], tolerance)
    own = lambda names: F.col("s") if names is None else F.filter("s", lambda t: t["enzyme"].isin(names))
    rows = arrays.select("query", "reference", F.inline(F.array(*[F.struct(F.lit(n).alias("panel"), own(names).alias("s")) for n, names in panels.items()])))
    f = fits.Fits(F.col("s"), tolerance)
    ani = fits.let(f.uniform(), f.heterogeneous)["ani"]
    return fits.dealt(rows).select("query", "reference", "panel", fits.once(F.struct((100 * ani).alias("ani"))))


def score(estimated: DataFrame, truth: DataFrame) -> DataFrame:
    """panel, n, mae, bias over the pairs with a truth and a finite estimate; panels without any have n 0."""
    j = estimated.join(truth, ["query", "reference"], "left").withColumn("error", F.when(F.col("truth").isNotNull() & ~F.isnan("ani"), F.col("ani") - F.col("truth")))
    return j.groupBy("panel").agg(F.count("error").alias("n"), F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("bias"))


def singles(strata: DataFrame, truth: DataFrame) -> DataFrame:
    """Each enzyme alone, the best first; those without a finite estimate of a pair with a truth are left out."""
    return score(estimates(strata, {n: [n] for n in enzymes(strata)}), truth).where("n > 0").orderBy("mae", "panel")


def enzymes(strata: DataFrame) -> list[str]:
    return sorted(r.enzyme for r in strata.select("enzyme").distinct().collect())  # at most the registry's


def named(strata: DataFrame, truth: DataFrame, spec: str) -> DataFrame:
    """The panels of a list like ``A,B;C``, in its order (place from 0); those that cannot be scored have n 0 and nulls."""
    panels = {text: [x.strip() for x in text.split(",") if x.strip()] for text in spec.split(";")}
    places = F.create_map(*[x for k, text in enumerate(panels) for x in (F.lit(text), F.lit(k))])
    return score(estimates(strata, panels), truth).withColumn("place", places[F.col("panel")])


@dataclass(frozen=True)
class Step:
    added: str
    mae: float
    bias: float
    improved: bool
    panel: tuple[str, ...]


def greedy(strata: DataFrame, truth: DataFrame) -> list[Step]:
    """Forward selection: at each step the enzyme that makes the error least, until all are in; steps that do not better the best one so far are marked.

    A driver loop over a few aggregate rows a step; the fits of a step are one plan.
    """
    if truth.count() < 200:
        warnings.warn("fewer than 200 truth pairs: the selection may follow noise", stacklevel=2)
    left = enzymes(strata)
    path: list[Step] = []
    best = float("inf")
    while left:
        chosen = path[-1].panel if path else ()
        rows = [r for r in score(estimates(strata, {n: [*chosen, n] for n in left}), truth).collect() if r.n]
        if not rows:
            break
        r = min(rows, key=lambda r: (r.mae, r.panel))
        path.append(Step(r.panel, r.mae, r.bias, r.mae < best, tuple(sorted((*chosen, r.panel)))))
        best = min(best, r.mae)
        left.remove(r.panel)
    return path


def report(strata: DataFrame, truth: DataFrame, panels: str | None = None, select: bool = False) -> list[str]:
    """The lines of a panel report: what there is, each enzyme alone, the named panels and the greedy path. No pair with a truth is an error."""
    pairs = strata.select("query", "reference").distinct()
    n, known, own = pairs.count(), pairs.join(truth, ["query", "reference"], "left_semi").count(), enzymes(strata)
    out = [f"{n} pairs ({known} with truth), {len(own)} enzymes: {','.join(own)}"]
    if not known:
        raise ValueError("no pair of the strata has a truth: look at the key columns")
    row = lambda name, r, wide: f"  {name:<{wide}}{r.mae:>9.4f}{r.bias:>+9.4f}{r.n:>7}" if r.n else f"  {name:<{wide}}{'n/a':>9}"
    out += ["", "each enzyme alone:", f"  {'enzyme':<10}{'MAE':>9}{'bias':>9}{'n':>7}", *[row(r.panel, r, 10) for r in singles(strata, truth).collect()]]
    if panels:
        out += ["", "named panels:", f"  {'panel':<44}{'MAE':>9}{'bias':>9}{'n':>7}", *[row(r.panel, r, 44) for r in named(strata, truth, panels).orderBy("place").collect()]]
    if select:
        out += ["", "greedy path (* did not better the best so far):"]
        out += [f"  {k:<5}{s.added:<12}{s.mae:>9.4f}{s.bias:>+9.4f} {' ' if s.improved else '*'} {','.join(s.panel)}" for k, s in enumerate(greedy(strata, truth), 1)]
    return out


def stratified_sample(pairs: DataFrame, band: str, group: str, per_cell: int, order: list[str]) -> DataFrame:
    """At most ``per_cell`` pairs of each band and group, in the order of given columns (a hash makes it random but repeatable)."""
    return pairs.withColumn("nth", F.row_number().over(Window.partitionBy(band, group).orderBy(*order))).where(F.col("nth") <= per_cell)
