"""The comparison of one pair as a plain programme: what the plans of fill and compare are held against."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from tagloom.operators.chain import Config, gap_penalty
from tagloom.operators.enzymes import Enzyme
from tests import fits_by_numpy as est
from tests.fits_by_numpy import NAN, Stratum

MIN_RETENTION = 0.20


@dataclass
class Chain:
    q_contig: int
    r_contig: int
    orient: str
    q: np.ndarray
    r: np.ndarray
    spans: tuple[int, int, int, int] = (0, 0, 0, 0)
    anchors: int = field(default=0)


def best_chains(q: np.ndarray, r: np.ndarray, rank: np.ndarray, max_skip: float, cfg: Config) -> list[np.ndarray]:
    """Chains of a group of anchors (sorted by q, then r; r signed so that it must rise), as arrays of places.

    The best-scoring path is taken and its anchors die; then the programme runs
    again on those alive, which look back over the same ``dp_window`` places,
    dead ones included.
    """
    n = len(q)
    alive, out = np.ones(n, bool), []
    w = cfg.dp_window
    while alive.any():
        score, back = np.where(alive, 1.0, -np.inf), np.full(n, -1)
        for i in np.flatnonzero(alive):
            j = np.arange(max(0, i - w), i)
            dq, dr, skip = q[i] - q[j], r[i] - r[j], np.maximum(rank[i] - rank[j] - 1, 0)
            ok = alive[j] & (dq > 0) & (dr > 0) & (dq <= cfg.max_gap) & (dr <= cfg.max_gap) & (skip <= max_skip)
            if ok.any():
                s = np.where(ok, score[j] + 1 - gap_penalty(np.abs(dq - dr)), -np.inf)
                # of equal ones the farthest stays
                k = int(np.argmax(s))
                if s[k] > score[i]:
                    score[i], back[i] = s[k], j[k]
        end = int(np.argmax(score))
        if score[end] < cfg.min_chain_anchors:
            break
        path = []
        while end >= 0:
            path.append(end)
            end = back[end]
        alive[path] = False
        if len(path) >= cfg.min_chain_anchors:
            out.append(np.array(path[::-1]))
    return out


def median_gap(x: np.ndarray) -> int:
    """The upper median of the steps."""
    return int(np.sort(np.abs(np.diff(x)))[(len(x) - 1) // 2]) if len(x) > 1 else 0


def extend_span(lo: int, hi: int, by: int, length: int) -> tuple[int, int]:
    by = min(by, 10_000)
    return max(0, lo - by), min(hi + by, length) if length else hi + by


def covered(spans: list[tuple[int, int, int]]) -> int:
    """Base pairs in the union of (contig, start, end); touching spans are one."""
    total, last, to = 0, None, 0
    for c, a, b in sorted(spans):
        if c != last or a > to:
            total += b - a
            last, to = c, b
        elif b > to:
            total += b - to
            to = b
    return total


class Pair:
    """One genome pair: tags as arrays, anchors grouped by (q_contig, r_contig, orient)."""

    def __init__(self, q: pd.DataFrame, r: pd.DataFrame, anchors: pd.DataFrame, panel: list[Enzyme], cfg: Config) -> None:
        self.cfg, self.panel = cfg, {e.name: e for e in panel}
        self.q, self.anchors = q.reset_index(drop=True), anchors
        self.q_len = dict(zip(q.contig, q.contig_len))
        self.r_len = dict(zip(r.contig, r.contig_len))
        self.q_total, self.r_total = (int(x.genome_len.iloc[0]) if len(x) else 0 for x in (q, r))
        self.spacing = self.q_total / max(len(q), 1)
        rank = {(c, p): k for c, p, k in zip(q.contig, q.position, q["rank"])}
        self.groups = {}
        for key, g in anchors.groupby(["q_contig", "r_contig", "orient"], sort=True):
            sign = -1 if key[2] == "-" else 1
            g = g.assign(s=g.r_pos * sign).sort_values(["q_pos", "s"], kind="stable")
            self.groups[key] = (g.q_pos.to_numpy(), g.r_pos.to_numpy(), g.s.to_numpy(), np.array([rank[key[0], p] for p in g.q_pos]), g.mm.to_numpy(), g.uniq.to_numpy(bool))
        letters = lambda tags: np.array([np.frombuffer(t.encode(), np.uint8) for t in tags])
        flip = np.arange(256, dtype=np.uint8)
        flip[[65, 67, 71, 84]] = [84, 71, 67, 65]
        self.ref: dict = {}
        for (e, c), g in r.sort_values("position", kind="stable").groupby(["enzyme", "contig"], sort=False):
            fwd = letters(g.tag)
            self.ref[e, c] = (g.position.to_numpy(), {"+": fwd, "-": flip[fwd[:, ::-1]]})
        self.qry: dict = {}
        for (e, c), g in self.q.sort_values("position", kind="stable").groupby(["enzyme", "contig"], sort=False):
            self.qry[e, c] = (g.position.to_numpy(), letters(g.tag), g.index.to_numpy())
        self.q_anchor_places = {c: np.unique(g.r_pos.to_numpy()) for c, g in anchors.groupby("r_contig")}

    def chains(self, max_skip: float) -> list[Chain]:
        out = []
        for (qc, rc, o), (q, r, s, rank, _, _) in self.groups.items():
            out += [Chain(qc, rc, o, q[p], r[p]) for p in best_chains(q, s, rank, max_skip, self.cfg)]
        return sorted(out, key=lambda c: (-len(c.q), c.q_contig, c.q[0], c.r_contig, c.r[0], c.orient))

    def _best(self, enzyme: str, r_contig: int, orient: str, tag: np.ndarray, at: float) -> int:
        """Fewest mismatches with a reference tag within the window of a place."""
        pos, tags = self.ref.get((enzyme, r_contig), (None, None))
        if pos is None:
            return 99
        a, b = np.searchsorted(pos, max(0, int(max(at - self.cfg.local_window, 0)))), np.searchsorted(pos, int(max(at + self.cfg.local_window, 0)), side="right")
        return int((tags[orient][a:b] != tag).sum(1).min()) if b > a else 99

    def rescue_bases(self) -> dict[int, tuple]:
        """A reference place for each short contig: its collinear group with the most unique anchors."""
        count = self.q.groupby("contig").size()
        short: dict[int, list] = defaultdict(list)
        for (qc, rc, o), g in self.groups.items():
            if count.get(qc, 0) < 8 * self.cfg.min_chain_anchors:
                u = g[5]
                if u.sum() >= 2 and (g[4][u] <= 1).any():
                    short[qc].append((int(u.sum()), -int(g[4][u].sum()), rc, o, g[0][u], g[1][u], g[2][u]))
        out = {}
        for qc, found in short.items():
            _, _, rc, o, q, r, s = max(found, key=lambda x: (x[0], x[1]))
            if (np.diff(s) > 0).all() and (np.abs(np.diff(q - s)) <= self.cfg.max_gap).all():
                out[qc] = (rc, o, q, r)
        return out

    def _bracket(self, r_contig: int, edge: int, way: int) -> int | None:
        """Distance from an edge to the next anchor of the reference contig in one direction."""
        x = self.q_anchor_places.get(r_contig, np.zeros(0, np.int64))
        k = np.searchsorted(x, edge, side="right" if way > 0 else "left")
        if way > 0:
            return int(x[k] - edge) if k < len(x) else None
        return int(edge - x[k - 1]) if k else None

    def fill(self, chains: list[Chain], max_skip: float) -> tuple[list[Stratum], list, list]:
        """Test every query tag in a chain's span, the largest chain first, against the reference tags near its place."""
        cfg, tol = self.cfg, self.cfg.tolerance
        hist = {e: [0] * (tol + 2) for e in self.panel}
        claimed = np.zeros(len(self.q), bool)
        q_spans, r_spans = [], []

        def count(enzyme: str, best: int) -> None:
            hist[enzyme][best if best <= tol else tol + 1] += 1

        for c in chains:
            up = np.argsort(c.r, kind="stable")
            r_lo, r_hi = int(c.r[up[0]]), int(c.r[up[-1]])
            qa, qb = extend_span(int(c.q[0]), int(c.q[-1]), median_gap(c.q) // 2, self.q_len.get(c.q_contig, 0))
            ra, rb = extend_span(r_lo, r_hi, median_gap(c.r) // 2, self.r_len.get(c.r_contig, 0))
            c.spans, c.anchors = (qa, qb, ra, rb), len(c.q)
            q_spans.append((c.q_contig, qa, qb))
            r_spans.append((c.r_contig, ra, rb))
            for e in sorted(self.panel):
                pos, tags, index = self.qry.get((e, c.q_contig), (np.zeros(0, np.int64), None, None))
                a, b = np.searchsorted(pos, c.q[0]), np.searchsorted(pos, c.q[-1], side="right")
                for k in range(a, b):
                    if not claimed[index[k]]:
                        claimed[index[k]] = True
                        count(e, self._best(e, c.r_contig, c.orient, tags[k], float(np.interp(pos[k], c.q, c.r))))
        if cfg.rescue:
            tail = math.inf if math.isinf(max_skip) else (max_skip + 1) * self.spacing
            for contig, (rc, o, q, r) in sorted(self.rescue_bases().items()):
                sign = -1 if o == "-" else 1
                reach = {-1: 0, 1: 0}
                limit = {side: self._bracket(rc, int(r[0 if side < 0 else -1]), sign * side) for side in (-1, 1)}
                any_ = False
                for e in sorted(self.panel):
                    pos, tags, index = self.qry.get((e, contig), (np.zeros(0, np.int64), None, None))
                    for k in range(len(pos)):
                        if claimed[index[k]]:
                            continue
                        side = -1 if pos[k] < q[0] else 1 if pos[k] > q[-1] else 0
                        out = int(q[0] - pos[k]) if side < 0 else int(pos[k] - q[-1]) if side else 0
                        if side and (limit[side] is None or limit[side] > tail or out > limit[side]):
                            continue
                        at = float(np.interp(pos[k], q, r)) if not side else float(r[0 if side < 0 else -1] + side * sign * out)
                        claimed[index[k]], any_ = True, True
                        if side:
                            reach[side] = max(reach[side], out)
                        count(e, self._best(e, rc, o, tags[k], max(int(at), 0)))
                if any_:
                    left, right = reach[-1], reach[1]
                    q_spans.append((contig, *extend_span(int(q[0]) - left, int(q[-1]) + right, median_gap(q) // 2, self.q_len.get(contig, 0))))
                    lo, hi = (right, left) if o == "-" else (left, right)
                    r_spans.append((rc, *extend_span(max(0, int(r.min()) - lo), int(r.max()) + hi, median_gap(r) // 2, self.r_len.get(rc, 0))))
        strata = [Stratum(e, min(p.tag_len, 32), p.exact_site, p.d2, p.d3, tuple(hist[e][: tol + 1]), hist[e][tol + 1]) for e, p in sorted(self.panel.items()) if sum(hist[e])]
        return strata, q_spans, r_spans

    def raw_strata(self) -> list[Stratum]:
        """All rare query tags, found if they have an anchor, as one bin."""
        rare = self.q[self.q.n <= self.cfg.max_occurrence]
        has = set(zip(self.anchors.q_contig, self.anchors.q_pos, self.anchors.enzyme))
        out = []
        for e, g in rare.groupby("enzyme"):
            found = sum((c, p, e) in has for c, p in zip(g.contig, g.position))
            s = self.panel[e]
            out.append(Stratum(e, min(s.tag_len, 32), s.exact_site, s.d2, s.d3, (found,) + (0,) * self.cfg.tolerance, len(g) - found))
        return out

    def synteny(self, chains: list[Chain]) -> dict:
        n = len(self.anchors)
        sizes = [len(c.q) for c in chains]
        if not chains or n < 2:
            return {"synteny_blocks": 0, "synteny_score": 0.0, "breakpoint_count": 0, "unconserved": 0, "max_block_anchors": 0, "mean_block_anchors": 0.0}
        contigs = len({c.q_contig for c in chains})
        kept, possible = sum(sizes) - len(sizes), sum(sizes) - contigs
        return {"synteny_blocks": len(chains), "synteny_score": kept / possible if possible > 0 else 0.0, "breakpoint_count": len(chains) - contigs, "unconserved": n - self.anchors.q_contig.nunique() - kept, "max_block_anchors": max(sizes), "mean_block_anchors": sum(sizes) / len(sizes)}

    def result(self) -> dict:
        chains = self.chains(math.inf) if len(self.anchors) else []
        if not chains:
            return self._row([], [], [], [], est.upper_bound(self.raw_strata()))
        strata, qs, rs = self.fill(chains, math.inf)
        fit = est.estimate(strata)
        p = est.retention(strata, fit.ani)
        if self.cfg.adaptive_gap and math.isfinite(p) and 0 < p < 1:
            skip = max(5.0, math.ceil(math.log(self.cfg.gap_alpha) / math.log1p(-p)))
            again = self.chains(skip)
            if again:
                s2, q2, r2 = self.fill(again, skip)
                if math.isfinite(est.estimate(s2).ani):
                    chains, strata, qs, rs = again, s2, q2, r2
        return self._row(chains, strata, qs, rs, est.upper_bound(strata))

    def _row(self, chains: list[Chain], strata: list[Stratum], qs: list, rs: list, upper: float) -> dict:
        fit = est.estimate(strata)
        het, shape = est.estimate_heterogeneous(strata) if strata else (NAN, NAN)
        gated, fallback = est.gated(het, fit.ani, fit.from_loss, fit.from_hist)
        kept = est.retention(strata, fit.ani) if strata else NAN
        agree, syn, n = est.agreement(strata), self.synteny(chains), len(self.anchors)
        below = not math.isfinite(kept) or kept < MIN_RETENTION
        unreliable = not chains or fallback or syn["unconserved"] / max(n, 1) > 0.5
        return syn | {
            "ani_het": het, "ani_uniform": fit.ani, "ani_gated": gated, "gate_fallback": fallback, "ani_upper95": upper, "std_err": fit.std_err, "het_shape": shape, "retention": kept,
            "ani_from_loss": fit.from_loss, "ani_from_hist": fit.from_hist, "inconsistent": fit.inconsistent, "below_detection": below, "unreliable": unreliable,
            "af_query": covered(qs) / max(self.q_total, 1), "af_reference": covered(rs) / max(self.r_total, 1),
            "n_anchors": n, "n_chains": len(chains), "n_tags": fit.n_tags, "enzyme_mean": agree["mean"], "enzyme_spread": agree["spread"], "enzyme_chi2": agree["chi2"], "per_enzyme": agree["fits"],
            "strata": [{"enzyme": s.enzyme, "tag_len": s.k, "body_len": s.body, "exact_site": s.exact, "d2": s.d2, "d3": s.d3, "hist": list(s.hist), "n_miss": s.miss} for s in strata],
            "chains": [{"chain_id": k, "q_contig": c.q_contig, "r_contig": c.r_contig, "orient": c.orient, "q_start": c.spans[0], "q_end": c.spans[1], "r_start": c.spans[2], "r_end": c.spans[3], "n_anchors": len(c.q), "anchors": [{"q_pos": int(a), "r_pos": int(b)} for a, b in zip(c.q, c.r)]} for k, c in enumerate(chains)],
        }
