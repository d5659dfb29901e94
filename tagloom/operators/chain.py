"""The collinear chains of one run of anchors: the sequential part of a comparison."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Config:
    tolerance: int = 2
    min_chain_anchors: int = 4
    max_gap: int = 50_000
    local_window: int = 3000
    dp_window: int = 60
    gap_alpha: float = 1e-6
    adaptive_gap: bool = True
    rescue: bool = True
    max_occurrence: int = 5


def gap_penalty(d: np.ndarray) -> np.ndarray:
    return 0.0005 * d + 0.05 * np.log2(d + 1.0)


def best_chains(q: np.ndarray, r: np.ndarray, rank: np.ndarray, max_skip: float, cfg: Config) -> list[np.ndarray]:
    """Chains of a run of anchors (sorted by q, then r; r signed so that it must rise), as arrays of places.

    The best-scoring path is taken and its anchors die; then the best of those
    alive, who look back over the same ``dp_window`` places, dead ones included.
    A death changes only the anchors whose best path led through it, so these
    alone are scored again, in order, and a heap holds the ends.
    """
    n, w = len(q), cfg.dp_window
    alive, score, back = np.ones(n, bool), np.ones(n), np.full(n, -1)

    def rescore(i: int) -> None:
        lo = max(0, i - w)
        dq, dr = q[i] - q[lo:i], r[i] - r[lo:i]
        ok = alive[lo:i] & (dq > 0) & (dr > 0) & (dq <= cfg.max_gap) & (dr <= cfg.max_gap) & (rank[i] - rank[lo:i] - 1 <= max_skip)
        score[i], back[i] = 1.0, -1
        if ok.any():
            s = np.where(ok, score[lo:i] + 1 - gap_penalty(np.abs(dq - dr)), -np.inf)
            # of equal ones the farthest stays
            k = int(np.argmax(s))
            if s[k] > 1:
                score[i], back[i] = s[k], lo + k

    for i in range(n):
        rescore(i)
    ends = [(-x, i) for i, x in enumerate(score.tolist())]
    heapq.heapify(ends)
    out = []
    while ends:
        cost, end = heapq.heappop(ends)
        if not alive[end] or -cost != score[end]:
            continue  # dead, or scored again since
        if score[end] < cfg.min_chain_anchors:
            break
        path = []
        while end >= 0:
            path.append(end)
            end = int(back[end])
        alive[path] = False
        if len(path) >= cfg.min_chain_anchors:
            out.append(np.array(path[::-1]))
        # what leaned on the path, and what leans on that
        touched = [i for j in path for i in (j + 1 + np.flatnonzero(back[j + 1 : j + 1 + w] == j)).tolist()]
        heapq.heapify(touched)
        last = -1
        while touched:
            i = heapq.heappop(touched)
            if i == last or not alive[i]:
                continue
            last = i
            rescore(i)
            heapq.heappush(ends, (-float(score[i]), i))
            for k in (i + 1 + np.flatnonzero(back[i + 1 : i + 1 + w] == i)).tolist():
                heapq.heappush(touched, k)
    return out
