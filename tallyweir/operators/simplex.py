"""Search for long-only weights over a split's scenarios: one task holds a split's days times assets, and all splits run at once.

A round scores every transfer from one asset to another at all step sizes together, and some fixed random directions for kinks where no
single transfer helps. A transfer changes the days' returns by step * (r_j - r_i), so candidates are never multiplied out again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import EPS, SPLIT, TAIL

#: Score of portfolios: (their returns, k x days; their weights, k x assets; the scenarios, assets x days) -> k scores.
Score = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Transfers are scored so many at a time, so memory is bounded by days times this.
BLOCK = 256
#: Rounds after which a search has failed.
ROUNDS = 2000


def quantiles(losses: np.ndarray, tail: float = TAIL) -> np.ndarray:
    """Quantile of each row, linear between ranks."""
    at = (losses.shape[1] - 1) * tail
    lo = int(at)
    hi = min(lo + 1, losses.shape[1] - 1)
    ranked = np.partition(losses, [lo, hi], axis=1)
    return ranked[:, lo] + (at - lo) * (ranked[:, hi] - ranked[:, lo])


def cdar(p: np.ndarray, w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Mean of the drawdowns at or above their quantile. Wealth before the first day is no point of the path."""
    wealth = np.cumprod(1.0 + p, axis=1)
    down = 1.0 - wealth / np.maximum(np.maximum.accumulate(wealth, axis=1), EPS)
    hit = down >= quantiles(down)[:, None] - 1e-15
    return (down * hit).sum(axis=1) / hit.sum(axis=1)


def cvar_budget(p: np.ndarray, w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Mean squared relative distance of the tail contributions from equal ones, plus a thousandth of the CVaR."""
    hit = (-p >= quantiles(-p)[:, None] - 1e-15).astype(float)
    share = -(hit @ r.T) / hit.sum(axis=1, keepdims=True) * w
    base = np.maximum(share.sum(axis=1), EPS)
    return np.mean((share / base[:, None] - 1 / w.shape[1]) ** 2, axis=1) + 1e-3 * base


def mean_risk(mean: np.ndarray, cov: np.ndarray, aversion: float = 8.0) -> Score:
    return lambda p, w, r: aversion * np.einsum("ka,ab,kb->k", w, cov, w) - w @ mean


def shrunk_inputs(r: np.ndarray, own: float = 0.35) -> tuple[np.ndarray, np.ndarray]:
    """Means drawn to their mean and the Ledoit-Wolf covariance of scenarios (assets x days)."""
    means = r.mean(axis=1)
    x = r - means[:, None]
    a, t = x.shape
    s = x @ x.T / t
    mu = np.trace(s) / a
    d2 = (np.sum(s * s) - 2 * mu * np.trace(s) + a * mu * mu) / a
    b2 = min(d2, max(0.0, (np.mean(np.sum(x * x, axis=0) ** 2) - np.sum(s * s)) / (a * t)))
    lam = b2 / d2 if b2 > 0 else 0.0
    return own * means + (1 - own) * means.mean(), (1 - lam) * s + lam * mu * np.eye(a)


def pair_search(r: np.ndarray, score: Score, starts: list[np.ndarray], last: float = 1e-4, directions: int = 24, seed: int = 5) -> tuple[np.ndarray, float, int]:
    """The best weights for scenarios r (assets x days) from starts, their score and the most rounds a start took (ROUNDS if it did not end).

    A round takes the best step of 1/4, 1/16 and so on, the smallest at most last, over all pairs (one gives what it has at most), and where none is better over random directions.
    With many pairs these come in blocks, the steepest first, and the first block that has a better step ends the round;
    a search ends only when none of all pairs and directions is better.
    """
    n = len(r)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
    i, j = i[i != j], j[i != j]
    steps = 0.25**np.arange(1, max(1, int(np.ceil(np.log(last) / np.log(0.25)))) + 1)
    rng = np.random.default_rng(seed)
    best, best_w, most = np.inf, starts[0], 0
    for start in starts:
        w = start / start.sum()
        now = float(score((w @ r)[None, :], w[None, :], r)[0])
        for k in range(ROUNDS):
            most = max(most, k)
            found = _best_step(r, score, w, now, i, j, steps, rng.standard_normal((directions, n)))
            if found is None:
                break
            w, now = found
        else:
            most = ROUNDS
        if now < best:
            best, best_w = now, w
    return best_w, best, most


def _best_step(r, score, w, now, i, j, steps, drawn):
    """The best better (weights, score) of a round, or None."""
    p, enough = w @ r, now - 1e-12 * max(1.0, abs(now))
    has = w[i] > 0
    i, j = i[has], j[has]
    if len(i) * len(steps) > BLOCK:
        towards = w + steps[-1] * (np.eye(len(w)) - w)
        up = score(towards @ r, towards, r)
        order = np.argsort(up[j] - up[i], kind="stable")
        i, j = i[order], j[order]
    per = max(1, BLOCK // len(steps))
    for at in range(0, len(i), per):
        a, b = np.tile(i[at : at + per], len(steps)), np.tile(j[at : at + per], len(steps))
        h = np.minimum(np.repeat(steps, len(i[at : at + per])), w[a])
        moved = np.repeat(w[None, :], len(h), axis=0)
        k = np.arange(len(h))
        moved[k, a] -= h
        moved[k, b] += h
        s = score(p + h[:, None] * (r[b] - r[a]), moved, r)
        one = int(np.argmin(np.where(np.isfinite(s), s, np.inf)))
        if s[one] < enough:
            best = np.maximum(moved[one], 0.0)
            return best / best.sum(), float(s[one])
    drawn = drawn - drawn.mean(axis=1, keepdims=True)
    drawn /= np.abs(drawn).sum(axis=1, keepdims=True)
    moved = np.maximum(w + (drawn[:, None, :] * steps[None, :, None]).reshape(-1, len(w)), 0.0)
    moved /= moved.sum(axis=1, keepdims=True)
    s = score(moved @ r, moved, r)
    one = int(np.argmin(np.where(np.isfinite(s), s, np.inf)))
    return (moved[one], float(s[one])) if s[one] < enough else None


def by_day(rows: DataFrame) -> DataFrame:
    """SPLIT, obs_no, assets, r: a day's returns in asset order."""
    day = F.array_sort(F.collect_list(F.struct("asset", "ret")))
    return rows.groupBy(*SPLIT, "obs_no").agg(day.alias("x")).select(*SPLIT, "obs_no", F.col("x.asset").alias("assets"), F.col("x.ret").alias("r"))


def searched(rows: DataFrame, starts: DataFrame, score: Callable[[np.ndarray], Score], last: float = 1e-4, every_start: bool = False) -> DataFrame:
    """SPLIT, asset, weight, score, rounds, status of every split's best end from its starts (SPLIT, start, w in asset order).

    score makes the score from a split's scenarios; equal weights are a start of every split. Only the start of the best score is searched from, or
    every_start. A split that lacks an asset on some day or holds a return that is no number is NOT_EVALUABLE, one that does not
    end is SOLVER_FAILED; both have null weights.
    """
    def one(key, days: pa.Table, begin: pa.Table) -> pa.Table:
        days = days.sort_by("obs_no")
        assets = days.column("assets")[0].as_py()
        flat = days.column("r").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        weights, value, rounds, status = [None] * len(assets), None, 0, "OK"
        if len(flat) != days.num_rows * len(assets) or not np.isfinite(flat).all() or len({tuple(a) for a in days.column("assets").to_pylist()}) > 1:
            status = "NOT_EVALUABLE"
        else:
            r = np.ascontiguousarray(flat.reshape(days.num_rows, len(assets)).T)
            first = [np.full(len(assets), 1 / len(assets))] + [np.asarray(w, float) for w in begin.column("w").to_pylist() if w is not None and len(w) == len(assets) and np.isfinite(np.asarray(w, float)).all()]
            of = score(r)
            if not every_start:
                ready = np.array(first)
                first = [first[int(np.argmin(of(ready @ r, ready, r)))]]
            best, value, rounds = pair_search(r, of, first, last)
            status = "OK" if rounds < ROUNDS and np.isfinite(value) else "SOLVER_FAILED"
            if status == "OK":
                weights = best.tolist()
        n = len(assets)
        keys = [pa.array([k.as_py()] * n, type_) for k, type_ in zip(key, (pa.string(), pa.int32(), pa.string()), strict=True)]
        return pa.table([*keys, pa.array(assets, pa.string()), pa.array(weights, pa.float64()), pa.array([value] * n, pa.float64()), pa.array([rounds] * n, pa.int32()), pa.array([status] * n, pa.string())], names=[*SPLIT, "asset", "weight", "score", "rounds", "status"])

    schema = "panel_id string, split_no int, split_id string, asset string, weight double, score double, rounds int, status string"
    return by_day(rows).groupBy(*SPLIT).cogroup(starts.select(*SPLIT, "w").groupBy(*SPLIT)).applyInArrow(one, schema)
