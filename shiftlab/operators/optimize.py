"""Search for clustering parameters: trials that are drawn where earlier ones scored well."""

from __future__ import annotations

import math
import random
from collections import ChainMap
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from . import stats
from .masks import top_clusters

#: Clusters that an objective looks at; trials drawn at random before the search is guided; candidates of a guided draw; the share of trials that counts as good.
TOP, STARTUP, CANDIDATES, GOOD = 10, 10, 24, 0.25


@dataclass
class Best:
    score: float
    params: dict[str, Any]
    method: Any
    arguments: dict[str, Any]


def _is_range(p: Any) -> bool:
    return isinstance(p, tuple | list) and len(p) == 2


def sample_params(params: dict[str, Any], rng: random.Random, draw: Callable[[str, float, float], float] | None = None) -> dict[str, Any]:
    """Fixed values as they are; (low, high) drawn evenly, or by `draw`, as a real number if the low end is one, else as an integer."""
    out = {}
    for name, p in params.items():
        if not _is_range(p):
            out[name] = p
            continue
        low, high = p
        whole = not isinstance(low, float)
        if draw is None:
            out[name] = rng.randint(low, math.floor(high)) if whole else rng.uniform(low, high)
        else:
            x = draw(name, low - 0.5 if whole else low, math.floor(high) + 0.5 if whole else high)
            out[name] = min(max(round(x), low), math.floor(high)) if whole else x
    return out


def guided(past: list[tuple[float, dict[str, Any]]], rng: random.Random) -> Callable[[str, float, float], float]:
    """Draws by tree-structured Parzen estimators: `past` holds (score, parameters), larger scores being better; of values drawn from the density of the good trials, the one with the largest ratio to the density of the others."""
    ranked = sorted(past, key=lambda t: -t[0])
    n = max(1, math.ceil(GOOD * len(ranked)))

    def draw(name: str, low: float, high: float) -> float:
        good, rest = ([float(t[1][name]) for t in part] for part in (ranked[:n], ranked[n:]))

        def density(x: float, centres: list[float]) -> float:
            # one kernel for each trial, and one as wide as the range
            width = (high - low) / max(2.0, math.sqrt(len(centres) + 1) * 2)
            return sum(math.exp(-0.5 * ((x - c) / width) ** 2) / width for c in centres) + math.exp(-0.5 * ((x - (low + high) / 2) / (high - low)) ** 2) / (high - low)

        if high <= low:
            return low
        width = (high - low) / max(2.0, math.sqrt(len(good) + 1) * 2)
        found = []
        while len(found) < CANDIDATES:
            k = rng.randrange(len(good) + 1)
            x = rng.uniform(low, high) if k == len(good) else rng.gauss(good[k], width)
            if low <= x <= high:
                found.append(x)
        return max(found, key=lambda x: density(x, good) / density(x, rest))

    return draw


def _mean(df, how: str = "mean") -> float:
    value = stats.aggregate_scores(df, how).first()[0]
    return float("nan") if value is None else float(value)


def _base(cube: Any) -> str:
    """The base variable of the trial's clusters; of a cube without a trial, the only one there is."""
    return cube.get_base_var("trial" if "trial" in cube.catalog else None)


def combined_spatial_nonlinearity(cube: Any, labels: Any, weights: tuple[float, float] = (1.0, 1.0)) -> float:
    """The weighted sum of the medians of spatial autocorrelation and nonlinearity of the first ten clusters."""
    own, var = top_clusters(labels, TOP), _base(cube)
    a = _mean(stats.score_spatial_autocorrelation(cube.grid, var, own), "median")
    b = _mean(stats.score_nonlinearity(cube.grid, var, own, cube.times), "median")
    return weights[0] * a + weights[1] * b


def _score(name: str, how: str) -> Callable[[Any, Any], float]:
    def run(cube: Any, labels: Any) -> float:
        own, var = top_clusters(labels, TOP), _base(cube)
        each = {
            "heaviside": lambda: stats.score_heaviside(cube.grid, var, own, cube.times, how=how),
            "consistency": lambda: stats.score_consistency(cube.grid, var, own),
            "autocorrelation": lambda: stats.score_spatial_autocorrelation(cube.grid, var, own),
            "nonlinearity": lambda: stats.score_nonlinearity(cube.grid, var, own, cube.times),
        }[name]()
        return _mean(each, how)

    return run


#: `median_heaviside` scores the median series of each cluster and takes the median of the scores, the others the mean of both.
OBJECTIVES: dict[str, Callable[[Any, Any], float]] = {
    "median_heaviside": _score("heaviside", "median"),
    "mean_heaviside": _score("heaviside", "mean"),
    "mean_consistency": _score("consistency", "mean"),
    "mean_spatial_autocorrelation": _score("autocorrelation", "mean"),
    "mean_nonlinearity": _score("nonlinearity", "mean"),
    "combined_spatial_nonlinearity": combined_spatial_nonlinearity,
}


def optimise(cube: Any, var: str, method: Any, params: dict[str, Any], objective: str | Callable[[Any, Any], float], n_trials: int, direction: str, arguments: dict[str, Any], seed: int = 0) -> Best:
    """The best of `n_trials` trials. Parameters that name a field of the method go to it, the others to the clustering call. A trial without clusters is the worst."""
    if direction not in ("maximize", "minimize"):
        raise ValueError("direction is maximize or minimize")
    score_of = objective if callable(objective) else OBJECTIVES.get(objective)
    if score_of is None:
        raise ValueError(f"unknown objective {objective!r}; there are {sorted(OBJECTIVES)}")
    rng, sign, best = random.Random(seed), 1 if direction == "maximize" else -1, None
    past: list[tuple[float, dict[str, Any]]] = []
    shifts = cube.tables[var].persist()  # every trial reads them
    cube = replace(cube, tables=ChainMap({var: shifts}, cube.tables))
    try:
        for i in range(n_trials):
            drawn = sample_params(params, rng, guided(past, rng) if i >= STARTUP else None)
            own = {k: v for k, v in drawn.items() if hasattr(method, k)}
            trial = replace(method, **own) if own else method
            call = {**arguments, **{k: v for k, v in drawn.items() if k not in own}}
            out = cube.compute_clusters(var, trial, output_label="trial", overwrite=True, **call)
            labels = out.tables["trial"].persist()
            try:
                score = -float("inf") * sign if labels.where("cluster >= 0").isEmpty() else float(score_of(out, labels))
            finally:
                labels.unpersist()
            past.append((sign * score if not math.isnan(score) else -float("inf"), drawn))
            if best is None or sign * score > sign * best.score:
                best = Best(score, drawn, trial, call)
    finally:
        shifts.unpersist()
    if best is None:
        raise ValueError("n_trials must be 1 at least")
    return best
