"""Suggestions of points to try, from densities over good and poor trials."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence


class Density:
    """A mixture of normals cut off at the bounds: one about each observation, and a wide one over all.

    A normal is as wide as the larger distance to its neighbours (bounds count), but not
    narrower than a share of the range that falls with the number of observations."""

    def __init__(self, seen: Sequence[float], low: float, high: float):
        self.low, self.high = low, high
        at = sorted([*seen, (low + high) / 2])
        middle = at.index((low + high) / 2)
        edges = [low, *at, high]
        least = (high - low) / min(100, len(at) + 1)
        self.at = at
        self.wide = [min(high - low, max(least, b - a, c - b)) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)]
        self.wide[middle] = high - low

    def draw(self, rng: random.Random) -> float:
        i = rng.randrange(len(self.at))
        while True:
            x = rng.gauss(self.at[i], self.wide[i])
            if self.low <= x <= self.high:
                return x

    def log(self, x: float) -> float:
        upto = lambda v, m, s: math.erf((v - m) / (s * math.sqrt(2))) / 2
        inside = [math.exp(-(((x - m) / s) ** 2) / 2) / (s * (upto(self.high, m, s) - upto(self.low, m, s))) for m, s in zip(self.at, self.wide, strict=True)]
        return math.log(max(sum(inside) / len(inside) / math.sqrt(2 * math.pi), 1e-300))


class TPE:
    """Tree-structured Parzen estimator (Bergstra et al., 2011) over spaces of "log", "int" and "uniform" parameters.

    The first ``startup`` points are random. Then for each parameter candidates are drawn
    from the density of the best tenth of the trials (25 at most), and the one stays whose
    density there is largest against that of the others. Scores that are not finite count as the poorest."""

    def __init__(self, space: dict[str, tuple], seed: int, startup: int = 10, candidates: int = 24):
        self.space, self.rng = space, random.Random(seed)
        self.startup, self.candidates = startup, candidates
        self.trials: list[tuple[float, int, dict[str, float]]] = []

    def tell(self, point: dict[str, float], score: float) -> None:
        self.trials.append((score if score is not None and math.isfinite(score) else math.inf, len(self.trials), point))

    def suggest(self, n: int = 1) -> list[dict[str, float]]:
        """``n`` points to try at once; those before count as poor trials for the next."""
        out: list[dict[str, float]] = []
        ranked = [p for _, _, p in sorted(self.trials, key=lambda t: t[:2])]
        best = min(math.ceil(0.1 * len(ranked)), 25)
        for _ in range(n):
            early = len(self.trials) < self.startup
            out.append({k: self._value(s, None if early else [p[k] for p in ranked[:best]], [p[k] for p in [*ranked[best:], *out]]) for k, s in self.space.items()})
        return out

    def _value(self, spec: tuple, good: list[float] | None, poor: list[float]) -> float:
        kind, low, high, *step = spec
        # Whole numbers get an even share of the line each.
        half = step[0] / 2 if kind == "int" else 0.0
        scale, back = (math.log, math.exp) if kind == "log" else (float, float)
        a, b = scale(low) - half, scale(high) + half
        if good is None:
            x = self.rng.uniform(a, b)
        else:
            near, far = Density([scale(v) for v in good], a, b), Density([scale(v) for v in poor], a, b)
            x = max((near.draw(self.rng) for _ in range(self.candidates)), key=lambda v: near.log(v) - far.log(v))
        if kind == "int":
            return min(high, max(low, low + step[0] * round((x - low) / step[0])))
        return min(high, max(low, back(x)))
