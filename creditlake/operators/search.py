"""Search for settings: Parzen densities propose batches of trials, and each batch is halved as its trees grow."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Trials drawn at random before densities mean anything, the share of trials that count as good, and draws a proposal.
STARTUP, GOOD, DRAWS = 8, 0.25, 24


@dataclass(frozen=True)
class Range:
    """What a setting may be: between low and high, by its logarithm if log, whole numbers if whole."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def at(self, u: float) -> float:
        """The value at place u of 0 to 1."""
        if self.whole:
            return int(min(self.high, self.low + math.floor(u * (self.high - self.low + 1))))
        if self.log:
            return float(math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))))
        return float(self.low + u * (self.high - self.low))


@dataclass
class Trial:
    """A proposal with its places, what growing it gave, and why it ended: `halved`, or the model's own reason."""

    number: int
    batch: int
    places: dict[str, float]
    values: dict[str, float]
    score: float = math.nan
    trees: int = 0
    best: int = 0
    stop: str = ""
    rungs: list[tuple[int, float]] = field(default_factory=list)


class Parzen:
    """A mixture of a uniform density and one bell on 0 to 1 around each given place, cut off at the ends.

    A bell is as wide as the gap to its farther neighbour, within limits, so that few places give a broad density."""

    def __init__(self, places: np.ndarray) -> None:
        self.centre = np.sort(places)
        around = np.r_[0.0, self.centre, 1.0]
        gap = np.maximum(around[1:-1] - around[:-2], around[2:] - around[1:-1])
        self.width = np.clip(gap, 1 / min(100, len(places) + 2), 1.0)
        self.mass = np.asarray([_normal((1 - c) / w) - _normal(-c / w) for c, w in zip(self.centre, self.width, strict=True)])

    def density(self, u: np.ndarray) -> np.ndarray:
        z = (u[:, None] - self.centre) / self.width
        bells = np.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * self.width * self.mass)
        return (1 + bells.sum(axis=1)) / (1 + len(self.centre))

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = np.empty(n)
        for i in range(n):
            k = int(rng.integers(len(self.centre) + 1))
            u = rng.random() if k == len(self.centre) else -1.0
            while not 0 <= u <= 1:
                u = rng.normal(self.centre[k], self.width[k])
            out[i] = u
        return out


def _normal(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def proposal(space: dict[str, Range], done: list[Trial], pending: list[Trial], rng: np.random.Generator) -> dict[str, float]:
    """The next places: each setting's, of some draws from the density of good trials, that which they favour most over
    the density of the others. Pending trials count as others, so that a batch spreads."""
    known = sorted((t for t in done if not math.isnan(t.score)), key=lambda t: -t.score)
    if len(known) < STARTUP:
        return {k: float(rng.random()) for k in space}
    cut = max(2, math.ceil(GOOD * len(known)))
    good, other = known[:cut], known[cut:] + pending
    places = {}
    for k in space:
        own, rest = Parzen(np.asarray([t.places[k] for t in good])), Parzen(np.asarray([t.places[k] for t in other]))
        u = own.draw(rng, DRAWS)
        places[k] = float(u[np.argmax(own.density(u) / rest.density(u))])
    return places


#: Grows the given trials to so many trees, and fills in score, trees, best and stop.
Grow = Callable[[list[Trial], int], None]


def adaptive_search(space: dict[str, Range], grow: Grow, trials: int, batch: int = 8, first: int = 10, factor: int = 3, most: int = 2000, seed: int = 0, adaptive: bool = True) -> list[Trial]:
    """All trials, with scores, trees grown and reasons to stop.

    Batches of proposals grow side by side, first to `first` trees. At each rung the better 1 / factor of a batch, one at
    least, goes on to factor times as many, until it stops by itself or has `most`. A trial that is cut keeps its score
    and is told as `halved`. Without `adaptive` all proposals are random."""
    rng = np.random.default_rng(seed)
    done: list[Trial] = []
    while len(done) < trials:
        now: list[Trial] = []
        for _ in range(min(batch, trials - len(done))):
            places = proposal(space, done if adaptive else [], now, rng)
            now.append(Trial(len(done) + len(now), len(done) // batch, places, {k: r.at(places[k]) for k, r in space.items()}))
        open_, until = list(now), first
        while open_:
            until = min(until, most)
            grow(open_, until)
            for t in open_:
                t.rungs.append((t.trees, t.score))
            ranked = sorted(open_, key=lambda t: (math.isnan(t.score), -t.score if not math.isnan(t.score) else 0, t.number))
            go = max(1, len(open_) // factor)
            for t in ranked[go:]:
                t.stop = t.stop or "halved"
            open_ = [t for t in ranked[:go] if not t.stop]
            until *= factor
        done += now
    return done
