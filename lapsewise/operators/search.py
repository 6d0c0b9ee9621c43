"""Sequential parameter search with a tree-structured Parzen estimator.

After some random trials the completed ones are split into the best few and the rest. For
each parameter two densities are laid over their values, and of some draws from the first
the one is tried at which the first is largest against the second (Bergstra et al., 2011,
"Algorithms for hyper-parameter optimization"). Trials are few and run as Spark jobs; only
their parameters and values are handled here.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession

Space = Mapping[str, tuple[float, float]]
# Random trials before the densities are used, draws of which the best is tried, and the
# share (and most) of the trials that count as good.
STARTUP, DRAWS, GOOD_SHARE, MOST_GOOD = 10, 24, 0.1, 25
COMPLETE, PRUNED = "complete", "pruned"
TRIAL_SCHEMA = "number int, state string, objective double, params string, error string"


@dataclass(frozen=True)
class Trial:
    """One tried point; without a value it was pruned, by an error or for lack of one."""

    number: int
    params: dict
    value: float | None = None
    error: str | None = None

    @property
    def state(self) -> str:
        return COMPLETE if self.value is not None else PRUNED


class _Axis:
    """One parameter on the line its values are drawn on."""

    def __init__(self, low: float, high: float, log: bool):
        self.whole = isinstance(low, int) and isinstance(high, int)
        self.log = log
        # Whole numbers are drawn from half a step around them.
        edge = 0.5 if self.whole else 0.0
        self.least, self.most = low, high
        self.low, self.high = self.to_line(low - edge), self.to_line(high + edge)

    def to_line(self, x: float) -> float:
        return math.log(x) if self.log else float(x)

    def value(self, at: float) -> float | int:
        x = math.exp(at) if self.log else at
        x = min(self.most, max(self.least, round(x) if self.whole else x))
        return int(x) if self.whole else x


class _Density:
    """A wide bell over the whole axis and one around each value, as wide as the gap to its
    neighbours, all cut at the ends."""

    def __init__(self, axis: _Axis, values: Sequence[float]):
        span = axis.high - axis.low or 1.0
        points = sorted(values)
        bells = [((axis.low + axis.high) / 2, span)]
        ends = [axis.low, *points, axis.high]
        narrowest = span / min(100, 1 + len(points))
        for before, at, after in zip(ends, points, ends[2:]):
            bells.append((at, min(span, max(narrowest, at - before, after - at))))
        self.axis, self.bells = axis, bells

    @staticmethod
    def _below(x: float) -> float:
        return 0.5 * (1 + math.erf(x / math.sqrt(2)))

    def draw(self, rng: random.Random) -> float:
        middle, width = rng.choice(self.bells)
        for _ in range(100):
            x = rng.gauss(middle, width)
            if self.axis.low <= x <= self.axis.high:
                return x
        return rng.uniform(self.axis.low, self.axis.high)

    def log(self, x: float) -> float:
        total = 0.0
        for middle, width in self.bells:
            inside = self._below((self.axis.high - middle) / width) - self._below((self.axis.low - middle) / width)
            total += math.exp(-0.5 * ((x - middle) / width) ** 2) / (width * max(inside, 1e-12))
        return math.log(max(total / len(self.bells), 1e-300))


def suggest(space: Space, trials: Sequence[Trial], rng: random.Random, log_scale: Sequence[str] = (), startup: int = STARTUP) -> dict:
    """The next point to try, given the trials that have ended."""
    done = sorted((t for t in trials if t.value is not None), key=lambda t: (-t.value, t.number))
    n_good = min(MOST_GOOD, math.ceil(GOOD_SHARE * len(done)))
    point = {}
    for name, (low, high) in space.items():
        axis = _Axis(low, high, name in log_scale)
        if len(done) < startup:
            point[name] = axis.value(rng.uniform(axis.low, axis.high))
            continue
        good, rest = (_Density(axis, [axis.to_line(t.params[name]) for t in part]) for part in (done[:n_good], done[n_good:]))
        draws = [good.draw(rng) for _ in range(DRAWS)]
        point[name] = axis.value(max(draws, key=lambda x: good.log(x) - rest.log(x)))
    return point


def search(
    objective: Callable[[dict], float | None],
    space: Space,
    n_trials: int,
    seed: int,
    log_scale: Sequence[str] = (),
    parallelism: int = 1,
    startup: int = STARTUP,
    workers: int = 1,
) -> list[Trial]:
    """All trials in their order. The objective is maximised; one that raises or gives no
    value prunes its trial. ``parallelism`` trials run at once and are suggested together,
    so that the same seed gives the same trials. The random ones at the start need no result of
    another: up to ``workers`` of them run at once, and the trials stay the same. If none
    completes that is an error."""
    rng, trials = random.Random(seed), []

    def run(trial: Trial) -> Trial:
        try:
            value = objective(dict(trial.params))
        except Exception as error:  # a bad parameter set must not end the search
            return Trial(trial.number, trial.params, None, f"{type(error).__name__}: {error}")
        usable = value is not None and math.isfinite(value)
        return Trial(trial.number, trial.params, float(value) if usable else None, None if usable else f"no value: {value}")

    at_start = math.ceil(min(startup, n_trials) / parallelism) * parallelism if workers > parallelism else 0
    with ThreadPool(max(parallelism, workers)) as pool:
        while len(trials) < n_trials:
            step = min(max(parallelism, at_start - len(trials)), n_trials - len(trials))
            asked = [Trial(len(trials) + i, suggest(space, trials, rng, log_scale, startup)) for i in range(step)]
            trials += pool.map(run, asked, chunksize=1)
    if all(t.value is None for t in trials):
        raise RuntimeError(f"every trial was pruned; the first by {trials[0].error}" if trials else "no trials")
    return trials


def best_trial(trials: Sequence[Trial]) -> Trial:
    """The completed trial of the highest value, the first of equal ones."""
    return max((t for t in trials if t.value is not None), key=lambda t: (t.value, -t.number))


def trials_table(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    """One row per trial, with those pruned and why."""
    rows = [(t.number, t.state, t.value, json.dumps(t.params, sort_keys=True), t.error) for t in trials]
    return spark.createDataFrame(rows, TRIAL_SCHEMA)
