import math
import random
import threading

import pytest

from lapsewise.operators.search import COMPLETE, PRUNED, best_trial, search, suggest, trials_table

SPACE = {"x": (-5.0, 5.0), "rate": (0.001, 1.0), "depth": (1, 12)}


def bowl(p):
    """Highest at x = 2, rate = 0.03, depth = 7."""
    return -((p["x"] - 2) ** 2) - (math.log(p["rate"] / 0.03)) ** 2 - 0.3 * (p["depth"] - 7) ** 2


def never(p):
    raise ValueError("no")


def run(seed, n=60, **more):
    return search(bowl, SPACE, n, seed, log_scale=["rate"], **more)


def test_same_seed_same_trials():
    assert run(5) == run(5)
    assert run(5, parallelism=3) == run(5, parallelism=3)
    assert run(5) != run(6)


def test_points_lie_in_the_space():
    for t in run(1):
        assert -5 <= t.params["x"] <= 5 and 0.001 <= t.params["rate"] <= 1
        assert isinstance(t.params["depth"], int) and 1 <= t.params["depth"] <= 12
    assert suggest({"c": (3, 3)}, [], random.Random(1)) == {"c": 3}


def test_better_than_random_draws():
    guided = [best_trial(run(s)).value for s in range(10)]
    drawn = [best_trial(run(s, startup=10**9)).value for s in range(10)]
    assert sum(guided) / 10 > 0.5 * sum(drawn) / 10
    assert sum(g > d for g, d in zip(guided, drawn)) >= 8


def test_pruned_trials_stay_in_the_table(spark):
    def sometimes(p):
        if p["depth"] > 9:
            raise ValueError("too deep")
        return float("nan") if p["depth"] < 3 else bowl(p)

    trials = search(sometimes, SPACE, 40, 3, ["rate"])
    rows = trials_table(spark, trials).collect()
    assert [r["number"] for r in rows] == list(range(40))
    states = {r["state"] for r in rows}
    assert states == {COMPLETE, PRUNED}
    errors = {r["error"] for r in rows if r["state"] == PRUNED}
    assert "ValueError: too deep" in errors and all(r["objective"] is None for r in rows if r["state"] == PRUNED)
    assert best_trial(trials).value == max(r["objective"] for r in rows if r["objective"] is not None)
    with pytest.raises(RuntimeError, match="every trial was pruned; the first by ValueError"):
        search(never, SPACE, 3, 1)


def test_random_trials_run_at_once_and_stay_the_same():
    meet = threading.Barrier(5)

    def together(p):
        meet.wait(30)  # five trials have to be running
        return bowl(p)

    assert search(together, SPACE, 10, 5, ["rate"], workers=5) == run(5, 10)
    assert run(5, 25, workers=4) == run(5, 25)
    assert run(5, 25, parallelism=3, workers=4) == run(5, 25, parallelism=3)
    assert run(5, 25, parallelism=3, workers=2) == run(5, 25, parallelism=3)
