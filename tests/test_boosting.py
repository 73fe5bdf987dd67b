"""Boosted trees for censored durations against a trainer over single rows in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import boosting


@pytest.mark.parametrize("event", [True, False])
def test_gradients_are_those_of_the_loss(event):
    logs, scale, step = np.array([0.0, 3.0, 6.0, 30.0]), 1.3, 1e-5
    at = lambda m: boosting.losses((logs - m) / scale, np.full(4, event), scale, logs)
    loss, g, h = at(2.0)
    assert np.allclose(g, (at(2.0 + step)[0] - at(2.0 - step)[0]) / (2 * step), rtol=1e-3, atol=1e-5)
    assert np.allclose(h, (at(2.0 + step)[1] - at(2.0 - step)[1]) / (2 * step), rtol=1e-2, atol=1e-4)
    if event:
        assert loss[1] == pytest.approx(-math.log(math.exp(-(((3 - 2) / scale) ** 2) / 2) / (scale * math.sqrt(2 * math.pi) * math.exp(3))))


def plain(rows, categories, numbers, settings):
    """Locations after training, row by row: every split of every node tried on the rows themselves."""
    logs = np.array([math.log(max(r["duration_days"], 1)) for r in rows])
    event = np.array([r["event_observed"] for r in rows])
    total = np.full(len(rows), logs.mean())
    score = lambda g, h: g * g / (h + settings.penalty)
    history = []
    for _ in range(settings.rounds):
        loss, g, h = boosting.losses((logs - total) / settings.scale, event, settings.scale, logs)
        history.append(loss.mean())
        leaves = [np.arange(len(rows))]
        for _ in range(settings.depth):
            below = []
            for rows_in in leaves:
                best = (1e-9, None)
                for f in categories + numbers:
                    values = [rows[i][f] for i in rows_in]
                    kinds = sorted({v for v in values if v is not None})
                    sums = {v: (sum(g[i] for i, x in zip(rows_in, values) if x == v), sum(h[i] for i, x in zip(rows_in, values) if x == v)) for v in kinds}
                    if f in categories:
                        kinds.sort(key=lambda v: sums[v][0] / (sums[v][1] + settings.penalty))
                    for cut in range(1, len(kinds)):
                        low = set(kinds[:cut])
                        weight = [sum(sums[v][1] for v in kinds[a:b]) for a, b in ((0, cut), (cut, None))]
                        side = np.array([weight[0] >= weight[1] if v is None else v in low for v in values])
                        a, b = rows_in[side], rows_in[~side]
                        if min(h[a].sum(), h[b].sum()) < settings.least_hessian:
                            continue
                        gain = score(g[a].sum(), h[a].sum()) + score(g[b].sum(), h[b].sum()) - score(g[rows_in].sum(), h[rows_in].sum())
                        if gain > best[0] + 1e-8:
                            best = (gain, (a, b))
                below += list(best[1]) if best[1] else [rows_in]
            leaves = below
        for rows_in in leaves:
            total[rows_in] -= settings.rate * g[rows_in].sum() / (h[rows_in].sum() + settings.penalty)
    return total, history


def sample(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        court, year = "abcde"[rng.integers(5)], int(rng.integers(1990, 1996))
        mean = 4 + (court in "bd") * 1.2 + (year > 1992) * 0.7
        t = math.exp(rng.normal(mean, 0.8))
        rows.append((i, court if i % 37 else None, float(year) if i % 41 else None, int(min(t, 200)), bool(t <= 200)))
    return spark.createDataFrame(rows, "id long, court string, year double, duration_days int, event_observed boolean").repartition(3)


def test_equals_training_on_rows(spark):
    """Nulls in either kind of feature, repeated rows, censored rows; trees' sums written anew in between."""
    rows = sample(spark).unionByName(sample(spark).where("id < 100"))
    settings = boosting.Settings(rounds=5, depth=3, rate=0.3, least_hessian=5.0, rewrite=2)
    model = boosting.fit(rows, ["court"], ["year"], settings=settings)
    own = [r.asDict() for r in rows.collect()]
    want, history = plain(own, ["court"], ["year"], settings)
    found = model.located(rows.select("id", "court", "year").withColumn("_x_court", F.lit("clash")), "place").collect()
    by_id = {r["id"]: r["place"] for r in found}
    assert len(found) == 700 and [by_id[r["id"]] for r in own] == pytest.approx(list(want), abs=1e-6)
    assert [h[1] for h in model.history[:5]] == pytest.approx(history, abs=1e-6)
    losses = [h[1] for h in model.history]
    assert all(b < a for a, b in zip(losses, losses[1:]))


def test_stops_early_and_ranks_held_out_rows(spark):
    rows = sample(spark)
    train, held = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    settings = boosting.Settings(rounds=40, depth=2, rate=0.5, least_hessian=2.0, patience=3, rewrite=4)
    model = boosting.fit(train, ["court"], ["year"], settings=settings, validation=held)
    judged = [h[2] for h in model.history]
    assert len(model.trees) == int(np.argmin(judged)) < 40 and min(judged) < judged[0] - 0.05
    other = spark.createDataFrame([("b", 1995.0), ("a", 1990.0), ("new", None), (None, None)], "court string, year double")
    place = {r["court"]: r["location"] for r in model.located(other).collect()}
    assert place["b"] > place["a"] + 1 and math.isfinite(place["new"]) and place["new"] == place[None]


def test_needs_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit(sample(spark).where("id < 0"), ["court"], ["year"])
