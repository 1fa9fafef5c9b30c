import json

import pytest

from retentio.ml import registry, train
from retentio.sources import fixtures as fx

SMALL = {"knn": {"n_neighbors": [3, 5, 9], "weights": ["uniform", "distance"]},
         "adaboost": {"n_estimators": [1, 3, 5], "learning_rate": [0.5, 1.0]},
         "gradient_boosting": {"n_estimators": [2, 4], "learning_rate": [0.3], "max_depth": [2]}}


@pytest.mark.parametrize("model", sorted(SMALL))
def test_scores_equal_separate_fits_and_fits_are_counted(spark, monkeypatch, model):
    monkeypatch.setitem(registry.PARAM_GRIDS, model, SMALL[model])
    d = train.prepare(fx.students(spark, "/root/testdata/sf0.001"))
    fits = []
    make = train.make_estimator

    def counted(name, **params):
        fits.append(params)
        return make(name, **params)

    monkeypatch.setattr(train, "make_estimator", counted)
    best, together = train.tune(d, model, 2)
    points = registry.grid_points(model)
    rest = {json.dumps({k: v for k, v in p.items() if k not in train.NESTED[model]}) for p in points}
    assert len(fits) == 2 * len(rest) < 2 * len(points)
    monkeypatch.setattr(train, "NESTED", {})
    fits.clear()
    alone_best, alone = train.tune(d, model, 2)
    assert len(fits) == 2 * len(points)
    scores = {r["params"]: r["mean_f1"] for r in together.collect()}
    assert scores == pytest.approx({r["params"]: r["mean_f1"] for r in alone.collect()}, abs=1e-12) and best == alone_best


def test_groups_end_with_the_largest_point():
    grid = registry.grid_points("adaboost")
    groups = train.nested_groups("adaboost", grid)
    assert len(groups) == 3 and sorted(i for g in groups for i in g) == list(range(9))
    assert all(grid[g[-1]]["n_estimators"] == 200 for g in groups)
    assert len(train.nested_groups("knn", registry.grid_points("knn"))) == 1
    assert len(train.nested_groups("logistic_regression", registry.grid_points("logistic_regression"))) == 5
