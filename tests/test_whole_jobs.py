"""The job queries run the whole job, and its fits waste no rounds."""

from __future__ import annotations

import inspect

import pytest

from checks import queries as q
from spendcast.plans import boosting, jobs
from spendcast.plans.profiles import PROFILES


def options_of(monkeypatch, name, run):
    """What a query passes to a job, by the names of the job's arguments; fields the job takes on are among them."""
    seen = {}
    job = inspect.signature(getattr(jobs, name))

    class Seen(Exception):
        pass

    def recorded(*args, **options):
        bound = job.bind(*args, **options).arguments
        seen.update(bound.pop("options", {}) | bound)
        raise Seen

    monkeypatch.setattr(q, name, recorded)
    monkeypatch.setattr(q, "log_through", lambda *_: None)
    monkeypatch.setattr(q, "customer_universe", lambda *_: None)
    monkeypatch.setattr(q, "scratch_path", lambda *_: "nowhere")
    try:
        run(None, "nowhere")
    except Seen:
        pass
    return seen


@pytest.mark.parametrize("name", ["predict", "validate"])
def test_job_runs_the_profiles_own_rounds(monkeypatch, name):
    options = options_of(monkeypatch, name, getattr(q, f"{name}_query"))
    assert options["profile"] == "xgb"
    assert not {"max_rounds", "folds", "overrides", "variant"} & set(options)
    assert PROFILES["xgb"]["tuned"]["n_estimators"] == 10_000


def test_fits_that_patience_outlasts_are_left_out(monkeypatch):
    """The first fit may end a fold; no fit is longer than the limit."""
    tried = []

    class Stop(Exception):
        pass

    def fit(train, params):
        tried.append(params["maxIter"])
        raise Stop

    monkeypatch.setattr(boosting, "fit", fit)

    class Rows:
        def where(self, *_):
            return self

        withColumn = where

    for limit, patience in ((10_000, 100), (10_000, 7), (10_000, 8), (50, 100)):
        monkeypatch.setattr(boosting.F, "col", lambda _: 0)
        monkeypatch.setattr(boosting.F, "lit", lambda _: 0)
        try:
            boosting.fit_until_patience(lambda i: None, Rows(), 1, {"maxIter": limit}, patience)
        except Stop:
            pass
    assert tried == [128, 8, 16, 50]
