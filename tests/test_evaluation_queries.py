import inspect

import pytest

from rankstead.operators import learn, stats
from rankstead.plans import evaluation


@pytest.mark.parametrize("module, name, query, what, least", [(stats, "bootstrap_ci", "bootstrap_ci", "times", 2000), (stats, "paired_bootstrap", "paired_bootstrap", "times", 2000), (stats, "poisson_bootstrap", "poisson_bootstrap", "times", 200), (learn, "boosting_logo", "logo_boosting", "rounds", 60)])
def test_repetitions_are_not_cut(spark, data, monkeypatch, module, name, query, what, least):
    shape, asked = inspect.signature(getattr(module, name)), []

    def note(*args, **kwargs):
        call = shape.bind(*args, **kwargs)
        call.apply_defaults()
        asked.append(call.arguments[what])

    monkeypatch.setattr(module, name, note)
    evaluation.QUERIES[query](spark, data)
    assert asked == [least]
