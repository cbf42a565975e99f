import pytest

from tideledger.plans import model_queries


@pytest.mark.parametrize("name", ["random_forest", "boosted_trees", "boosted_leaves"])
def test_queries_fit_the_default_model(monkeypatch, name):
    asked = []

    class Result:
        def predictions(self):
            return "predictions"

    monkeypatch.setattr(model_queries, "frame", lambda spark, sf_dir: "frame")
    monkeypatch.setattr(model_queries.classify, "train_classifier", lambda *a, **k: asked.append((a, k)) or Result())
    assert getattr(model_queries, name)(None, "") == "predictions"
    assert asked == [(("frame", name), {})]
