import pytest

from assayframe.operators import clean, evaluate
from assayframe.plans import queries as Q
from assayframe.session import materialize


def test_names():
    with pytest.raises(ValueError, match="unknown model"):
        evaluate.predictor("nothing")
    with pytest.warns(UserWarning, match="expert"):
        assert evaluate.supported_features("mean", ["expert"]) == []
    assert evaluate.supported_features("rf", ["expert"]) == ["expert"]


def test_unknown_feature_set(spark):
    with pytest.raises(ValueError, match="unknown feature set"):
        evaluate.add_features(spark.range(1), ["nothing"])


@pytest.mark.parametrize("model,params", [("constant", {"value": 4.5}), ("mean", {}), ("knn", {"k": 3}), ("rf", {"numTrees": 3, "maxDepth": 4})])
def test_hold_out_evaluation(spark, folder, model, params):
    rows = materialize(clean.annotated(Q.merged(spark, folder)).limit(300))
    train, pool = evaluate.held_out(rows)
    out = evaluate.experiment_row(train, pool, model, params, features=["expert"], train_set="a", test_set="b").collect()
    assert len(out) == 1 and out[0]["model"] == model and out[0]["features"] == "expert"
    assert out[0]["train_mae"] > 0 and out[0]["test_mae"] > 0
    sides = {r["side"]: r["n"] for r in evaluate.side_metrics(train, pool, "mean").collect()}
    assert sides == {"train": 240, "test": 60}
