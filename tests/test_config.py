import pytest

from colweave import Settings


@pytest.mark.parametrize("change, text", [
    ({"correlation_threshold": 1.5}, "correlation_threshold"),
    ({"correlation_threshold": -0.5}, "correlation_threshold"),
    ({"top_k_neighbors": 0}, "top_k_neighbors"),
    ({"learnable_epochs": -10}, "learnable_epochs"),
    ({"learnable_lr": 0}, "learnable_lr"),
    ({"redundant_correlation_threshold": 1.1}, "redundant_correlation_threshold"),
    ({"missing_threshold_drop": -0.1}, "missing_threshold_drop"),
    ({"outlier_method": "guess"}, "outlier_method"),
    ({"missing_impute_strategy": "guess"}, "missing_impute_strategy"),
    ({"outlier_treatment": "guess"}, "outlier_treatment"),
    ({"num_workers": 0}, "num_workers"),
    ({"log_level": "LOUD"}, "log_level"),
    ({"strict_mode": "yes"}, "strict_mode"),
])
def test_out_of_range(change, text):
    with pytest.raises(ValueError, match=text):
        Settings(**change)


def test_dict_and_unknown_key():
    assert Settings.from_dict({"top_k_neighbors": 3}).top_k_neighbors == 3
    with pytest.raises(ValueError, match="Unknown configuration key: nope"):
        Settings.from_dict({"nope": 1})


def test_yaml(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "c.yaml"
    path.write_text("correlation_threshold: 0.7\noutlier_method: z_score\n")
    cfg = Settings.from_yaml(str(path))
    assert (cfg.correlation_threshold, cfg.outlier_method) == (0.7, "z_score")
    assert cfg.to_dict()["top_k_neighbors"] == 5
