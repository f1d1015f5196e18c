from __future__ import annotations

import pytest

from orrery.errors import ConfigError
from orrery.sources.config import load_config


def test_paths_are_resolved(make_run, tmp_path):
    config = load_config(make_run())
    assert config.dataset.root == tmp_path / "data"
    assert config.output.query_results == tmp_path / "out/made/query_results"
    assert config.model_key == "net" and config.model.image_size == (32, 48)
    assert config.serializable()["output"]["root"] == str(tmp_path / "out")
    assert config.serializable()["net"]["mean"] == [0, 0.25, 0.5]


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"output__query_results": "../escaped/results.json"}, "not below output.root"),
        ({"dataset__roots": "wrong"}, r"dataset\.roots"),
        ({"output__metadata": "made/query_results"}, "must be unique"),
        ({"output__metadata": "made"}, "must not contain"),
        ({"output__metadata": "."}, "must not be output.root"),
        ({"experiment__seed": True}, "from 0 on"),
        ({"experiment__name": " "}, "needs a text"),
        ({"h1__top_k": 0}, "from 1 on"),
        ({"h1__query_image_ids": [1, True]}, "list of whole numbers"),
        ({"h1__reuse_feature_cache": "yes"}, "true or false"),
        ({"models__net__std": [1, 0, 1]}, "above 0"),
        ({"models__net__mean": [1, 2]}, "list of 3 numbers"),
        ({"models__net__image_size": ["a", 2]}, "no number"),
        ({"models__net__image_size": [float("inf"), 2]}, "no number"),
        ({"dataset__max_images": 0}, "from 1 on"),
        ({"models": {}}, "one model"),
    ],
)
def test_errors(make_run, change, message):
    with pytest.raises(ConfigError, match=message):
        load_config(make_run(**change))


def test_numbers_are_cast(make_run):
    assert load_config(make_run(models__net__image_size=["224", 224.7])).model.image_size == (224, 224)


def test_missing_file_and_key(make_run, tmp_path):
    with pytest.raises(ConfigError, match="no configuration at"):
        load_config(tmp_path / "none.yaml")
    config = make_run()
    config.write_text(config.read_text().replace("seed: 3", ""))
    with pytest.raises(ConfigError, match=r"Missing.*experiment\.seed"):
        load_config(config)
    config.write_bytes(b"a: \xff")
    with pytest.raises(ConfigError, match="can't be read"):
        load_config(config)
