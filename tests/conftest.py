from __future__ import annotations

import json
from pathlib import Path
from typing import Any

import pytest
import yaml
from pyspark.sql import SparkSession

from orrery.sources import config


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.ui.showConsoleProgress": "false",
    }
    session = SparkSession.builder.master("local[4]").config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


#: A value for each rule of the library's tables of keys, by the rule's own name, and for keys that need one of their own.
BY_RULE = {config.text: "trial", config.flag: True, config.path: "data", config.ids: []}
BY_KEY = {
    "seed": 3, "device": "cpu", "annotation": "data/list.json", "max_images": None, "checkpoint": "model.bin", "model_name": "stand-in", "image_size": [32, 48], "mean": [0, 0.25, 0.5], "std": [1, 0.5, 2],
    "interpolation": "bilinear", "batch_size": 3, "num_workers": 1, "query_stride": 1, "top_k": 1,
}


@pytest.fixture
def make_run(tmp_path: Path):
    """A folder to run in, with files of the names; settings are given by section__key."""

    def filled(section: str, rules: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
        usual = {k: BY_KEY[k] if k in BY_KEY else f"made/{k}" if rule is config.beneath else BY_RULE[rule] for k, rule in rules.items()}
        return usual | {k.removeprefix(f"{section}__"): v for k, v in given.items() if k.startswith(f"{section}__")}

    def make(names: list[str] | None = None, **given: Any) -> Path:
        files = {f"data/{n}": n for n in (names or ["one/two/1.jpg"])}
        files["data/list.json"] = json.dumps({"images": [{"id": k, "file_name": n} for k, n in enumerate(files.values(), 1)]})
        sections = {"experiment": config.EXPERIMENT, "dataset": config.DATASET, "h1": config.QUERIES, "output": config.OUTPUTS}
        settings: dict[str, Any] = {name: filled(name, rules, given) for name, rules in sections.items()}
        settings["models"] = {"net": filled("models__net", config.MODEL, given)}
        settings["output"].setdefault("root", "out")
        settings |= {k: v for k, v in given.items() if "__" not in k}
        files |= {"model.bin": "weights", "config.yaml": yaml.safe_dump(settings)}
        for name, content in files.items():
            file = tmp_path / name
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(content, encoding="utf-8")
        return tmp_path / "config.yaml"

    return make
