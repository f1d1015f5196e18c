"""A whole retrieval run: select, embed or take cached features, search, write results."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.errors import RetrievalError
from orrery.functions import signatures
from orrery.operators import embed, order, results, search, select
from orrery.plans.startup import Started
from orrery.shared import written
from orrery.sources import cache, files


def features_of(records: DataFrame, started: Started, checkpoint: str, embedder: embed.Embedder | None) -> tuple[DataFrame, bool]:
    """pos and features of the selected records, and whether they were in the cache."""
    config = started.config
    about = {"model_name": config.model.model_name, "checkpoint_sha256": checkpoint, "feature_config_signature": signatures.feature_signature(config.model, checkpoint)}
    folder, signs = config.output.feature_cache, order.fingerprint(records)
    cached = cache.load_cache(records.sparkSession, folder, records, about, signs) if config.h1.reuse_feature_cache else None
    if cached is not None:
        return cached, True
    made = cache.save_cache(embed.embedded(records, config.model, embedder), folder, about | {"ids": signs["ids"], "names": signs["names"]})
    if order.fingerprint(made) != signs:
        raise RetrievalError(f"Embedding lost the order of the images: {order.first_difference(records, made)}")
    return made, False


def run_retrieval(started: Started, embedder: embed.Embedder | None = None) -> dict[str, Any]:
    """Runs what the configuration asks for; returns the metadata, which are written last."""
    config = started.config
    records = select.head(started.records, config.dataset.max_images)
    spark = records.sparkSession
    select.require_two(records)
    select.require_files(records, select.files_of(records))
    queries = written(select.queries_of(records, config.h1.query_image_ids, config.h1.query_stride))

    output = config.output
    for folder in (output.figures, output.failure_cases, *(p.parent for p in (output.feature_cache, output.query_results, output.metadata))):
        files.make_folder(spark, folder)
    began = time.time()
    checkpoint = signatures.checkpoint_sha256(config.model.checkpoint)
    features, reused = features_of(records, started, checkpoint, embedder)
    shape = features.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    matches = search.top_k(features, queries, config.h1.top_k)
    header = {"experiment": config.name, "model_name": config.model.model_name, "num_images": shape["n"], "top_k": min(config.h1.top_k, shape["n"] - 1)}
    results.write_results(output.query_results, header, results.nested(results.named(matches, records)))
    ended = time.time()
    metadata = {
        "status": "completed", "started_unix": began, "finished_unix": ended, "duration_seconds": ended - began, "cache_reused": reused, "checkpoint_sha256": checkpoint,
        "feature_shape": [shape["n"], shape["d"]], "config": config.serializable(), "outputs": {k: str(p) for k, p in output.named().items()},
    }
    files.write_json(spark, output.metadata, metadata)
    return metadata
