"""Exact vector retrieval over manifests, as Spark jobs."""

from orrery.sources.config import RunConfig, load_config

__all__ = ["RunConfig", "load_config"]
