"""Errors of the library; the command line ends with status 2 on the ones about input."""

from __future__ import annotations


class ConfigError(ValueError):
    """A configuration file is missing, or a value in it is."""


class ManifestError(ValueError):
    """A manifest is not readable, or holds a record that is not allowed."""


class StartupError(RuntimeError):
    """What a run needs is not there. Holds all that was found, not the first only."""


class RetrievalError(RuntimeError):
    """A run that had begun can't be completed."""
