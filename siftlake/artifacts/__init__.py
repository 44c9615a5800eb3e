"""Artifacts: decoded rows in, evidence tables out."""

from siftlake.artifacts import execution, system, userhives  # noqa: F401  (registers the artifacts)
from siftlake.artifacts.registry import add_to_list, collect, describe, get, names, register, selected  # noqa: F401
