"""Every query of the library."""

from __future__ import annotations

from . import aggregates, composites, evidence, graphs, indexes, ordered, search, streams, text, upkeep  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
