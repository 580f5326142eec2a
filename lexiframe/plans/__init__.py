"""Queries over the project's tables."""

from __future__ import annotations

from . import datasets, scores, speech, storage  # noqa: F401  they register their queries
from .queries import REGISTRY


def catalogue() -> dict:
    """All registered queries."""
    return dict(REGISTRY)
