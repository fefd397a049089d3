"""All queries of the engine."""

from . import advantages, batches, curations, metrics, more, samplers, scoring, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
