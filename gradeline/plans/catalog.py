"""All registered queries."""

from . import auditing, comparing, imaging, run_health, sampling, scoring, shifting, storing, watching  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
