"""Catalogue of plans; importing a module registers its plans."""

from . import (  # noqa: F401
    basics,
    series,
    stats,
    signals,
    detect,
    scores,
    models,
    audit,
    landed,
    streams,
)
from .registry import ORACLES, QUERIES  # noqa: F401
