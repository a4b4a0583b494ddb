"""Registered queries of the drawing operators."""

from . import assembly, composites, control, documents, drawings, edits, evidence, integrity, library, publication, ranking, rasters, records, scene, spatial, stages, text, validation  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
