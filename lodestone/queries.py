"""Registered queries of the core operators and the SQL they are held against."""

from __future__ import annotations

from .plans import boards, cleanups, drawings, edits, exports, floods, graphs, keys, lines, mattes, networks, outlines, paints, pens, rasters, scoring, segments, stops, strokes, styles, tables  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
