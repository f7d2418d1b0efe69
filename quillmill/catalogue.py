"""Every query of the library's own operators, with its SQL; the training-data subpackage adds its own."""

from __future__ import annotations

from .plans import exports, flagship, layout, pages, quality, reports, sampling, texts  # noqa: F401  each registers its queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
