"""Connected components of link tables, as the library has them."""

from __future__ import annotations

from ..operators.components import components

__all__ = ["components"]
