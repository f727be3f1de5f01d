"""Connected components are the library's."""

from __future__ import annotations

from ..components import connected_components

__all__ = ["connected_components"]
