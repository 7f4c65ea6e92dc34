"""Intermediate tables in the folder that all executors of a cluster share."""

from __future__ import annotations

from ..shared import folder, forget, forget_since, mark, new_path, stored

__all__ = ["folder", "forget", "forget_since", "mark", "new_path", "stored"]
