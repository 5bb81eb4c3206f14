"""What the operators share with the rest of the library."""

from __future__ import annotations

from ..workspace import discard, hadoop_path, new_path, shared_dir, written

__all__ = ["discard", "hadoop_path", "new_path", "shared_dir", "written"]
