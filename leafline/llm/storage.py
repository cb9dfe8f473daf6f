"""Tables written between steps, in the folder that the whole cluster shares."""

from __future__ import annotations

from ..sources.tables import discard, new_path, shared_dir
from ..sources.tables import written as stored

__all__ = ["discard", "new_path", "shared_dir", "stored"]
