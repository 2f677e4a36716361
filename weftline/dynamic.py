"""Steps whose number shows only when they run."""

from weftline.api import sac, subdag

__all__ = ["sac", "subdag"]
