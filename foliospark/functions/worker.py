"""What all tasks of one Python worker share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable


def shared(name: str, make: Callable):
    """What make() gave when it was first asked for by this name in this process.

    Functions of this package travel by value, so what they find as a global of their module is new in each task.
    """
    held = vars(sys.modules.setdefault("foliospark_worker", types.ModuleType("foliospark_worker")))
    if name not in held:
        held[name] = make()
    return held[name]
