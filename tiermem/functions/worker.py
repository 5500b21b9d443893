"""What a Python worker keeps between its tasks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyspark


def kept(key: object, make: Callable[[], Any]) -> Any:
    """The value under ``key``, made by ``make`` the first time this worker asks.

    Task functions of this package travel by value, so a module's own globals are new in every task; the
    dictionary lives in a module that the worker itself imports.
    """
    held = vars(pyspark).setdefault("_kept_between_tasks", {})
    if key not in held:
        held[key] = make()
    return held[key]
