"""Wall-clock seconds of named stages on the driver."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager


@contextmanager
def measured(stages: dict[str, float], name: str) -> Iterator[None]:
    """Adds the seconds that the block takes to stages[name], also if it fails. Spark's plans are lazy: measure actions."""
    start = time.perf_counter()
    try:
        yield
    finally:
        stages[name] = stages.get(name, 0.0) + time.perf_counter() - start
