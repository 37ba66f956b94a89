"""A run of named stages in one session: a slice of the list, in order, stopping at the first failure."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[], object]


def select(stages: list[Stage], start: str | None = None, stop: str | None = None) -> list[Stage]:
    names = [s.name for s in stages]
    for name in (start, stop):
        if name is not None and name not in names:
            raise ValueError(f"no stage {name}")
    first, last = names.index(start) if start else 0, names.index(stop) if stop else len(names) - 1
    if first > last:
        raise ValueError("the first stage lies after the last")
    return stages[first : last + 1]


def run(stages: list[Stage], dry_run: bool = False) -> list[tuple[str, float]]:
    took = []
    for stage in stages:
        began = time.monotonic()
        if not dry_run:
            stage.run()
        took.append((stage.name, time.monotonic() - began))
    return took


def gate(checks: dict[str, bool], provisional: set[str] = frozenset()) -> tuple[str, list[str]]:
    """pass, provisional_pass where only ``provisional`` checks fail, or blocked; with what failed."""
    failed = sorted(k for k, ok in checks.items() if not ok)
    return ("pass" if not failed else "provisional_pass" if set(failed) <= provisional else "blocked"), failed
