"""Checks of arguments: each raises ValueError that names what is wrong."""

from __future__ import annotations

import math


def text(**values: str) -> None:
    for name, value in values.items():
        if not isinstance(value, str) or not value:
            raise ValueError(f"{name} must be a text that isn't empty")


def step(value: int | str) -> int:
    """A step number; numbers in text count as well."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"step must be a number: {value!r}") from None
    if number != int(number) or number < 0:
        raise ValueError("step must be an integer of at least 0")
    return int(number)


def names(value: str | list[str], least: int = 0) -> list[str]:
    """A list, or a text of names with commas between; blanks about names and empty ones are left out."""
    found = [x.strip() for x in (value.split(",") if isinstance(value, str) else value) if x.strip()]
    if len(found) < least:
        raise ValueError(f"at least {least} signals are needed")
    return found


def threshold(k: float = 3.5) -> float:
    if not 0 < k <= 10:
        raise ValueError("k must be over 0 and at most 10")
    return k


def share(**values: float) -> None:
    for name, value in values.items():
        if not 0 < value < 1:
            raise ValueError(f"{name} must lie between 0 and 1")


def positive(**values: float) -> None:
    for name, value in values.items():
        if not (value > 0 and math.isfinite(value)):
            raise ValueError(f"{name} must be over 0 and finite")
