"""Checks of arguments: each returns its value or raises a ValueError that names the argument."""

from __future__ import annotations

from datetime import date


def share(value: float, name: str = "quantile", most: float = 0.5) -> float:
    """A share of rows at one end: above 0 and below `most`."""
    if not 0 < value < most:
        raise ValueError(f"{name} must be above 0 and below {most}: {value}")
    return value


def at_least(value: float, least: float, name: str) -> float:
    if value < least:
        raise ValueError(f"{name} must be at least {least}: {value}")
    return value


def period(start: str, end: str) -> tuple[str, str]:
    """Two ISO days in order."""
    if date.fromisoformat(start) > date.fromisoformat(end):
        raise ValueError(f"start must not come after end: {start}, {end}")
    return start, end


def has_columns(have: list[str], want: list[str]) -> None:
    if missing := [c for c in want if c not in have]:
        raise ValueError(f"columns missing: {missing}")
