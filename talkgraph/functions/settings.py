"""Settings from the environment."""

from __future__ import annotations

import os


def whole(name: str, default: int, least: int | None = None, most: int | None = None) -> int:
    """A whole number from the environment, the default where there is none or no number, kept within its bounds."""
    try:
        value = int(os.environ.get(name, "").strip() or default)
    except ValueError:
        value = default
    value = value if least is None else max(least, value)
    return value if most is None else min(most, value)


def flag(name: str, default: bool = False) -> bool:
    """A yes or no from the environment: 1, true, yes and on mean yes, whatever their case; anything else no."""
    text = os.environ.get(name, "").strip().lower()
    return text in ("1", "true", "yes", "on") if text else default
