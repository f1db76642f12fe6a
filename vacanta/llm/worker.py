"""What a Python worker keeps between batches: the tables of one operator at a time.

Workers are reused by later stages; an operator that needs tables of its own, or none, lets go of those of others.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """The object kept under `key`, made if it is not there; anything else is let go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Lets go of everything."""
    _held.clear()
