"""Notices: decisions and doubts that a run wants to tell, on one channel."""

from __future__ import annotations

import logging
from collections.abc import Callable

_heard: list[Callable[[str, dict], None]] = []
_told: set[str] = set()


def on_notice(hear: Callable[[str, dict], None]) -> Callable[[], None]:
    """Call `hear` with every later notice; the result ends that."""
    _heard.append(hear)
    return lambda: _heard.remove(hear)


def notice(kind: str, **facts) -> None:
    """Tell all who listen; if nobody does, the log gets the first notice of each kind."""
    for hear in list(_heard):
        hear(kind, facts)
    if not _heard and kind not in _told:
        _told.add(kind)
        logging.getLogger("keelson").warning("%s %s", kind, facts)
