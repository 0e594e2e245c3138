"""One interval between calls to a source, kept by many tasks at once.

Time from a common start is cut into slots of the interval, and slots are dealt to lanes in turn. A task waits for the next slot of
its lane, so no two lanes call in one slot whenever tasks start, end or run again, and when all lanes work every slot is used. Nothing
is shared but the start, so a lost task or executor holds up nobody. It rests on clocks that agree to a small part of the
interval, as machines of a cluster have, and on a lane being run once at a time (no speculation).
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Lanes:
    start: float
    interval: float
    lanes: int

    def slot(self, lane: int, after: float) -> float:
        """When the first slot of a lane begins that begins after a time."""
        turn = self.interval * self.lanes
        first = self.start + lane * self.interval
        return first + max(0, math.floor((after - first) / turn) + 1) * turn if after >= first else first


class Pace:
    """The waits of one lane."""

    def __init__(self, lanes: Lanes, lane: int, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        self.lanes, self.lane, self.clock, self.sleep, self.last = lanes, lane % lanes.lanes, clock, sleep, -math.inf

    def wait(self) -> None:
        if self.lanes.interval <= 0:
            return
        self.last = self.lanes.slot(self.lane, max(self.clock(), self.last))
        while (left := self.last - self.clock()) > 0:
            self.sleep(left)
