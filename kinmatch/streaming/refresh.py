"""A store of vectors refreshed from a source, in order: vendors, a pause, items."""

from __future__ import annotations

import datetime as dt
import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.vectors import Embedder, embed
from ..sources.store import Store, Summary

log = logging.getLogger(__name__)


def refresh(store: Store, rows: DataFrame, embedder: Embedder, text: str = "text") -> Summary:
    """Writes and publishes a new version of all rows with their vectors."""
    return store.write(embed(rows, text, embedder), embedder.name, text=text)


def cycle(vendors: Callable[[], Summary], items: Callable[[], Summary], gap_s: float = 1800, pause: Callable[[float], None] = time.sleep) -> list[Summary | None]:
    """One refresh of both; a failure of the first is logged and the second still runs."""
    done: list[Summary | None] = []
    for i, run in enumerate((vendors, items)):
        if i:
            pause(gap_s)
        try:
            done.append(run())
        except Exception:
            if i:
                raise
            log.exception("the vendors' refresh failed")
            done.append(None)
    return done


def next_run(now: dt.datetime, hours: int = 4) -> dt.datetime:
    """The first slot after a time, as ``functions.schedule.next_slot`` has it."""
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    step = dt.timedelta(hours=hours)
    return midnight + step * ((now - midnight) // step + 1)


class Refresher:
    """Runs a cycle at each slot in a thread of the driver, until it is stopped; a cycle that fails is logged and the next still runs."""

    def __init__(self, run: Callable[[], object], hours: int = 4, at_once: bool = False, now: Callable[[], dt.datetime] = dt.datetime.now):
        self.run, self.hours, self.at_once, self.now = run, hours, at_once, now
        self._stop, self._thread = threading.Event(), None

    def start(self) -> None:
        """Does nothing while the thread runs."""
        if self.running():
            return
        self._stop.clear()
        self._thread = threading.Thread(target=self._loop, name="refresher", daemon=True)
        self._thread.start()

    def running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def stop(self, wait_s: float = 5.0) -> None:
        """Ends the wait for a slot at once; a cycle under way is waited for that long."""
        self._stop.set()
        if self.running():
            self._thread.join(wait_s)

    def wait(self, seconds: float) -> bool:
        """A pause that ``stop`` ends; whether it did. Fits ``cycle`` as its pause."""
        return self._stop.wait(max(0.0, seconds))

    def _once(self) -> None:
        try:
            self.run()
        except Exception:
            log.exception("a refresh failed")

    def _loop(self) -> None:
        if self.at_once:
            self._once()
        while not self._stop.is_set():
            slot = next_run(self.now(), self.hours)
            log.info("next refresh: %s", slot.isoformat(sep=" ", timespec="minutes"))
            if self.wait((slot - self.now()).total_seconds()):
                break
            self._once()
