"""Daily jobs on stored tables: verdicts that follow the signals, retention, and the weights in force."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.sources.versions import DatedTable, Manifest

#: Days before the last stored verdict that a run scans anew, for verdicts that came late.
TAIL = 10


def materialise(stored: DatedTable, live: Callable[[dt.date | None], DataFrame], *, full: bool = False) -> dt.date | None:
    """Upsert the verdicts (ticker, date, hit) of ``live``, which is asked for those after a date; None asks for all.

    The date is ten days before the last stored one, so a run reads the tail and what is new, and rewrites the dates it
    found verdicts for.  Stored verdicts that are not found again stay.  Gives the date.
    """
    last = None if full else stored.last()
    after = last and last - dt.timedelta(days=TAIL)
    stored.upsert(live(after), ["ticker", "date"])
    return after


def prune(signals: DatedTable, verdicts: DatedTable, today: dt.date, days: int) -> list[dt.date]:
    """Drop the dates of ``signals`` older than ``days`` whose verdicts are stored; none where no verdict is.

    The dates leave the table in one version, then their folders go; a run that died between is made good by the next one.
    """
    through = verdicts.last()
    old = [] if through is None else [d for d in signals.dates() if d < today - dt.timedelta(days=days) and d <= through]
    gone = signals.drop(old)
    signals.vacuum()
    return gone


def prune_items(items: DatedTable, time: str, oldest: dt.datetime) -> list[dt.date]:
    """Drop items before a moment: whole dates without being read, of the moment's own date the rows before it."""
    gone = items.drop([d for d in items.dates() if d < oldest.date()])
    edge = [d for d in items.dates() if d == oldest.date()]
    if edge:
        kept = items.read(dates=edge).where(F.col(time) >= F.lit(oldest))
        if kept.isEmpty():
            gone += items.drop(edge)
        else:
            items.replace(kept)
    items.vacuum()
    return gone


class WeightState:
    """The weights in force, over runs: promotion and rollback move to another set, each in a new version.

    A version holds the day it was made by, the live set's name and weights, the streak of good days, and the
    promotions that were not rolled back, with what was live before and the baseline they have to keep to.
    """

    def __init__(self, manifest: Manifest, streak: int, degraded: float):
        self.manifest, self.streak, self.degraded = manifest, streak, degraded

    def seed(self, name: str, weights: Mapping[str, float]) -> None:
        """The first weights; nothing where there are some."""
        version, state = self.manifest.read()
        if not state:
            self.manifest.commit(version, {"day": "", "live": name, "weights": dict(weights), "streak": 0, "promotions": [], "action": "seed"})

    def step(self, day: dt.date, ic: Mapping[str, float | None], name: str, weights: Mapping[str, float]) -> dict:
        """One day's decision from the IC of the sets by their names, ``name`` being the candidate; gives the new state.

        First a live set below its promotion's baseline is rolled back to what was live before; then a candidate with
        a positive IC no less than the live one's adds to the streak and goes live at its end.  A day that was done before
        changes nothing.
        """
        version, state = self.manifest.read()
        if day.isoformat() <= state["day"]:
            return state
        new = state | {"day": day.isoformat(), "action": ""}
        now = ic.get(new["live"])
        if new["promotions"] and now is not None and now < new["promotions"][-1]["baseline"] - self.degraded:
            before = new["promotions"][-1]
            new |= {"live": before["live"], "weights": before["weights"], "promotions": new["promotions"][:-1], "action": "rollback"}
            now = ic.get(new["live"])
        mine = ic.get(name)
        good = mine is not None and mine > 0 and (now is None or mine >= now)
        new["streak"] = new["streak"] + 1 if good else 0
        if new["streak"] >= self.streak:
            before = {"live": new["live"], "weights": new["weights"], "baseline": mine}
            new |= {"live": name, "weights": dict(weights), "streak": 0, "promotions": [*new["promotions"], before], "action": (new["action"] + " promote").strip()}
        self.manifest.commit(version, new)
        return new
