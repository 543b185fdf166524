"""Stored state over several runs, and over runs that died."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import upkeep
from sparkfolio.sources.versions import Conflict, DatedTable, Manifest

D = [dt.date(2024, 3, 1) + dt.timedelta(days=i) for i in range(30)]
SCHEMA = "ticker long, date date, hit boolean"


@pytest.fixture
def manifest(spark, tmp_path):
    return Manifest(spark, str(tmp_path / "m"))


@pytest.fixture
def verdicts(spark, tmp_path):
    return DatedTable(spark, str(tmp_path / "v"), SCHEMA)


def rows(spark, days, hit=True, tickers=(1, 2)):
    return spark.createDataFrame([(t, d, hit) for d in days for t in tickers], SCHEMA)


def content(table, **which):
    return {(r["ticker"], r["date"]): r["hit"] for r in table.read(**which).collect()}


def test_of_two_writers_one_fails(manifest):
    assert manifest.read() == (0, {})
    assert manifest.commit(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        manifest.commit(0, {"a": 2})
    assert manifest.read() == (1, {"a": 1})
    assert manifest.commit(1, {"a": 3}) == 2 and manifest.read(1) == (1, {"a": 1})
    assert [n for n in manifest.names(manifest.path) if n.startswith("aside")] == []


def test_dates_are_replaced_as_a_whole(spark, verdicts):
    assert verdicts.dates() == [] and verdicts.read().count() == 0
    assert verdicts.replace(rows(spark, D[:3])) == D[:3]
    verdicts.replace(rows(spark, D[2:4], False, (7,)))
    assert content(verdicts) == {(t, d): True for d in D[:2] for t in (1, 2)} | {(7, d): False for d in D[2:4]}
    assert verdicts.upsert(rows(spark, D[2:3], True, (8,)), ["ticker", "date"]) == [D[2]]
    assert content(verdicts, dates=[D[2]]) == {(7, D[2]): False, (8, D[2]): True}
    assert verdicts.upsert(rows(spark, []), ["ticker", "date"]) == []


def test_reads_open_the_folders_of_their_dates_alone(spark, verdicts):
    verdicts.replace(rows(spark, D))
    files = lambda df: {f.split("_day=")[1][:10] for f in df.inputFiles()}
    assert files(verdicts.read(since=D[27])) == {d.isoformat() for d in D[27:]}
    assert files(verdicts.read(until=D[0])) == {D[0].isoformat()}
    assert verdicts.read(since=dt.date(2025, 1, 1)).count() == 0


def test_a_write_that_died_leaves_the_table_as_it_was(spark, verdicts, monkeypatch):
    verdicts.replace(rows(spark, D[:2]))
    before = content(verdicts)

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(verdicts.manifest, "commit", dies)
        with pytest.raises(OSError):
            verdicts.replace(rows(spark, D[:5], False))
    assert content(verdicts) == before and verdicts.dates() == D[:2]
    assert len(verdicts.vacuum()) == 5 and verdicts.vacuum() == []
    assert content(verdicts) == before


def live(spark, known, scans):
    """Verdicts of all dates known so far; one of them comes late."""

    def ask(after):
        days = [d for d in D[:known] if after is None or d > after]
        scans.append(days)
        late = [] if known < 20 else [d for d in [D[9]] if d in days]
        return rows(spark, days).unionAll(rows(spark, late, False, (3,)))

    return ask


def test_two_runs_on_growing_input_equal_one(spark, verdicts, tmp_path):
    scans = []
    assert upkeep.materialise(verdicts, live(spark, 15, scans)) is None
    after = upkeep.materialise(verdicts, live(spark, 30, scans))
    assert after == D[14] - dt.timedelta(days=upkeep.TAIL) and scans[1] == D[5:]
    whole = DatedTable(spark, str(tmp_path / "w"), SCHEMA)
    upkeep.materialise(whole, live(spark, 30, scans), full=True)
    assert content(verdicts) == content(whole) and (3, D[9]) in content(verdicts)
    before = content(verdicts)
    upkeep.materialise(verdicts, live(spark, 30, scans))
    assert content(verdicts) == before


def test_a_stored_verdict_that_is_not_found_again_stays(spark, verdicts):
    verdicts.replace(rows(spark, D[:12]))
    upkeep.materialise(verdicts, lambda after: rows(spark, [D[11]], False, (1,)))
    assert content(verdicts) == {(t, d): True for d in D[:12] for t in (1, 2)} | {(1, D[11]): False}


def test_signals_go_up_to_the_stored_verdicts(spark, verdicts, tmp_path):
    signals = DatedTable(spark, str(tmp_path / "s"), SCHEMA)
    signals.replace(rows(spark, D))
    assert upkeep.prune(signals, verdicts, D[-1], 5) == [] and signals.dates() == D
    verdicts.replace(rows(spark, D[:10]))
    assert upkeep.prune(signals, verdicts, D[-1], 5) == D[:10] and signals.dates() == D[10:]
    verdicts.replace(rows(spark, D))
    assert upkeep.prune(signals, verdicts, D[-1], 5) == D[10:24] and signals.dates() == D[24:]
    assert signals.manifest.names(f"{signals.path}/data") != []
    assert content(signals) == {(t, d): True for d in D[24:] for t in (1, 2)}


def test_retention_that_died_between_its_steps_is_made_good(spark, verdicts, tmp_path, monkeypatch):
    signals = DatedTable(spark, str(tmp_path / "s"), SCHEMA)
    signals.replace(rows(spark, D))
    verdicts.replace(rows(spark, D))

    def dies():
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(signals, "vacuum", dies)
        with pytest.raises(OSError):
            upkeep.prune(signals, verdicts, D[-1], 5)
    assert signals.dates() == D[24:]
    folders = lambda: [n for b in signals.manifest.names(f"{signals.path}/data") for n in signals.manifest.names(f"{signals.path}/data/{b}") if n.startswith("_day=")]
    assert len(folders()) == 30
    assert upkeep.prune(signals, verdicts, D[-1], 5) == [] and len(folders()) == 6


def test_items_go_by_their_moment(spark, tmp_path):
    items = DatedTable(spark, str(tmp_path / "i"), "item_id long, published_at timestamp, date date")
    at = [dt.datetime(2024, 3, d, h) for d in (1, 2, 3) for h in (0, 12)]
    items.replace(spark.createDataFrame([(i, t, t.date()) for i, t in enumerate(at)], items.schema))
    upkeep.prune_items(items, "published_at", dt.datetime(2024, 3, 2, 6))
    assert {r["item_id"] for r in items.read().collect()} == {3, 4, 5}
    upkeep.prune_items(items, "published_at", dt.datetime(2024, 3, 2, 13))
    assert {r["item_id"] for r in items.read().collect()} == {4, 5} and items.dates() == [dt.date(2024, 3, 3)]


def test_weights_day_by_day(spark, manifest):
    state = lambda: upkeep.WeightState(Manifest(spark, manifest.path), 3, 0.05)  # noqa: E731  a new run each day
    state().seed("base", {"a": 1.0})
    state().seed("base", {"a": 9.0})
    ics = [(0.1, 0.2)] * 3 + [(0.1, 0.16), (0.1, 0.14), (0.3, -0.1), (None, 0.1), (0.1, None)]
    seen = [state().step(d, {"base": x, "next": y}, "next", {"a": 2.0}) for d, (x, y) in zip(D, ics, strict=False)]
    assert [s["action"] for s in seen] == ["", "", "promote", "", "rollback", "", "", ""]
    assert [s["live"] for s in seen] == ["base", "base", "next", "next", "base", "base", "base", "base"]
    assert [s["streak"] for s in seen] == [1, 2, 0, 1, 2, 0, 1, 0]
    assert seen[2]["weights"] == {"a": 2.0} and seen[4]["weights"] == {"a": 1.0}
    version, last = manifest.read()
    assert state().step(D[7], {"base": 0.0, "next": 9.0}, "next", {"a": 5.0}) == last and manifest.version() == version == 9


def test_of_two_runs_of_one_day_one_counts(spark, manifest):
    one, two = (upkeep.WeightState(Manifest(spark, manifest.path), 3, 0.05) for _ in range(2))
    one.seed("base", {"a": 1.0})
    stale = two.manifest.read()
    one.step(D[0], {"base": 0.1, "next": 0.2}, "next", {"a": 2.0})
    two.manifest.read = lambda: stale
    with pytest.raises(Conflict):
        two.step(D[0], {"base": 0.1, "next": 0.2}, "next", {"a": 2.0})
    assert manifest.version() == 2


def test_only_a_local_master_may_stage_without_a_shared_folder(spark, monkeypatch):
    from sparkfolio.functions import staging

    class Fake:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        staging.shared_folder(Fake)
    assert F.lit(1) is not None
