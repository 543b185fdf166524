"""The backlog form of the hysteresis stream against plain Python."""

import datetime as dt
import random

from sparkfolio.streaming import jobs

EVENTS = "event_id long, ts timestamp, user_id long, value double"


def plain(rows, band, cut):
    held, out = {}, []
    for event, ts, ticker, v in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[1] is None, r[1] or dt.datetime.min, r[0])):
        now = "HIGH" if v > cut else "LOW"
        if ticker not in held or (now != held[ticker] and abs(v - cut) > band):
            held[ticker] = now
        out.append((ticker, event, held[ticker]))
    return sorted(out, key=repr)


def test_tiers_of_a_backlog_against_plain_python(spark):
    rnd = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    value = lambda: rnd.choice([None, float("nan"), 40.0, 60.0, rnd.uniform(30, 70), rnd.uniform(45, 55), rnd.uniform(45, 55)])
    rows = [(i, rnd.choice([start + dt.timedelta(minutes=10 * rnd.randrange(900)), start, None]), rnd.choice([0, 0, 0, 1, 2, None]), value()) for i in range(1500)]
    got = jobs.hysteresis_tiers_of_table(spark.createDataFrame(rows, EVENTS))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, 10.0, 50.0)
    assert jobs.hysteresis_tiers_of_table(spark.createDataFrame([], EVENTS)).count() == 0


def test_tier_query_sends_no_history_to_a_python_worker(spark, monkeypatch):
    from sparkfolio.plans import registry

    monkeypatch.setattr(jobs, "hysteresis_tiers", None)
    df = registry.QUERIES["st5_tier_stream"](spark, "/root/testdata/sf0.001")
    rows = [(r.event_id, r.ts, r.user_id, r.value) for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == plain(rows, 10.0, 50.0)


def in_batches(spark, tmp_path, rows, schema, n=3):
    """The rows as a stream of ``n`` files, one a batch."""
    for k in range(n):
        part = rows[k * len(rows) // n : (k + 1) * len(rows) // n]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_cards_keep_their_tier_over_batches_and_lose_it_over_days(spark, tmp_path):
    from sparkfolio.plans.more import BAND, held_tiers

    rnd = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    rows = sorted(((t, i, start + dt.timedelta(minutes=7 * i), rnd.uniform(-2, 2)) for i in range(600) for t in [i % 3]), key=lambda r: r[2])
    stream = in_batches(spark, tmp_path, rows, "ticker long, event_id long, ts timestamp, score double")
    with jobs.with_state(spark):
        out = jobs.run_to_table(jobs.rated_cards(stream, lambda scores, held: held_tiers(scores, BAND, held)))
    want = []
    for ticker in range(3):
        for day in sorted({r[2].date() for r in rows}):
            own = [r for r in rows if r[0] == ticker and r[2].date() == day]
            tiers = held_tiers([r[3] for r in own])
            want += [(ticker, r[1], tier, k > 0 and tiers[k - 1] != tier) for k, (r, tier) in enumerate(zip(own, tiers, strict=True))]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_bars_and_moods_over_batches(spark, tmp_path):
    rnd = random.Random(10)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=rnd.randrange(3000)), i % 4, float(rnd.randrange(100))) for i in range(900)]
    events = in_batches(spark, tmp_path, rows, EVENTS)
    latest = {}
    for i, ts, ticker, v in rows:
        latest[ticker, ts] = max(latest.get((ticker, ts), (-1, 0.0)), (i, v))
    got = {(r.ticker, r.minute): (r.id, r.close) for r in jobs.bars_table(events).collect()}
    assert got == latest
    moods = jobs.run_updates(jobs.trailing_mood(events, "2 hours", "1 hour", late="10 days"), ["at", "ticker"])
    sums = {}
    for _, ts, ticker, v in rows:
        hour = ts.replace(minute=0, second=0)
        for end in (hour + dt.timedelta(hours=1), hour + dt.timedelta(hours=2)):
            n, s = sums.get((end, ticker), (0, 0.0))
            sums[end, ticker] = (n + 1, s + v)
    assert {(r["at"], r.ticker): (r.n, round(r["mean"], 6)) for r in moods.collect()} == {k: (n, round(s / n, 6)) for k, (n, s) in sums.items()}


def test_moods_of_slices_against_plain_python(spark, tmp_path, monkeypatch):
    """Slices add up over batches; a mood is given out for each end in a day of an event, and for no other.  No event is in 96 windows of a state."""
    from sparkfolio.plans import registry

    rnd = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    times = [start + dt.timedelta(minutes=k) for k in (0, 15, 30, 1440, 1455, 2895)] + [start + dt.timedelta(seconds=rnd.randrange(7 * 86400)) for _ in range(90)]
    rows = [(i, t, rnd.choice([0, 0, 1, None]), rnd.choice([None, 1.5, 40.0, 0.25])) for i, t in enumerate([*times, *times[:9], None])]
    rnd.shuffle(rows)
    sums = {}
    for _, ts, ticker, v in rows:
        if ts:
            quarter = start + (ts - start) // dt.timedelta(minutes=15) * dt.timedelta(minutes=15)
            for k in range(1, 97):
                sums.setdefault((quarter + k * dt.timedelta(minutes=15), ticker), []).append(v)
    known = lambda x: [v for v in x if v is not None]
    want = {k: (len(x), sum(known(x)) / len(known(x)) if known(x) else None) for k, x in sums.items()}
    moods = jobs.moods_of_slices(jobs.mood_slices(in_batches(spark, tmp_path, rows, EVENTS))).collect()
    assert len(moods) == len(want) and {(r["at"], r.ticker): (r.n, r["mean"]) for r in moods} == want
    spark.createDataFrame([], EVENTS).write.parquet(f"{tmp_path}/none/events.parquet")
    assert jobs.moods_of_slices(jobs.mood_slices(jobs.read_events(spark, f"{tmp_path}/none"))).count() == 0
    monkeypatch.setattr(jobs, "trailing_mood", None)
    assert registry.QUERIES["st2_mood_stream"](spark, "/root/testdata/sf0.001").count() > 0


def test_cards_go_on_after_a_restart_and_their_state_ends_with_the_day(spark, tmp_path):
    """A second run takes up the held tiers; the state reader shows those of days the watermark has not left, and no others."""
    from sparkfolio.plans.more import BAND, held_tiers

    rnd = random.Random(12)
    start = dt.datetime(2024, 1, 1)
    schema = "ticker long, event_id long, ts timestamp, score double"
    rows = [(i % 2, i, start + dt.timedelta(minutes=41 * i), rnd.uniform(-2, 2)) for i in range(300)]  # eight and a half days
    rate = lambda scores, held: held_tiers(scores, BAND, held)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")

    def put(k, part):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    cut = next(k for k, r in enumerate(rows) if r[2].date() == dt.date(2024, 1, 4)) + 9  # in the middle of a day
    put(0, rows[:40])
    put(1, rows[40:cut])
    with jobs.with_state(spark):
        jobs.run_to_table(jobs.rated_cards(source.parquet(f"{tmp_path}/in"), rate), f"{tmp_path}/out")
        put(2, rows[cut:250])
        put(3, rows[250:])
        out = jobs.run_to_table(jobs.rated_cards(source.parquet(f"{tmp_path}/in"), rate), f"{tmp_path}/out")
    want = []
    for ticker in range(2):
        for day in sorted({r[2].date() for r in rows}):
            own = [r for r in rows if r[0] == ticker and r[2].date() == day]
            tiers = held_tiers([r[3] for r in own])
            want += [(ticker, r[1], tier, k > 0 and tiers[k - 1] != tier) for k, (r, tier) in enumerate(zip(own, tiers, strict=True))]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    held = spark.read.format("statestore").option("path", f"{tmp_path}/out/state").option("stateVarName", "held").load()
    left = {(r["key"]["ticker"], r["key"]["day"]): r["value"]["tier"] for r in held.collect()}
    days = sorted({r[2].date() for r in rows})
    assert {d for _, d in left} == set(days[-3:])
    last = {(t, d): [w[2] for w in want if w[0] == t and rows[w[1]][2].date() == d][-1] for t, d in left}
    assert left == last


def test_cards_by_batch_keep_their_tier_over_batches_and_restarts(spark, tmp_path):
    """A held tier passes from batch to batch and over a restart; no ticker's day is a call of its own; days that are over leave the table."""
    from sparkfolio.plans.more import BAND, held_tiers

    rnd = random.Random(14)
    start = dt.datetime(2024, 1, 1)
    schema = "ticker long, event_id long, ts timestamp, score double"
    rows = [(rnd.randrange(3), i, start + dt.timedelta(minutes=7 * (i // 2)), rnd.uniform(-2, 2)) for i in range(2400)]  # pairs at one time
    rate = lambda scores, held: held_tiers(scores, BAND, held)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    for k, (a, z) in enumerate([(0, 500), (500, 1100), (1100, 1101), (1101, 2400)]):
        spark.createDataFrame(rnd.sample(rows[a:z], z - a), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        out = jobs.rated_cards_by_batch(source.parquet(f"{tmp_path}/in"), rate, at=f"{tmp_path}/out")
    want = []
    for ticker in range(3):
        for day in sorted({r[2].date() for r in rows}):
            own = sorted((r for r in rows if r[0] == ticker and r[2].date() == day), key=lambda r: (r[2], r[1]))
            tiers = held_tiers([r[3] for r in own])
            want += [(ticker, r[1], tier, k > 0 and tiers[k - 1] != tier) for k, (r, tier) in enumerate(zip(own, tiers, strict=True))]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    held = {(r.ticker, r.day): r.tier for r in spark.read.parquet(f"{tmp_path}/out/held/part=3").collect()}
    days = sorted({r[2].date() for r in rows})
    assert {d for _, d in held} == set(days[-3:])


def test_card_query_makes_no_call_for_each_day(spark, monkeypatch):
    from sparkfolio.plans import registry

    monkeypatch.setattr(jobs, "rated_cards", None)
    assert registry.QUERIES["st5_card_stream"](spark, "/root/testdata/sf0.001").count() > 0
