"""State along a file, cut into segments, against the same state carried line by line."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from timeloom.operators import csv_artifacts, text_logs
from timeloom.operators.segments import Rollover, Table, carried
from timeloom.operators.sequence import months_added
from timeloom.plans.timeline import build_timeline
from timeloom.schema import Context
from timeloom.sources.lines import read_lines

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def years_added(t, n):
    try:
        return t.replace(year=t.year + n)
    except ValueError:
        return t.replace(year=t.year + n, month=3, day=1)


def years_line_by_line(rows, now):
    """(path, line_no, stamp, full) in order to the time of each."""
    out, path, last = {}, None, None
    for p, i, stamp, full in sorted(rows, key=lambda r: r[:2]):
        if p != path:
            path, last = p, None
        out[p, i] = None
        if full is not None:
            out[p, i] = last = full
        elif stamp is not None:
            try:
                t = datetime.strptime(f"{now.year} {' '.join(stamp.split())}", "%Y %b %d %H:%M:%S").replace(tzinfo=timezone.utc)
            except ValueError:
                last = now
                continue
            if now.month <= 2 and t.month >= 11 or t > months_added(now, 6):
                t = years_added(t, -1)
            if last is not None and t < last - timedelta(days=30) and abs(years_added(t, 1) - last) < abs(t - last):
                t = years_added(t, 1)
            out[p, i] = last = t
    return out


def make_stamps(seed, files=5, lines=300):
    rng, rows = random.Random(seed), []
    for f in range(files):
        t = datetime(2023, rng.randint(1, 12), 1)
        for i in range(1, lines):
            t += timedelta(hours=rng.randint(0, 40)) if rng.random() < 0.9 else timedelta(days=rng.randint(-200, 200))
            stamp = rng.choice([f"{MONTHS[t.month - 1]} {t.day:2d} {t:%H:%M:%S}"] * 30 + ["Feb 30 00:00:00", "Feb 29 00:00:00", "Jan 01 25:00:00", None])
            full = t.replace(tzinfo=timezone.utc) if rng.random() < 0.05 else None
            rows.append((f"f{f}", i, None if full else stamp, full))
    return rows


@pytest.mark.parametrize("now, stretch", [(datetime(2024, 1, 31, tzinfo=timezone.utc), 7), (datetime(2023, 7, 31, tzinfo=timezone.utc), 1 << 16)])
def test_years_in_segments(spark, monkeypatch, now, stretch):
    rows = make_stamps(stretch)
    df = spark.createDataFrame(rows, "path string, line_no bigint, stamp string, full_ts timestamp").repartition(3)
    monkeypatch.setattr(text_logs, "carried", lambda *a: carried(*a, stretch=stretch))
    got = {(r.path, r.line_no): r.us for r in text_logs.dated(df, Context(now)).select("path", "line_no", F.unix_micros("ts").alias("us")).collect()}
    assert got == {k: None if t is None else (t - EPOCH) // timedelta(microseconds=1) for k, t in years_line_by_line(rows, now).items()}


def test_years_of_a_few_lines():
    now = datetime(2024, 1, 31, tzinfo=timezone.utc)
    stamps = ["Dec 31 23:59:59", "Jan  1 00:00:00", "Feb 29 00:00:00", "Feb 30 00:00:00"]
    got = years_line_by_line([("p", i, s, None) for i, s in enumerate(stamps)], now)
    assert [t and t.year for t in got.values()] == [2023, 2024, 2024, None]
    assert years_added(datetime(2024, 2, 29), -1) == datetime(2023, 3, 1) and months_added(datetime(2023, 8, 31), 6) == datetime(2024, 3, 2)


@pytest.mark.parametrize("cut", [0, 1, 5, 17])
def test_effects_compose(cut):
    """A rollover's effect over the parts of a segment, composed, is its effect over the whole."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(cut)
    year = 365 * 86_400_000_000
    low = rng.integers(0, 2 * year, 40)
    high = low + np.where(rng.random(40) < 0.2, 0, year)
    column = lambda x: pa.array(x, mask=rng.random(len(x)) < 0).cast(pa.timestamp("us"))
    for before in (None, 0, year // 2, year, 3 * year):
        m, state = Rollover(), before
        for a, b in ((0, cut), (cut, 40)):
            take, done = m.effect()
            take([column(low[a:b]), column(high[a:b])])
            state = m.after(done(), state)
        late = m.run(before)([column(low), column(high)]).to_pylist()
        assert state == int((high if late[-1] else low)[-1])
        last = before
        for lo, hi, got in zip(low.tolist(), high.tolist(), late, strict=True):
            want = last is not None and 2 * last > lo + hi
            assert got == want
            last = hi if want else lo


def test_forms_of_csv_times_in_segments(spark):
    """1/2/2024 is read by the form of the last row that settles it, wherever a segment begins."""
    rng = random.Random(4)
    texts = [rng.choice(["1/2/2024 10:00:00", "13/2/2024 10:00:00", "2/13/2024 10:00:00", "2024-01-02 03:04:05", "1682087445", "x", ""]) for _ in range(400)]
    m = csv_artifacts.sticky_times()
    state, want = m.initial, []
    for t in texts:
        state, got = m.step(state, [t, None])
        want.append(got)
    df = spark.createDataFrame([("p", i, [t, None]) for i, t in enumerate(texts)], "path string, line_no bigint, candidates array<string>").repartition(3)
    got = [r.ts for r in carried(df, m, "ts", stretch=11).orderBy("line_no").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts")).collect()]
    assert got == [None if t is None else f"{t:%Y-%m-%dT%H:%M:%S}" for t in want]


def test_lines_out_of_order_are_an_error(spark):
    df = spark.createDataFrame([("p", 2, "a", 0), ("p", 1, "a", 0)], "path string, line_no bigint, v string, block bigint").coalesce(1)
    with pytest.raises(Exception, match="don't ascend"):
        carried(df, Table("v", "string", None, 1, lambda s, v: (0, v)), "out").collect()


def shuffled_records(spark, run):
    """Records that all stages of ``run`` have written to shuffles, by the status store."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    listed = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())

    def stages():
        found = listed()
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(n for k, n in stages().items() if k not in before)


def test_lines_of_files_stay_in_their_splits(spark, tmp_path):
    """Neither numbers nor years shuffle lines: a row or two a split is all, and one long file is many tasks."""
    rng, now = random.Random(9), datetime(2024, 3, 1, tzinfo=timezone.utc)
    rows = [r for r in make_stamps(9, 3, 3000) if r[2] and "25:00" not in r[2]]
    for f in sorted({r[0] for r in rows}):
        (tmp_path / f"{f}.syslog").write_text("".join(f"{stamp} host app: message {i}\n" + "\n" * (rng.random() < 0.1) for p, i, stamp, _ in rows if p == f))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        numbered, moved = shuffled_records(spark, lambda: read_lines(spark, [str(tmp_path)]).collect())
        assert 15 < moved < 60 and len(numbered) == len(rows)
        events, moved = shuffled_records(spark, lambda: text_logs.syslog(read_lines(spark, [str(tmp_path)]), Context(now)).collect())
        assert moved < 150 and read_lines(spark, [str(tmp_path)]).rdd.getNumPartitions() > 15
        joined = read_lines(spark, [str(tmp_path)], most_broadcast=0)
        assert "block" not in joined.columns
        assert {(r.path, r.line_no, r.line) for r in joined.collect()} == {(r.path, r.line_no, r.line) for r in numbered}
        timeline = build_timeline(spark, str(tmp_path), context=Context(now), only={"syslog"}).events.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = years_line_by_line([(p, i, s, None) for p, i, s, _ in rows], now)
    got = {(r.source.removesuffix(".syslog"), int(r.message.split()[-1])): r.timestamp for r in events}
    utc = lambda t: None if t is None else t.replace(tzinfo=None)
    assert len(got) == len(rows) and all(utc(want[k]) == t for k, t in got.items() if want[k] is not None) and timeline in (0, len(rows))


def test_short_segments_are_taken_at_once():
    """Many segments in a batch have the effects and rows that each would have alone."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    year, edges = 365 * 86_400_000_000, [0, 1, 2, 7, 8, 20, 21, 40]
    low = rng.integers(0, 2 * year, 40)
    high = low + np.where(rng.random(40) < 0.2, 0, year)
    none = rng.random(40) < 0.2
    none[[1, 7]], none[0] = True, False  # segments without any time
    columns = [pa.array(x, mask=none).cast(pa.timestamp("us")) for x in (low, high)]
    states = [None, 5 * year, year, 0, 2 * year, year // 2, None]
    m, effects, runs = Rollover(), [], []
    for a, b, state in zip(edges[:-1], edges[1:], states, strict=True):
        take, done = m.effect()
        take([c.slice(a, b - a) for c in columns])
        effects.append(done())
        runs += m.run(state)([c.slice(a, b - a) for c in columns]).to_pylist()
    assert m.effects(columns, edges) == effects and m.runs(columns, edges, states).to_pylist() == runs


def test_years_in_many_short_files(spark, monkeypatch):
    now, rows = datetime(2024, 1, 31, tzinfo=timezone.utc), make_stamps(11, 400, 4) + make_stamps(12, 3, 60)
    rows = [(f"{p}-{i % 2}" if len(p) > 3 else p, i, s, f) for p, i, s, f in {r[:2]: r for r in rows}.values()]
    df = spark.createDataFrame(rows, "path string, line_no bigint, stamp string, full_ts timestamp").repartition(3)
    monkeypatch.setattr(text_logs, "carried", lambda *a: carried(*a, stretch=9))
    got = {(r.path, r.line_no): r.us for r in text_logs.dated(df, Context(now)).select("path", "line_no", F.unix_micros("ts").alias("us")).collect()}
    assert got == {k: None if t is None else (t - EPOCH) // timedelta(microseconds=1) for k, t in years_line_by_line(rows, now).items()}
