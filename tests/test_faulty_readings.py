import datetime as dt
import math
from statistics import median

import numpy as np

from seriesloom.operators.faulty_readings import faulty_readings, spike_details, spikes
from seriesloom.operators.regular_grid import local_linear, missing_periods, regular_grid
from seriesloom.runtime import table

READ = "obs_id long, source string, key string, vintage int, pos int, date date, value double, loaded_at timestamp_ntz, extra string"
VINT = "source string, key string, vintage int, timescale string, unit string, obs_id string"


def brute(rows, unit):
    """Faulty obs_ids of one series by the plain definition; rows: (obs_id, date, value, loaded_at)."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and not math.isnan(r[2])]
    rows.sort(key=lambda r: (r[1], r[3] or dt.datetime.max, r[0]))
    seen, values, ids = {}, [], []
    for o, d, v, _ in rows:
        if (d, v) not in seen:
            seen[d, v] = len(values)
            values.append(v)
            ids.append([])
        ids[seen[d, v]].append(o)
    log = unit in ("index", "level", "fx")
    bad = {i for i, v in enumerate(values) if (log and v <= 0) or (unit == "percent" and not 0 <= v <= 100)}
    out = set(bad)
    kept = [i for i in range(len(values)) if i not in bad]
    x = [math.log(values[i]) if log else values[i] for i in kept]
    moves = [abs(b - a) for a, b in zip(x, x[1:]) if a != b]
    if moves:
        t = median(moves)
        for i in range(1, len(x)):
            for w in (1, 2, 3):
                if i + w >= len(x):
                    continue
                a, b, mid = x[i - 1], x[i + w], x[i : i + w]
                if abs(b - a) > 9 * t * (1 + 1e-9):
                    continue
                far = 12 * t * (1 - 1e-9)
                if all(m - a >= far and m - b >= far for m in mid) or all(a - m >= far and b - m >= far for m in mid):
                    out |= {kept[j] for j in range(i, i + w)}
    runs = []
    for i, v in enumerate(values):
        if runs and values[runs[-1][-1]] == v:
            runs[-1].append(i)
        else:
            runs.append([i])
    runs.sort(key=len)
    if runs and len(runs[-1]) >= 8 and (len(runs) == 1 or len(runs[-1]) >= 3 * len(runs[-2])):
        out |= set(runs[-1][1:])
    return {o for i in out for o in ids[i]}


def by_series(r, v):
    units = {(x.key, x.vintage): (x.unit, x.timescale) for x in v.collect()}
    series = {}
    for x in r.select("obs_id", "date", "value", "loaded_at", "key", "vintage").collect():
        series.setdefault((x.key, x.vintage), []).append((x.obs_id, x.date, x.value, x.loaded_at))
    return units, series


def test_matches_brute_force(spark, sf_dir):
    for d in (sf_dir, sf_dir.replace("0.001", "0.01")):
        r, v = table(spark, d, "readings"), table(spark, d, "series_vintages")
        units, series = by_series(r, v)
        want = set().union(*(brute(rows, units.get(k, (None, None))[0]) for k, rows in series.items()))
        got = {x.obs_id for x in faulty_readings(r, v).collect()}
        assert got == want and len(got) > 5


def test_small_blocks_carry_series_over(spark, sf_dir, monkeypatch):
    import seriesloom.operators.series_stream as s

    r, v = table(spark, sf_dir, "readings"), table(spark, sf_dir, "series_vintages")
    want = sorted(x.obs_id for x in faulty_readings(r, v).collect())
    monkeypatch.setattr(s, "BLOCK_ROWS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert sorted(x.obs_id for x in faulty_readings(r, v).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def periods(rows, scale):
    dates = sorted({d for _, d, v, _ in rows if d is not None and v is not None})
    if not dates:
        return set()
    lengths = {"daily": 1, "weekly": 7, "monthly": 30.4, "quarterly": 91.3, "annual": 365.25}
    if scale not in lengths:
        if len(dates) < 2:
            return set()
        m = median((b - a).days for a, b in zip(dates, dates[1:]))
        scale = min(lengths, key=lambda k: abs(lengths[k] - m))
    start = {
        "daily": lambda d: d, "weekly": lambda d: d - dt.timedelta(d.weekday()), "monthly": lambda d: d.replace(day=1),
        "quarterly": lambda d: d.replace(month=(d.month - 1) // 3 * 3 + 1, day=1), "annual": lambda d: d.replace(month=1, day=1),
    }[scale]
    there = {start(d) for d in dates}
    day, out = dates[0], set()
    while day <= dates[-1]:
        out.add(start(day))
        day += dt.timedelta(1)
    return {str(d) for d in out - there}


def test_missing_periods_match_brute_force(spark, sf_dir):
    r, v = table(spark, sf_dir, "readings"), table(spark, sf_dir, "series_vintages")
    units, series = by_series(r, v)
    want = {(*k, p) for k, rows in series.items() for p in periods(rows, units.get(k, (None, None))[1])}
    grid = regular_grid(r, v)
    got = [(x.key, x.vintage, x.period_start) for x in missing_periods(grid).collect()]
    assert set(got) == want and len(got) == len(want)
    assert grid.filter("status = 'missing' and value is not null").count() == 0
    assert grid.filter("status <> 'missing' and value is null").count() == 0


def test_local_linear_is_weighted_least_squares():
    rng = np.random.default_rng(1)
    day = np.sort(rng.integers(0, 200, 60)).astype(float)
    y = rng.normal(size=60)
    grid = np.arange(0, 200, 10.0)
    est, support = local_linear(np.zeros(60, int), day, y, np.zeros(20, int), grid, np.full(20, 25.0))
    for g, e, s in zip(grid, est, support):
        u = (day - g) / 25
        w = np.where(abs(u) < 1, 1 - u * u, 0)
        a = np.c_[np.ones(60), u] * np.sqrt(w)[:, None]
        assert np.isclose(e, np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0][0])
        assert np.isclose(s, w.sum() ** 2 / (w**2).sum())


def test_edge_cases(spark):
    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(i)
    rows, i = [], 0

    def add(key, vintage, values, start=0):
        nonlocal i
        for k, x in enumerate(values):
            i += 1
            rows.append((i, None, key, vintage, k, day(start + k), x, None, "x"))

    add("constant", 1, [5.0] * 9)
    add("one", 1, [1.0])
    add(None, None, [1.0, 2.0, 1.0, 2.0, 90.0, 1.0, 2.0])
    add("neg", 1, [1.0, 1.1, -1.0, 1.2, 1.1, 1.2])
    rows.append((1000, None, "neg", 1, 9, day(2), -1.0, dt.datetime(2001, 1, 1), "x"))  # delivered twice
    rows += [(1001, None, "nil", 1, 1, None, 3.0, None, "x"), (1002, None, "nil", 1, 1, day(1), None, None, "x"), (1003, None, "nil", 1, 1, day(1), float("nan"), None, "x")]
    r = spark.createDataFrame(rows, READ)
    v = spark.createDataFrame([("s", "neg", 1, None, "INDEX ", "q"), ("s", "one", 1, "daily", None, "q"), ("s", "lonely", 4, "daily", "fx", "q")], VINT)
    got = {x.obs_id: (x.impossible, x.spike, x.stuck) for x in faulty_readings(r, v).collect()}
    assert {k for k, x in got.items() if x[2]} == set(range(2, 10))
    assert {k for k, x in got.items() if x[0]} == {20, 1000}
    assert {k for k, x in got.items() if x[1]} == {15}
    assert regular_grid(r, v).filter("key = 'one'").count() == 1
    empty = spark.createDataFrame([], READ), spark.createDataFrame([], VINT)
    assert faulty_readings(*empty).count() == 0 and regular_grid(*empty).count() == 0
    assert faulty_readings(r, empty[1]).count() > 0


def test_each_scale_finds_spikes_of_its_width():
    rng = np.random.default_rng(3)
    x = rng.normal(size=400).cumsum()
    at = {1: 50, 2: 150, 3: 250}
    for w, i in at.items():
        x[i : i + w] += 40 + 3 * rng.normal(size=w)
    sid = np.zeros(400, int)
    for w, i in at.items():
        assert np.flatnonzero(spikes(sid, x, 1, (w,))).tolist() == list(range(i, i + w))
    assert spikes(sid, x, 1).sum() == 6
    flat = spike_details(np.repeat([0, 1], 5), np.repeat([1.0, 9.0], 5), 2)
    assert np.nanmax(np.abs(flat)) == 0 and np.isnan(flat[[0, 3, 4, 5, 8, 9]]).all()  # no wavelet leaves its series


def test_a_date_counts_once_with_its_latest_sound_revision(spark):
    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(i)
    early, late = dt.datetime(2001, 1, 1), dt.datetime(2001, 1, 2)
    rows = [(i, None, "a", 1, i, day(i), 1.0 + i % 2 * 0.1, early, "x") for i in range(12)]
    rows += [(20, None, "a", 1, 2, day(2), 1.0, early, "x"), (21, None, "a", 1, 3, day(3), 1.3, late, "x"), (22, None, "a", 1, 3, day(3), 1.7, None, "x"), (23, None, "a", 1, 6, day(6), -5.0, late, "x")]
    rows = [r for r in rows if r[0] != 8] + [(24, None, "a", 1, 8, day(8), -1.0, late, "x")]  # the eighth day has only an impossible reading
    r = spark.createDataFrame(rows, READ)
    v = spark.createDataFrame([("s", "a", 1, "daily", "index", "q")], VINT)
    got = {x.period_start: x for x in regular_grid(r, v).collect()}
    cell = lambda i: got[str(day(i))]
    assert [cell(i).n_readings for i in range(12)] == [1] * 12 and cell(8).n_sound == 0 and cell(8).status == "filled" and 0.9 < cell(8).value < 1.2
    assert cell(2).observed_mean == 1.0 and cell(3).observed_mean == 1.3 and cell(6).observed_mean == 1.0
    raw = {x.period_start: x for x in regular_grid(r, v, with_faulty=True).collect()}
    assert raw[str(day(6))].observed_mean == -5.0 and raw[str(day(8))].status == "observed"
