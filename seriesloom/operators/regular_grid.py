"""Irregular readings onto a regular grid, one row for each period of a series' timescale.

Method: compact-kernel (Epanechnikov) weighted local linear regression, evaluated at the middle of each
period from the readings that an index search finds within the bandwidth. Each row carries its effective
support, and a mark where the support is too small for an estimate. A date counts once, with its latest
revision, and faulty readings (see ``faulty_readings``) take no part in means and estimates unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.faulty_readings import group_medians, judge
from seriesloom.operators.series_stream import Block, map_series, ranges, series_rows

#: Nominal length in days of each timescale, shortest first.
LENGTHS = {"daily": 1.0, "weekly": 7.0, "monthly": 30.4, "quarterly": 91.3, "annual": 365.25}
SCALES = list(LENGTHS)
#: Half-width of the kernel in periods, and the least effective support of an estimate.
BANDWIDTH, LEAST_SUPPORT = 2.5, 1.5
#: Pairs of grid time and reading handled at once.
PAIRS = 500_000

SCHEMA = "key string, vintage int, period_start string, n_readings int, n_sound int, observed_mean double, value double, effective_support double, status string"


def period_of(scale: int, day: np.ndarray) -> np.ndarray:
    """Number of the period that holds each day (days since 1970-01-01)."""
    if scale == 0:
        return day
    if scale == 1:
        return (day + 3) // 7  # 1970-01-01 was a Thursday; weeks begin on Monday
    month = day.astype("M8[D]").astype("M8[M]").astype("int64")
    return month // (1, 3, 12)[scale - 2]


def start_of(scale: int, period: np.ndarray) -> np.ndarray:
    """First day of each period."""
    if scale == 0:
        return period
    if scale == 1:
        return period * 7 - 3
    return (period * (1, 3, 12)[scale - 2]).astype("M8[M]").astype("M8[D]").astype("int64")


def scales_of(b: Block) -> np.ndarray:
    """Timescale number of each series: as given, else that nearest to the median distance of its distinct dates; -1 for none."""
    out = np.array([SCALES.index(t) if t in LENGTHS else -1 for t in b.timescale], int)
    new = np.ones(len(b.sid), bool)
    new[1:] = (b.sid[1:] != b.sid[:-1]) | (b.day[1:] != b.day[:-1])
    s, d = b.sid[new], b.day[new]
    same = s[1:] == s[:-1]
    gap = group_medians(s[1:][same], (d[1:] - d[:-1])[same].astype(float), b.count)
    guess = np.argmin(np.abs(np.nan_to_num(gap)[:, None] - np.array(list(LENGTHS.values()))), axis=1)
    return np.where(out >= 0, out, np.where(np.isnan(gap), -1, guess))


def local_linear(rsid: np.ndarray, rday: np.ndarray, rvalue: np.ndarray, gsid: np.ndarray, gday: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimate and effective support at each grid time; readings are sorted by series and day."""
    span = 8_000_000.0
    index = rsid * span + rday + 1_000_000
    at = gsid * span + gday + 1_000_000
    lo, hi = np.searchsorted(index, at - width, "right"), np.searchsorted(index, at + width, "left")
    counts = np.maximum(hi - lo, 0)
    value, support = np.full(len(gsid), np.nan), np.zeros(len(gsid))
    done, total = 0, np.cumsum(counts)
    while done < len(gsid):
        end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
        c = counts[done:end]
        g = np.repeat(np.arange(end - done), c)
        r = np.repeat(lo[done:end], c) + ranges(c)
        u = (rday[r] - gday[done:end][g]) / width[done:end][g]
        w = 1 - u * u
        y = rvalue[r]
        s0, s1, s2, q0, q1, ww = (np.bincount(g, x, end - done) for x in (w, w * u, w * u * u, w * y, w * u * y, w * w))
        with np.errstate(all="ignore"):
            det = s0 * s2 - s1 * s1
            line = (s2 * q0 - s1 * q1) / det
            value[done:end] = np.where(det > 1e-9 * s0 * s0, line, q0 / s0)  # readings at one time: the weighted mean
            support[done:end] = np.where(ww > 0, s0 * s0 / ww, 0.0)
        done = end
    return value, support


def latest(b: Block) -> np.ndarray:
    """Rows that are the latest revision of their date: loaded last, rows of unknown loading only where there is no other."""
    n = len(b.sid)
    if not n:
        return np.empty(0, int)
    order = np.lexsort((np.arange(n), ~b.undated, b.day, b.sid))
    s, d = b.sid[order], b.day[order]
    return order[np.r_[(s[1:] != s[:-1]) | (d[1:] != d[:-1]), True]]


def grid_kernel(with_faulty: bool):
    """The kernel over blocks of series."""

    def run(b: Block) -> Iterator[pa.RecordBatch]:
        if not len(b.sid):
            return
        scale, sound = scales_of(b), np.ones(len(b.sid), bool)
        if not with_faulty:
            sound = ~np.logical_or.reduce(judge(b))
        # the latest sound revision of a date stands for it; a date without one counts only as a reading
        kept, rows = latest(b), np.flatnonzero(sound)
        part = latest(b.rows(rows))
        best = np.full(len(b.sid), -1)
        place = np.cumsum(np.r_[True, (b.sid[1:] != b.sid[:-1]) | (b.day[1:] != b.day[:-1])][: len(b.sid)]) - 1
        best[place[rows[part]]] = rows[part]
        own = best[place[kept]]
        good = own >= 0
        for k in range(len(SCALES)):
            at = np.flatnonzero(scale[b.sid[kept]] == k)
            if len(at):
                yield from grid_of(b, k, kept[at], b.value[np.maximum(own[at], 0)], good[at])

    return run


def grid_of(b: Block, k: int, rows: np.ndarray, value: np.ndarray, good: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Grid rows of the series of one timescale: ``rows`` are its dates, ``value`` the sound values, where ``good``."""
    sid, day = b.sid[rows], b.day[rows]
    period = period_of(k, day)
    first = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]])
    size = np.diff(np.r_[first, len(sid)])
    count = period[first + size - 1] - period[first] + 1
    offset = np.cumsum(count) - count
    which = np.repeat(np.arange(len(first)), count)
    grid = np.repeat(period[first], count) + ranges(count)
    cell = np.repeat(offset, size) + period - np.repeat(period[first], size)
    n, m = np.bincount(cell, minlength=len(grid)), np.bincount(cell[good], minlength=len(grid))
    total = np.bincount(cell[good], value[good], len(grid))
    start = start_of(k, grid)
    middle = (start + start_of(k, grid + 1) - 1) / 2
    est, support = local_linear(sid[good], day[good].astype(float), value[good], sid[first][which], middle, np.full(len(grid), BANDWIDTH * LENGTHS[SCALES[k]]))
    enough = (support >= LEAST_SUPPORT) | (m > 0)
    status = np.where(m > 0, 0, np.where(enough, 1, 2))
    owner = pa.array(sid[first][which])
    for i in range(0, len(grid), 50_000):
        part = slice(i, i + 50_000)
        ok = m[part] > 0
        with np.errstate(all="ignore"):
            mean = total[part] / m[part]
        own = owner.slice(i, 50_000)
        yield pa.RecordBatch.from_arrays(
            [b.key.take(own), b.vintage.take(own), pa.array(start[part].astype("M8[D]").astype(str), pa.string()), pa.array(n[part].astype("int32")), pa.array(m[part].astype("int32")), pa.array(mean, mask=~ok),
             pa.array(est[part], mask=~enough[part] | np.isnan(est[part])), pa.array(support[part]), pa.DictionaryArray.from_arrays(pa.array(status[part].astype("int8")), ["observed", "filled", "missing"]).cast(pa.string())],
            ["key", "vintage", "period_start", "n_readings", "n_sound", "observed_mean", "value", "effective_support", "status"],
        )


def regular_grid(readings: DataFrame, vintages: DataFrame, with_faulty: bool = False) -> DataFrame:
    """One row for each period from a series' first to its last reading with date and value.

    ``n_readings`` counts dates with a reading, faulty ones included, and ``n_sound`` those with a sound one (with
    ``with_faulty`` every reading is sound). A date's value is its latest sound revision (by loaded_at; unknown times
    come first). ``status`` is observed (the period has sound readings), filled (estimated from nearby ones) or missing
    (too little effective support; ``value`` is null). Where timescale is null or unknown, the one nearest to the
    median distance of the distinct dates is taken (the shorter at a tie); a series with no timescale and a single date
    gives no rows. Null keys and vintages form series of their own.
    """
    out = map_series(series_rows(readings, vintages), grid_kernel(with_faulty), SCHEMA)
    return out.withColumn("key", F.expr("nullif(key, '\u0000')")).withColumn("vintage", F.expr("nullif(vintage, -2147483648)"))


def missing_periods(grid: DataFrame) -> DataFrame:
    """The periods without any reading: key, vintage, period_start."""
    return grid.filter("n_readings = 0").select("key", "vintage", "period_start")
