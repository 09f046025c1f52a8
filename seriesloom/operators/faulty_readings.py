"""Implausible readings: spikes, stuck values and impossible values, judged series by series.

Method: an undecimated wavelet decomposition of each series into details of several scales. The wavelet of
scale w weighs w readings against the two beside them (1/w on each of the w, -1/2 on either neighbour), so a
spike of w readings shows in full at scale w and hardly at others. The details of each scale, over the robust
scale of the series (the median of its non-zero first differences), are thresholded; candidates of a scale then
pass the exact definition for that width. Runs of zero Haar details are runs of equal values and reveal sticking;
bounds by unit detect impossible readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.series_stream import Block, map_series, series_rows

LOG_UNITS = ("index", "level", "fx")
SPIKE_MOVES, SETTLED_MOVES = 12.0, 9.0
#: Scales of the decomposition: widths of spikes, in readings.
SCALES = (1, 2, 3)
STUCK_LEAST, STUCK_TIMES = 8, 3
#: Relative slack of comparisons, far below any difference of decimal readings.
SLACK = 1e-9


def group_medians(group: np.ndarray, x: np.ndarray, count: int) -> np.ndarray:
    """Median of x for each group number; NaN for a group without values."""
    out = np.full(count, np.nan)
    order = np.lexsort((x, group))
    g, x = group[order], x[order]
    n = np.bincount(g, minlength=count)
    first = np.cumsum(n) - n
    own = n > 0
    lo, hi = first[own] + (n[own] - 1) // 2, first[own] + n[own] // 2
    out[own] = (x[lo] + x[hi]) / 2
    return out


def haar_details(sid: np.ndarray, x: np.ndarray) -> np.ndarray:
    """First level of the undecimated Haar transform, unnormalised: x[i] - x[i-1]; NaN at the start of a series."""
    d = np.full(len(x), np.nan)
    if len(x) > 1:
        d[1:] = np.where(sid[1:] == sid[:-1], x[1:] - x[:-1], np.nan)
    return d


def spike_details(sid: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """Details of one scale of the undecimated transform, at the first of ``width`` readings: their mean less that of
    the readings beside them; NaN where the wavelet would leave its series."""
    n = len(x)
    d = np.full(n, np.nan)
    if n < width + 2:
        return d
    total = np.lib.stride_tricks.sliding_window_view(x[1:-1], width).mean(1)  # a running sum would round in long series
    inside = sid[width + 1 :] == sid[: n - width - 1]
    d[1 : n - width] = np.where(inside, total - (x[: n - width - 1] + x[width + 1 :]) / 2, np.nan)
    return d


def distinct_readings(sid: np.ndarray, day: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one date and value are one reading: index of each reading's first row, and each row's reading."""
    n = len(sid)
    if not n:
        return np.empty(0, int), np.empty(0, int)
    order = np.lexsort((np.arange(n), value, day, sid))
    s, d, v = sid[order], day[order], value[order]
    new = np.ones(n, bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    heads = order[new]
    rank = np.empty(len(heads), int)
    by_place = np.argsort(heads, kind="stable")
    rank[by_place] = np.arange(len(heads))
    of_row = np.empty(n, int)
    of_row[order] = rank[np.cumsum(new) - 1]
    return heads[by_place], of_row


def spikes(sid: np.ndarray, x: np.ndarray, count: int, scales: tuple[int, ...] = SCALES) -> np.ndarray:
    """Mask of readings in spikes, from thresholded details of each scale and the exact check of that width."""
    hit = np.zeros(len(x), bool)
    move = np.abs(haar_details(sid, x))
    real = move > 0
    typical = group_medians(sid[real], move[real], count)[sid]
    far, near = SPIKE_MOVES * typical * (1 - SLACK), SETTLED_MOVES * typical * (1 + SLACK)
    for width in scales:
        d = spike_details(sid, x, width)
        with np.errstate(invalid="ignore"):
            at = np.flatnonzero(np.abs(d) >= far * (1 - SLACK))  # all readings lie beyond both, so their mean does
        base, after, sign = x[at - 1], x[at + width], np.sign(d[at])
        good = np.abs(after - base) <= near[at]
        for k in range(width):
            good &= (sign * (x[at + k] - base) >= far[at]) & (sign * (x[at + k] - after) >= far[at])
        for k in range(width):
            hit[at[good] + k] = True
    return hit


def stuck(sid: np.ndarray, value: np.ndarray, count: int) -> np.ndarray:
    """Mask of the longest zero-detail run of each series, without its first reading, where it is long enough."""
    n = len(value)
    if not n:
        return np.zeros(0, bool)
    new = haar_details(sid, value) != 0  # NaN at a start counts as new
    run = np.cumsum(new) - 1
    length = np.bincount(run)
    of = sid[np.flatnonzero(new)]
    order = np.lexsort((length, of))
    last = np.flatnonzero(np.r_[of[order][1:] != of[order][:-1], True])
    longest = length[order][last]
    second = np.where((last > 0) & (np.r_[-1, of[order][:-1]][last] == of[order][last]), np.r_[0, length[order][:-1]][last], 0)
    chosen = np.zeros(len(length), bool)
    chosen[order[last]] = (longest >= STUCK_LEAST) & (longest >= STUCK_TIMES * second)
    return chosen[run] & ~new


def judge(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks over the rows of a block: impossible, spike, stuck."""
    heads, of_row = distinct_readings(b.sid, b.day, b.value)
    sid, value = b.sid[heads], b.value[heads]
    log = np.isin(b.unit, LOG_UNITS)[sid]
    percent = (b.unit == "percent")[sid]
    impossible = (log & (value <= 0)) | (percent & ((value < 0) | (value > 100)))
    kept = np.flatnonzero(~impossible)
    x = value[kept].copy()
    x[log[kept]] = np.log(x[log[kept]])
    spike = np.zeros(len(heads), bool)
    spike[kept] = spikes(sid[kept], x, b.count)
    still = stuck(sid, value, b.count)
    return impossible[of_row], spike[of_row], still[of_row]


def _flag(b: Block) -> Iterator[pa.RecordBatch]:
    impossible, spike, still = judge(b)
    any_ = impossible | spike | still
    yield pa.RecordBatch.from_arrays([pa.array(b.obs[any_]), pa.array(impossible[any_]), pa.array(spike[any_]), pa.array(still[any_])], ["obs_id", "impossible", "spike", "stuck"])


def faulty_readings(readings: DataFrame, vintages: DataFrame) -> DataFrame:
    """The faulty readings with the kind of each fault: obs_id, impossible, spike, stuck.

    Rows without date or finite value are left out. Order is by date, loaded_at (nulls last), obs_id.
    Rows of a series with the same date and value are one reading and are all reported. A series
    without an entry in ``vintages`` or with an unknown unit has no bounds and plain differences.
    A series of one reading, or whose readings never move, has no spikes; empty input gives no rows.
    """
    return map_series(series_rows(readings, vintages), _flag, "obs_id long, impossible boolean, spike boolean, stuck boolean")


def fault_summary(faults: DataFrame, readings: DataFrame) -> DataFrame:
    """Faults by source; a null source is a source of its own."""
    f = readings.select("obs_id", "source").join(faults, "obs_id")
    return f.groupBy("source").agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in ("impossible", "spike", "stuck")), F.count("*").alias("faulty"))
