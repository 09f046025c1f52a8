"""Streams whole series through Arrow: one shuffle, one sort, no join.

The descriptive row of a series (unit, timescale) is unioned in as a header that sorts before the
series' readings, so metadata travels in the same shuffle as the data and neither a broadcast nor a
sort-merge join is needed. Workers see contiguous series and vectorise over many of them at once.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a worker gathers before it runs a kernel (a longer series is taken whole).
BLOCK_ROWS = 200_000


def series_rows(readings: DataFrame, vintages: DataFrame) -> DataFrame:
    """Readings with date and finite value, each series headed by its ``series_vintages`` row.

    Null keys and vintages name a series of their own. Extra columns are ignored.
    """
    r = readings.select(
        F.col("key").cast("string").alias("key"), F.col("vintage").cast("int").alias("vintage"), F.lit(1).cast("tinyint").alias("kind"),
        F.col("date").cast("date").alias("date"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), F.col("obs_id").cast("long").alias("obs_id"),
        F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("label"),
    ).filter("date is not null and value is not null and not isnan(value) and abs(value) < double('Infinity')")
    v = vintages.select(
        F.col("key").cast("string").alias("key"), F.col("vintage").cast("int").alias("vintage"), F.lit(0).cast("tinyint").alias("kind"),
        F.lit(None).cast("date").alias("date"), F.lit(None).cast("timestamp_ntz").alias("loaded_at"), F.lit(None).cast("long").alias("obs_id"),
        F.lit(None).cast("double").alias("value"), F.concat_ws("|", F.coalesce(F.lower(F.trim("unit")), F.lit("")), F.coalesce(F.lower(F.trim("timescale")), F.lit(""))).alias("label"),
    )
    return (
        r.unionByName(v)
        .withColumn("key", F.coalesce("key", F.lit("\u0000")))
        .withColumn("vintage", F.coalesce("vintage", F.lit(-(2**31))))
        .repartition("key", "vintage")
        .sortWithinPartitions("key", "vintage", "kind", "date", F.asc_nulls_last("loaded_at"), "obs_id")
    )


class Block:
    """Contiguous whole series as arrays: ``sid`` numbers the series, ``first`` is where each starts."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        key, vintage = (t[c].chunk(0) if t[c].num_chunks else t[c].combine_chunks() for c in ("key", "vintage"))
        n = len(t)
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.or_(pc.not_equal(key[1:], key[:-1]), pc.not_equal(vintage[1:], vintage[:-1])).to_numpy(zero_copy_only=False)
        sid = np.cumsum(new) - 1
        kind = t["kind"].to_numpy()
        heads = np.flatnonzero(kind == 0)
        starts = np.flatnonzero(new)
        self.count = len(starts)
        labels = np.full(self.count, "|", object)
        for i, text in zip(sid[heads][::-1], t["label"].take(pa.array(heads)).to_pylist()[::-1]):
            labels[i] = text  # the first header of a series wins
        self.unit, self.timescale = (np.array([x.split("|")[k] for x in labels], object) for k in (0, 1))
        self.key, self.vintage = key.take(pa.array(starts)), vintage.take(pa.array(starts))
        own = kind == 1
        self.sid = sid[own]
        self.obs = t["obs_id"].to_numpy()[own].astype("int64")
        self.value = t["value"].to_numpy()[own]
        self.undated = t["loaded_at"].is_null().to_numpy()[own]
        self.day = pc.cast(t["date"], pa.int32()).to_numpy()[own].astype("int64")

    def rows(self, at: np.ndarray) -> Block:
        """The same block with some of its rows; series keep their numbers."""
        out = copy.copy(self)
        for name in ("sid", "obs", "value", "undated", "day"):
            setattr(out, name, getattr(self, name)[at])
        return out


def whole_series(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of whole series from sorted batches; the last, perhaps unfinished series is carried over."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows < BLOCK_ROWS:
            continue
        key, vintage = b["key"], b["vintage"]
        if (held[0]["key"][0].as_py(), held[0]["vintage"][0].as_py()) == (key[len(b) - 1].as_py(), vintage[len(b) - 1].as_py()):
            continue  # one long series so far
        t = pa.Table.from_batches(held)
        same = pc.and_(pc.equal(t["key"], key[len(b) - 1]), pc.equal(t["vintage"], vintage[len(b) - 1]))
        cut = len(t) - int(pc.sum(same).as_py())
        yield Block(t.slice(0, cut))
        held = t.slice(cut).to_batches()
        rows = len(t) - cut
    if rows:
        yield Block(pa.Table.from_batches(held))


def map_series(rows: DataFrame, kernel: Callable[[Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run a kernel over blocks of whole series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_series(batches):
            yield from kernel(block)

    return rows.mapInArrow(run, schema)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
