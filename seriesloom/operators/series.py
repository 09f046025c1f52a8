"""Relational operators on dated series: clean, transform, resample, align and window.

A series is a set of rows with the columns ``key, vintage, pos, date, x``; every operator is a
composition of built-in expressions, so Catalyst plans it and whole-stage codegen runs it. All windows of
one operator share a partitioning and an order, hence one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ["key", "vintage"]


def over(order: str = "pos", by: list[str] | None = None):
    return Window.partitionBy(*(BY if by is None else by)).orderBy(order)


def whole(by: list[str] | None = None):
    return Window.partitionBy(*(BY if by is None else by))


def finite(readings: DataFrame) -> DataFrame:
    """key, vintage, date, x, obs_id of the readings with date and finite value."""
    r = readings.filter("date is not null and value is not null and not isnan(value) and abs(value) < double('Infinity')")
    return r.select(*BY, F.col("date").cast("date").alias("date"), F.col("value").alias("x"), "obs_id")


def series(readings: DataFrame) -> DataFrame:
    """Readings with date and finite value, numbered from 1 by date and obs_id within each (key, vintage)."""
    return finite(readings).withColumn("pos", F.row_number().over(Window.partitionBy(*BY).orderBy("date", "obs_id"))).drop("obs_id")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows of much work over more tasks than cores: a fixed number of partitions, which adaptive planning, that looks at
    bytes only, doesn't put together."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(by or BY))


# --- projections -------------------------------------------------------------------------------


def parse_date(text: Column) -> Column:
    """ISO dates, ``YYYY-Qn`` as the quarter's last day, ``YYYY`` as 31 December; anything else null."""
    quarter = F.last_day(F.try_to_date(F.concat(F.substring(text, 1, 4), F.lit("-"), (F.substring(text, 7, 1).try_cast("int") * 3).cast("string"), F.lit("-1")), "yyyy-M-d"))
    return F.when(text.rlike(r"^[0-9]{4}-Q[1-4]$"), quarter).when(text.rlike(r"^[0-9]{4}$"), F.try_to_date(F.concat(text, F.lit("-12-31")), "yyyy-MM-dd")).when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def zscore(x: str = "x", by: list[str] | None = None, eps: float = 1e-9) -> Column:
    """Standard score with population deviation over a series."""
    w = whole(by)
    return (F.col(x) - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + eps)


def detrended(x: str = "x", t: str = "pos") -> Column:
    """Residual of the least-squares line over a series."""
    w = whole()
    slope = F.covar_pop(t, x).over(w) / F.var_pop(t).over(w)
    return F.col(x) - F.avg(x).over(w) - F.coalesce(slope, F.lit(0.0)) * (F.col(t) - F.avg(t).over(w))


def robust_z(df: DataFrame, x: str = "x", clip: float = 8.0) -> DataFrame:
    """(x - median) / (1.4826 MAD + 1e-9), clipped: column ``z``."""
    w = whole()
    d = df.withColumn("_m", F.percentile(x, F.lit(0.5)).over(w)).withColumn("_d", F.abs(F.col(x) - F.col("_m")))
    d = d.withColumn("_s", F.percentile("_d", F.lit(0.5)).over(w) * 1.4826 + 1e-9)
    return d.withColumn("z", F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(x) - F.col("_m")) / F.col("_s")))).drop("_m", "_d", "_s")


def log_change(k: int, x: str = "x", scale: float = 100.0) -> Column:
    """scale * (ln x_t - ln x_{t-k}) by row position; null where a value is not above 0."""
    v = F.when(F.col(x) > 0, F.ln(x))
    return scale * (v - F.lag(v, k).over(over()))


def difference(k: int = 1, x: str = "x") -> Column:
    return F.col(x) - F.lag(x, k).over(over())


def fractional_year(d: str = "date") -> Column:
    return F.year(d) + (F.month(d) - 1) / 12


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def first_matching(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Name of the first pattern that matches, or null."""
    out = None
    for name, p in patterns:
        out = F.when(text.rlike(p), name) if out is None else out.when(text.rlike(p), name)
    return out if out is not None else F.lit(None).cast("string")


def strided(df: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` rows of each series at evenly spaced positions, the index truncated."""
    n = F.count("*").over(whole())
    # position p (from 0) is picked iff some k in 0..cap-1 has floor(k (n-1)/(cap-1)) = p
    p, m = F.col("pos") - 1, n - 1
    k = F.ceil(p * (cap - 1) / m)
    return df.filter((F.lit(cap) > 1)).withColumn("_n", n).withColumn("_hit", (n <= cap) | (F.floor(k * m / (cap - 1)) == p)).filter("_hit").drop("_n", "_hit")


def lag_vector(p: int, x: str = "x") -> Column:
    """[x_t, x_{t-1}, ..., x_{t-p+1}], the first value repeated before the start."""
    first = F.first(x).over(over().rowsBetween(Window.unboundedPreceding, 0))
    return F.array(*[F.coalesce(F.lag(x, k).over(over()) if k else F.col(x), first) for k in range(p)])


# --- resampling and alignment ---------------------------------------------------------------------


def monthly(s: DataFrame, how: str = "mean") -> DataFrame:
    """Month-end series: key, vintage, month, x.

    By the median gap of a series: under 27 days its months are aggregated (mean, sum or last); up to
    34 days the last value of a month is kept and empty months are dropped; above, the last value is kept
    and empty months are interpolated linearly in days. A series of one row is returned as it is.
    """
    gaps = s.withColumn("gap", F.date_diff("date", F.lag("date").over(over()))).groupBy(*BY).agg(F.percentile("gap", F.lit(0.5)).alias("gap"), F.count("*").alias("n"))
    by_month = s.groupBy(*BY, F.last_day("date").alias("month")).agg({"mean": F.avg("x"), "sum": F.sum("x"), "last": F.max_by("x", "pos")}[how].alias("agg"), F.max_by("x", "pos").alias("last"), F.max("date").alias("date"))
    m = by_month.join(gaps, BY)
    plain = m.filter("n < 2 or gap <= 34").select(*BY, F.when(F.col("n") < 2, F.col("date")).otherwise(F.col("month")).alias("month"), F.when((F.col("n") >= 2) & (F.col("gap") < 27), F.col("agg")).otherwise(F.col("last")).alias("x"))
    slow = m.filter("n >= 2 and gap > 34")
    # the gap to the next known month is filled from the row that opens it: no spine, no join
    nxt, value = F.lead("month").over(over("month")), F.lead("last").over(over("month"))
    slow = slow.withColumn("nm", nxt).withColumn("nx", value)
    steps = F.when(F.col("nm").isNull(), F.lit(1)).otherwise(F.months_between("nm", "month").cast("int"))
    filled = slow.withColumn("k", F.explode(F.sequence(F.lit(0), steps - 1)))
    at = F.last_day(F.add_months("month", F.col("k")))
    x = F.when(F.col("k") == 0, F.col("last")).otherwise(F.col("last") + (F.col("nx") - F.col("last")) * F.date_diff(at, "month") / F.date_diff("nm", "month"))
    return plain.unionByName(filled.select(*BY, at.alias("month"), x.alias("x")))


def quarterly_mean(s: DataFrame) -> DataFrame:
    return s.groupBy(*BY, F.trunc("date", "quarter").alias("quarter")).agg(F.avg("x").alias("x"))


def align(left: DataFrame, right: DataFrame, unit: str) -> DataFrame:
    """Inner join of two series sets on period: the last duplicate of the left wins, right rows stay as they are.

    Both carry ``pair`` (what belongs together), ``pos``, ``date`` and ``x``.
    """
    a = left.groupBy("pair", F.trunc("date", unit).alias("period")).agg(F.max_by("x", "pos").alias("left_x"))
    b = right.select("pair", F.trunc("date", unit).alias("period"), "date", F.col("x").alias("right_x"))
    return b.join(a, ["pair", "period"])


def trailing_windows(s: DataFrame, grid_months: int, width_months: int, least: int) -> DataFrame:
    """Each grid date (every ``grid_months`` months from the first month start) with the rows of the
    trailing window, both ends inclusive: n, mean and population deviation of windows with enough rows.

    An event joins only the grid dates that can see it: it is exploded to those months, so the range
    join becomes an aggregation on equal keys.
    """
    first = s.groupBy(*BY).agg(F.trunc(F.min("date"), "MM").alias("start"), F.max("date").alias("stop"))
    x = s.join(first, BY)
    # grid index k: grid date = start + k * grid_months; it sees date iff add_months(g, -width) <= date <= g
    lo = F.floor(F.months_between("date", "start") / grid_months).cast("int")
    hi = F.floor((F.months_between("date", "start") + width_months) / grid_months).cast("int") + 1
    x = x.withColumn("k", F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.greatest(hi, F.lit(0)))))
    x = x.withColumn("grid", F.add_months("start", F.col("k") * grid_months)).filter((F.col("grid") <= F.col("stop")) & (F.col("date") <= F.col("grid")) & (F.col("date") >= F.add_months("grid", -width_months)))
    return x.groupBy(*BY, "grid").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).filter(F.col("n") >= least)


def rolling_starts(s: DataFrame, win: int, step: int) -> DataFrame:
    """Count-based windows starting at 0, step, ... while start < n - win: (start, centre) with their rows."""
    n = F.count("*").over(whole())
    p = F.col("pos") - 1
    x = s.withColumn("n", n).filter(F.col("n") > win)
    lo = F.greatest(F.ceil((p - win + 1) / step), F.lit(0)).cast("int")
    hi = F.floor(p / step).cast("int")
    x = x.filter(lo <= hi).withColumn("start", F.explode(F.transform(F.sequence(lo, hi), lambda k: k * step)))
    return x.filter(F.col("start") < F.col("n") - win).withColumn("centre", F.col("start") + win // 2)


def islands(s: DataFrame, flag: Column) -> DataFrame:
    """Runs of equal ``flag`` in order: key, vintage, run, value, first, length."""
    w = over()
    x = s.withColumn("value", flag).withColumn("new", F.coalesce((F.col("value") != F.lag("value").over(w)).cast("int"), F.lit(1)))
    x = x.withColumn("run", F.sum("new").over(w))
    return x.groupBy(*BY, "run").agg(F.first("value").alias("value"), F.min("pos").alias("first"), F.count("*").alias("length"))


def gradient(x: str = "x", w=None) -> Column:
    """Second-order central differences on a uniform grid, one-sided at the ends."""
    w = over() if w is None else w
    lead, lag = F.lead(x).over(w), F.lag(x).over(w)
    return F.coalesce((lead - lag) / 2, lead - F.col(x), F.col(x) - lag)


def folds(n: Column, init: int, step: int, horizon: int, embargo: int) -> Column:
    """Walk-forward folds (fold, train_end, test_start, test_end) of a series of n rows, as an array."""
    count = F.greatest(F.ceil((n - horizon - embargo - init) / step), F.lit(0)).cast("int")
    each = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def fold(k: Column) -> Column:
        end = init + k * step
        start = end + embargo + horizon - 1
        return F.struct(k.alias("fold"), end.alias("train_end"), start.alias("test_start"), F.least(start + step, n).alias("test_end"))

    return F.filter(F.transform(each, fold), lambda f: f["test_start"] < f["test_end"])


# --- corpora ------------------------------------------------------------------------------------------


def best_variant(labels: DataFrame, by: str = "key", size: str = "n_points", tie: str = "idx") -> DataFrame:
    """For each key the row with most points; ties keep the lowest idx. A struct maximum: partial
    aggregation on the map side instead of a window over a hot key. Null sizes come last."""
    best = labels.groupBy(by).agg(F.max_by(F.struct(*[c for c in labels.columns if c != by]), F.struct(F.coalesce(size, F.lit(-1)), -F.col(tie))).alias("b"))
    return best.select(by, "b.*").select(*labels.columns)


def hash_order(idx: Column, seed: int) -> Column:
    """Reproducible order that any engine can compute: an arithmetic hash."""
    return (idx * 48271 + (seed * 69621 + 12345)) % 2147483647


def capped(labels: DataFrame, group: str, cap: Column, seed: int = 0) -> DataFrame:
    """At most ``cap`` members of each group in hash order (Spark keeps only the cap's rows of each group per
    task before the shuffle, by its window group limit, if the cap is a literal)."""
    w = Window.partitionBy(group).orderBy(hash_order(F.col("idx"), seed), "idx")
    return labels.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")
