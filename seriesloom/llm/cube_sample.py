"""A sample whose shares of categories follow given targets and keep a minimum of small ones.

Method: the cube method. Inclusion probabilities are first solved so that every category's sum is what is
wanted of it, also where records have several categories. Flight phases on category indicators run per
partition: undecided records of one combination of categories differ by a kernel vector (1, -1) of the balancing
constraints, so a martingale step along it decides one of the two and keeps every category's sum (all pairs of a
round step at once); what is left goes on along general kernel vectors across combinations. Records that stay
unresolved merge upward; at the top the landing phase drops constraints one by one. The residual imbalance is
reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.runtime import cut, is_small

#: Partitions whose rests merge in one step; most rounds of solving the probabilities.
MERGE, ROUNDS = 64, 500
EPS = 1e-9


def clean(c: Column) -> Column:
    """Without case and outer blanks; empty counts as null."""
    return F.nullif(F.lower(F.btrim(c.cast("string"), F.lit(" \t\r\n"))), F.lit(""))


def concept_of(indicator: Column, source: Column) -> Column:
    """The indicator, or ``<source>-other`` where it is other."""
    return F.when(clean(indicator) == "other", F.concat(clean(source), F.lit("-other"))).otherwise(clean(indicator))


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from hashes (the finaliser of a 64-bit mixer)."""
    x = h.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def step(a: np.ndarray, b: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Martingale step of pairs along (1, -1): one of each pair becomes 0 or 1 and the sum stays."""
    s = a + b
    with np.errstate(all="ignore"):
        low = np.where(u * s < b, 0.0, s)  # sum below 1: one gets all
        high = np.where(u * (2 - s) < 1 - b, 1.0, s - 1)  # sum of 1 or more: one gets 1
    x = np.where(s < 1, low, high)
    x = np.where(np.abs(x) < EPS, 0.0, np.where(np.abs(x - 1) < EPS, 1.0, x))
    y = s - x
    return x, np.where(np.abs(y) < EPS, 0.0, np.where(np.abs(y - 1) < EPS, 1.0, y))


def flight(group: np.ndarray, pi: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Flight phase within groups of equal category combination; at most one record of a group stays undecided."""
    pi = pi.astype(float).copy()
    order = np.lexsort((h, group))
    for r in range(200):
        open_ = order[(pi[order] > EPS) & (pi[order] < 1 - EPS)]
        g = group[open_]
        if len(g) < 2:
            break
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
        left = np.flatnonzero((place % 2 == 0) & np.r_[g[1:] == g[:-1], False])
        if not len(left):
            break
        i, j = open_[left], open_[left + 1]
        pi[i], pi[j] = step(pi[i], pi[j], mixed(h[i], r))
    return pi


def scaled(n: np.ndarray, x: np.ndarray, want: float) -> np.ndarray:
    """x times one factor, at most 1, so that the sum over n records each is ``want`` (or as near as 0 and 1 allow)."""
    if want <= 0:
        return np.zeros(len(x))
    if want >= n.sum() or not (x > 0).any():
        return np.full(len(x), min(1.0, want / n.sum()))
    full = np.zeros(len(x), bool)
    while True:
        base = (n * x)[~full].sum()
        f = (want - n[full].sum()) / base if base > 0 else 1.0
        more = ~full & (f * x >= 1)
        if not more.any():
            return np.where(full, 1.0, np.minimum(f * x, 1.0))
        full |= more


def probabilities(n: np.ndarray, member: np.ndarray, take: np.ndarray, avail: np.ndarray) -> np.ndarray:
    """Inclusion probability of each combination of categories, so that every category's expected number is ``take``.

    Categories that need all their records (take = avail) get them; the rest is scaled category by category until all
    sums hold. Where they can't all hold, the last round's values stand and the report shows the residual.
    """
    if not (member.sum(1) > 1).any():
        return (member * (take / avail)).sum(1)
    whole = member[:, take >= avail].any(1)
    x = np.where(whole, 1.0, (member * (take / avail)).max(1))
    for _ in range(ROUNDS):
        for c in range(member.shape[1]):
            own = member[:, c] & ~whole
            if own.any():
                x[own] = scaled(n[own], x[own], take[c] - n[member[:, c] & whole].sum())
        if np.abs(n * x @ member - take).max() < 1e-10 * max(1.0, take.max()):
            break
    return x


def kernel_vector(a: np.ndarray) -> np.ndarray | None:
    """A vector v with a @ v = 0, or None."""
    if a.shape[1] <= a.shape[0] and np.linalg.matrix_rank(a) == a.shape[1]:
        return None
    return np.linalg.svd(a)[2][-1] if a.shape[0] else np.eye(a.shape[1])[0]


def land(pi: np.ndarray, member: np.ndarray, u: np.random.Generator, landing: bool = True) -> np.ndarray:
    """General flight over units x categories, then the landing: constraints are dropped from the last one on."""
    pi = np.where(pi < EPS, 0.0, np.where(pi > 1 - EPS, 1.0, pi)).astype(float)
    rows = member.shape[1]
    while True:
        open_ = np.flatnonzero((pi > 0) & (pi < 1))
        if not len(open_):
            return pi
        few = open_[: rows + 1]
        v = kernel_vector(member[few][:, :rows].T.astype(float))
        if v is None:
            if not landing:
                return pi
            rows -= 1
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.nanmin(np.where(v > EPS, (1 - pi[few]) / v, np.where(v < -EPS, -pi[few] / v, np.inf)))
            down = np.nanmin(np.where(v > EPS, pi[few] / v, np.where(v < -EPS, (pi[few] - 1) / v, np.inf)))
        new = pi[few] + up * v if u.random() < down / (up + down) else pi[few] - down * v
        pi[few] = np.where(new < EPS, 0.0, np.where(new > 1 - EPS, 1.0, new))


UNIT = "scheme_id int, corpus_id int, key string, concepts array<string>, grp long, h long, pi double"
NAMES = ["scheme_id", "corpus_id", "key", "concepts", "grp", "h", "pi"]


def across(t: pa.Table, pi: np.ndarray, landing: bool) -> np.ndarray:
    """General flight of each scheme and corpus over its undecided records; with ``landing`` all are decided."""
    pi = pi.copy()
    rest = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    concepts = t["concepts"].take(pa.array(rest))
    if not landing and not pc.any(pc.greater(pc.list_value_length(concepts), 1)).as_py():
        return pi  # one record at most of each category: no kernel vector
    concepts = concepts.to_pylist()
    scheme, corpus = t["scheme_id"].to_numpy()[rest], t["corpus_id"].to_numpy()[rest]
    order = np.lexsort((t["h"].to_numpy()[rest], corpus, scheme))
    ends = np.flatnonzero(np.r_[(scheme[order][1:] != scheme[order][:-1]) | (corpus[order][1:] != corpus[order][:-1]), True][: len(rest)]) + 1
    first = 0
    for end in ends:
        part = order[first:end]
        own, rows = rest[part], [concepts[i] for i in part]
        weight = Counter(c for row in rows for c in row)
        names = sorted(weight, key=lambda c: (weight[c], c))  # scarce categories keep their constraint longest
        member = np.array([[c in row for c in names] for row in rows])
        pi[own] = land(pi[own], member, np.random.default_rng(abs(t["h"][int(own[0])].as_py())), landing)
        first = end
    return pi


def _flight_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flight over a partition: batches that decide all but one record a combination, which are carried on; then the
    flight across combinations."""

    def fly(t: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
        pi = flight(t["grp"].to_numpy(), t["pi"].to_numpy(), t["h"].to_numpy())
        if last:
            pi = across(t, pi, False)
        t = t.set_column(6, "pi", pa.array(pi))
        decided = pa.array((pi <= EPS) | (pi >= 1 - EPS))
        return t.filter(decided), t.filter(pc.invert(decided))

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows >= 200_000:
            done, rest = fly(pa.Table.from_batches(held), False)
            yield from done.to_batches()
            held, rows = rest.to_batches(), len(rest)
    if rows:
        for t in fly(pa.Table.from_batches(held), True):
            yield from t.to_batches()


def _land_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Top of the merge for the corpora of a partition: one flight over all of them, then general flight and
    landing of each scheme and corpus that still has undecided records."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held).sort_by([("scheme_id", "ascending"), ("corpus_id", "ascending"), ("grp", "ascending"), ("h", "ascending"), ("key", "ascending")])
    pi = across(t, flight(t["grp"].to_numpy(), t["pi"].to_numpy(), t["h"].to_numpy()), True)
    yield from t.set_column(6, "pi", pa.array(np.round(pi))).to_batches()


def cleaned_targets(targets: DataFrame) -> DataFrame:
    """Targets without those that lack concept or scheme; null numbers count as 0."""
    return targets.filter("scheme_id is not null and concept is not null").select(
        F.col("scheme_id").cast("int").alias("scheme_id"), "concept", clean(F.col("concept")).alias("name"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("min_keep").cast("long"), F.lit(0)).alias("least"), F.coalesce(F.col("sample_fraction").cast("double"), F.lit(0.0)).alias("fraction"),
    )


def members(labels: DataFrame) -> DataFrame:
    """corpus_id, key, concept, once each; rows without indicator, key or corpus count nowhere."""
    return labels.filter("corpus_id is not null and key is not null").select(F.col("corpus_id").cast("int").alias("corpus_id"), "key", clean(F.col("indicator")).alias("i"), concept_of(F.col("indicator"), F.col("source")).alias("concept")).filter("i is not null").select("corpus_id", "key", "concept").distinct()


def demand(labels: DataFrame, member: DataFrame, targets: DataFrame) -> DataFrame:
    """scheme_id, corpus_id, concept, name, target_share, wanted, n_avail, n_take of each scheme, corpus and concept.

    Every corpus answers every scheme: that is the size of the report. Scheme ids are read on the driver; targets join
    by scheme, broadcast if they are few.
    """
    per_key = member.select("corpus_id", "key").distinct().groupBy("corpus_id").agg(F.count("*").alias("n_keys"))
    corpora = labels.filter("corpus_id is not null").select(F.col("corpus_id").cast("int").alias("corpus_id")).distinct().join(per_key, "corpus_id", "left").withColumn("n_keys", F.coalesce("n_keys", F.lit(0)))
    targets = cleaned_targets(targets)
    schemes = sorted(r.scheme_id for r in targets.select("scheme_id").distinct().collect())
    each = F.explode(F.array(*[F.lit(x) for x in schemes]).cast("array<int>"))
    want = corpora.withColumn("scheme_id", each).join(F.broadcast(targets) if is_small(targets) else targets, "scheme_id")
    want = want.withColumn("wanted", F.greatest(F.col("least").cast("double"), F.col("target_share") * F.col("fraction") * F.col("n_keys")))
    avail = member.filter("concept is not null").groupBy("corpus_id", F.col("concept").alias("name")).agg(F.count("*").alias("n_avail"))
    out = want.join(avail, ["corpus_id", "name"], "left").withColumn("n_avail", F.coalesce("n_avail", F.lit(0)))
    return out.withColumn("n_take", F.least("n_avail", F.ceil(F.col("wanted") - EPS)))


def solved(units: DataFrame) -> DataFrame:
    """scheme_id, corpus_id, grp, pi: the probability of each combination of categories of a corpus (counts only: one
    row for each combination)."""
    combos = units.groupBy("scheme_id", "corpus_id", "grp").agg(F.count("*").alias("n"), F.first("wants").alias("wants"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        wants = [[(w["name"], w["n_take"], w["n_avail"]) for w in ws] for ws in df.wants]
        known = {name: (take, avail) for ws in wants for name, take, avail in ws}
        names = sorted(known)
        member = np.array([[c in {w[0] for w in ws} for c in names] for ws in wants])
        take, avail = (np.array([known[c][k] for c in names], float) for k in (0, 1))
        return df[["scheme_id", "corpus_id", "grp"]].assign(pi=probabilities(df.n.to_numpy(float), member, take, avail))

    return combos.groupBy("scheme_id", "corpus_id").applyInPandas(run, "scheme_id int, corpus_id int, grp long, pi double")


def draw(labels: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The sample (scheme_id, corpus_id, key) and the demand it answers.

    A unit is a distinct key of a corpus, with every concept it has; probabilities add up to what is wanted of each
    concept. Concepts with too few keys are taken whole. The same partitioning and seed give the same sample. Without
    labels or targets the sample is empty.
    """
    member = cut(members(labels))
    want = cut(demand(labels, member, targets))
    asked = want.filter("n_take > 0").groupBy("scheme_id", "corpus_id", "name").agg(F.max("n_take").alias("n_take"), F.max("n_avail").alias("n_avail"))
    units = member.withColumnRenamed("concept", "name").join(asked, ["corpus_id", "name"])
    units = units.groupBy("scheme_id", "corpus_id", "key").agg(F.array_sort(F.collect_set(F.struct("name", "n_take", "n_avail"))).alias("wants"))
    units = units.withColumn("concepts", F.transform("wants", lambda w: w["name"])).withColumn("grp", F.xxhash64("scheme_id", "corpus_id", F.array_join("concepts", "\u0001")))
    several = not units.filter(F.size("wants") > 1).isEmpty()
    if several:
        units = cut(units)
        units = units.join(solved(units), ["scheme_id", "corpus_id", "grp"])
    else:
        units = units.withColumn("pi", F.col("wants")[0]["n_take"] / F.col("wants")[0]["n_avail"])
    units = units.withColumn("h", F.xxhash64(F.lit(seed), "scheme_id", "corpus_id", "key")).select(*NAMES)
    level = cut(units.mapInArrow(_flight_partition, UNIT))
    decided = [level.filter(f"pi >= 1 - {EPS}")]
    loose, parts = level.filter(f"pi > {EPS} and pi < 1 - {EPS}"), level.rdd.getNumPartitions()
    while parts > MERGE:  # rests of many partitions meet in steps, so that the top stays small
        parts = -(-parts // MERGE)
        level = cut(loose.repartition(parts, "scheme_id", "corpus_id", F.pmod("h", F.lit(parts))).mapInArrow(_flight_partition, UNIT))
        decided.append(level.filter(f"pi >= 1 - {EPS}"))
        loose = level.filter(f"pi > {EPS} and pi < 1 - {EPS}")
    width = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = loose.repartition(width, "scheme_id", "corpus_id").mapInArrow(_land_partition, UNIT)
    decided.append(top.filter("pi = 1"))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.select("scheme_id", "corpus_id", "key", "concepts"), want


def sample_report(sample: DataFrame, want: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Each concept of a scheme and corpus: wanted, available, selected, residual (selected less wanted in
    whole keys), whether it has too few keys, and the availability last reported."""
    got = sample.select("scheme_id", "corpus_id", F.explode("concepts").alias("name")).groupBy("scheme_id", "corpus_id", "name").agg(F.count("*").alias("n_selected"))
    out = want.join(got, ["scheme_id", "corpus_id", "name"], "left").withColumn("n_selected", F.coalesce("n_selected", F.lit(0)))
    if matched is not None:
        said = matched.select(F.col("corpus_id").cast("int").alias("corpus_id"), clean(F.col("concept")).alias("name"), "n_avail").groupBy("corpus_id", "name").agg(F.max("n_avail").alias("n_reported"))
        out = out.join(said, ["corpus_id", "name"], "left")
    else:
        out = out.withColumn("n_reported", F.lit(None).cast("int"))
    short = (F.col("n_selected") == F.col("n_avail")) & (F.col("n_avail") < F.col("wanted") - EPS)
    return out.withColumn("too_few", short).select("scheme_id", "corpus_id", "concept", "target_share", "wanted", "n_avail", "n_reported", "n_take", "n_selected", (F.col("n_selected") - F.col("n_take")).alias("residual"), "too_few")


def shortfalls(report: DataFrame) -> DataFrame:
    """scheme_id, corpus_id, concept of each concept with fewer keys than wanted."""
    return report.filter("too_few").select("scheme_id", "corpus_id", "concept")
