"""Sources mixed to target weights of the total size in tokens.

Method: Pareto order sampling. Each source is first given as many certain whole copies as its target
holds, at most the cap of repeats; the rest is a fixed-size sample with unequal probabilities (in
proportion to size): documents are ranked by their random odds divided by their inclusion odds, and the
lowest ranks are taken as long as they fit into the size wanted. What then is still open is filled by the lowest
ranks among the smaller documents that fit, so that no document left out would fit any more. The cut is found by a
histogram of ranks, so no source is ever sorted or gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.tokens import VOCABULARY, sized
from seriesloom.runtime import cut, is_small

#: Classes of rank; documents of each power of two of size that a round of filling looks at.
RANKS, LOWEST = 16_384, 1000
TARGET = ["mix_id", "source"]


def norm(c):
    """Sources are compared without case and outer blanks."""
    return F.lower(F.btrim(c.cast("string"), F.lit(" \t\r\n")))


def spreader(targets: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Hint for tables with at most a row for each target: broadcast if the targets are few, else none."""
    return F.broadcast if is_small(targets) else lambda df: df


def allocation(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source, src, quota, tokens within reach, copies, rest: a row for each target.

    A null share counts as 0 and a null cap as no use at all; a source without documents has no tokens.
    """
    totals = cut(docs.groupBy("src").agg(F.sum("n_tokens").alias("src_tokens")))
    everything = totals.agg(F.coalesce(F.sum("src_tokens"), F.lit(0)).alias("all_tokens"))
    t = targets.select(
        "mix_id", "source", norm(F.col("source")).alias("src"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("max_repeats").cast("long"), F.lit(0)).alias("max_repeats"), F.coalesce(F.col("total_share").cast("double"), F.lit(0.0)).alias("total_share"),
    )
    out = t.join(totals.filter("src is not null"), "src", "left").withColumn("src_tokens", F.coalesce("src_tokens", F.lit(0)))
    out = out.withColumn("all_tokens", F.lit(everything.first()[0]).cast("long"))
    out = out.withColumn("quota", F.col("target_share") * F.col("total_share") * F.col("all_tokens")).withColumn("reach", F.col("max_repeats") * F.col("src_tokens"))
    copies = F.when(F.col("src_tokens") > 0, F.least(F.floor(F.col("quota") / F.col("src_tokens")), F.col("max_repeats"))).otherwise(F.lit(0))
    out = out.withColumn("copies", F.greatest(copies, F.lit(0)).cast("long"))
    rest = F.when((F.col("copies") < F.col("max_repeats")) & (F.col("src_tokens") > 0), F.greatest(F.col("quota") - F.col("copies") * F.col("src_tokens"), F.lit(0.0))).otherwise(F.lit(0.0))
    return out.withColumn("rest", rest)


def inclusion_scale(docs: DataFrame, plan: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """mix_id, source, scale: inclusion probability is min(1, scale * tokens), so that the expected size is the rest.

    Solved on the histogram of sizes: the largest sizes are certain as long as they would exceed 1.
    """
    sizes = docs.filter("n_tokens > 0").groupBy("src", "n_tokens").agg(F.count("*").cast("double").alias("n"))
    x = sizes.join(few(plan.filter("rest > 0").select(*TARGET, "src", "rest")), "src").withColumn("t", F.col("n_tokens").cast("double"))
    w = Window.partitionBy(*TARGET).orderBy("t")
    below = w.rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*TARGET).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("squares", F.sum(F.col("n") * F.col("t") * F.col("t")).over(below)).withColumn("certain", F.coalesce(F.sum(F.col("n") * F.col("t")).over(above), F.lit(0.0)))
    x = x.withColumn("scale", (F.col("rest") - F.col("certain")) / F.col("squares"))
    # the largest class that is not certain is the first, from above, whose probability is at most 1
    good = x.filter((F.col("scale") > 0) & (F.col("scale") * F.col("t") <= 1 + 1e-12))
    return good.groupBy(*TARGET).agg(F.max_by("scale", "t").alias("scale"))


def ranked(docs: DataFrame, plan: DataFrame, few: Callable[[DataFrame], DataFrame], seed: int) -> DataFrame:
    """Documents of each target with rest to fill: mix_id, source, doc_id, n_tokens, rest, rank, class. Every source's
    documents come once for each target that names it."""
    p = few(cut(plan.join(inclusion_scale(docs, plan, few), TARGET).select(*TARGET, "src", "rest", "scale")))
    x = docs.filter("n_tokens > 0").join(p, "src")
    u = (F.pmod(F.xxhash64(F.lit(seed), *TARGET, "doc_id"), F.lit(2**52)) + 0.5) / float(2**52)
    prob, odds = F.least(F.lit(1.0), F.col("scale") * F.col("n_tokens")), u / (1 - u)
    # q/(1+q) of the Pareto rank q = odds(u) / odds(prob): 0 for certain documents
    rank = F.when(prob >= 1, F.lit(0.0)).otherwise(odds * (1 - prob) / (odds * (1 - prob) + prob))
    x = x.withColumn("rank", rank)
    return x.select(*TARGET, "doc_id", "n_tokens", "rest", "rank", F.least(F.floor(F.col("rank") * RANKS), F.lit(RANKS - 1)).cast("int").alias("class"))


def _fill(df: pd.DataFrame) -> pd.DataFrame:
    """Largest sizes first, in each power of two by rank: what fits into the gap is taken."""
    df = df.sort_values(["octave", "rank", "doc_id"], ascending=[False, True, True])
    gap, taken = float(df.gap.iloc[0]), []
    for n in df.n_tokens:
        taken.append(n <= gap)
        gap -= n * taken[-1]
    return df[taken][["mix_id", "source", "doc_id", "n_tokens"]]


def pareto_sample(docs: DataFrame, plan: DataFrame, few: Callable[[DataFrame], DataFrame], seed: int = 0) -> DataFrame:
    """mix_id, source, doc_id, n_tokens of the documents that fill each target's rest, each once.

    Whole classes of rank below the edge, the class on the edge in exact order up to the first document that does not
    fit, then rounds of filling: the LOWEST ranks of each power of two of size go to one small group for a target, until
    no document left out fits into any gap.
    """
    x = ranked(docs, plan, few, seed)
    w = Window.partitionBy(*TARGET).orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = x.groupBy(*TARGET, "rest", "class").agg(F.sum("n_tokens").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0)))
    edge = few(cut(classes.filter("before <= rest").groupBy(*TARGET).agg(F.max("class").alias("edge"), F.max("before").alias("before"))))
    x = x.join(edge, TARGET)
    inner = Window.partitionBy(*TARGET).orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    on = x.filter("class = edge").withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner)).filter("upto <= rest")
    own = [*TARGET, "doc_id", "n_tokens"]
    taken = cut(x.filter("class < edge").select(*own).unionByName(on.select(*own)))
    while True:
        sums = taken.groupBy(*TARGET).agg(F.sum("n_tokens").alias("sum"))
        gaps = plan.filter("rest > 0").select(*TARGET, "rest").join(sums, TARGET, "left").select(*TARGET, (F.col("rest") - F.coalesce("sum", F.lit(0))).alias("gap"))
        out = x.select(*own, "rank").join(few(gaps), TARGET).filter("n_tokens <= gap").join(taken.select(*TARGET, "doc_id"), [*TARGET, "doc_id"], "left_anti")
        out = out.withColumn("octave", F.floor(F.log2("n_tokens")))
        first = cut(out.withColumn("place", F.row_number().over(Window.partitionBy(*TARGET, "octave").orderBy("rank", "doc_id"))).filter(F.col("place") <= LOWEST))
        taken = taken.unionByName(cut(first.groupBy(*TARGET).applyInPandas(_fill, ", ".join(f"`{c}` {t}" for c, t in taken.dtypes))))
        if first.filter(F.col("place") == LOWEST).isEmpty():  # all that could fit has been looked at
            return taken


def mixture(docs: DataFrame, plan: DataFrame, few: Callable[[DataFrame], DataFrame] | None = None, seed: int = 0) -> DataFrame:
    """mix_id, source, doc_id, n_tokens, copies (at least 1) of each document used.

    ``docs`` has doc_id, src and n_tokens, and ``plan`` is an allocation. Documents without tokens come
    only as whole copies. The same seed gives the same mixture on any partitioning. A document that is twice in the
    table with one id is two documents of that id.
    """
    few = few or spreader(plan)
    whole = docs.join(few(plan.filter("copies > 0").select(*TARGET, "src", "copies")), "src").select(*TARGET, "doc_id", "n_tokens", "copies")
    extra = pareto_sample(docs, plan, few, seed).withColumn("copies", F.lit(1).cast("long"))
    # an id that is there twice stays two rows among whole copies and its extra copy is a third: summed by id and size
    return whole.unionByName(extra).groupBy(*TARGET, "doc_id", "n_tokens").agg(F.sum("copies").alias("copies"))


def sized_by_source(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, src, n_tokens, counted once and kept."""
    return cut(sized(documents.withColumn("_src", norm(F.col("source"))), vocabulary, ("_src",)).withColumnRenamed("_src", "src"))


def mix_report(plan: DataFrame, used: DataFrame) -> DataFrame:
    """Actual tokens and shares of each target row beside what was wanted. A source falls short if its mixture uses
    every permitted copy and still holds fewer tokens than its quota."""
    actual = used.groupBy(F.col("mix_id").alias("_mix"), F.col("source").alias("_src")).agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("actual_tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    out = plan.join(actual, F.col("mix_id").eqNullSafe(F.col("_mix")) & F.col("source").eqNullSafe(F.col("_src")), "left").drop("_mix", "_src")
    out = out.withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0))).withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    total = F.sum("actual_tokens").over(Window.partitionBy("mix_id"))
    share = F.when(total > 0, F.col("actual_tokens") / total).otherwise(F.lit(0.0))
    out = out.withColumn("actual_share", share).withColumn("residual", F.col("actual_tokens") - F.col("quota")).withColumn("falls_short", (F.col("actual_tokens") >= F.col("reach")) & (F.col("residual") < 0))
    return out.select("mix_id", "source", "target_share", "quota", "reach", "actual_tokens", "actual_share", "residual", "n_docs", "most_copies", "falls_short")


def mix_sources(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report. A source that cannot reach its target gives all its permitted copies; any other is
    filled until none of its documents left out would fit."""
    docs, few = sized_by_source(documents, vocabulary), spreader(targets)
    plan = cut(allocation(docs, targets))
    used = cut(mixture(docs, plan, few, seed))
    return used, mix_report(plan, used)
