"""Fixed-capacity containers filled with documents, sized in tokens.

Method: Martello-Toth dominance reduction. A set of documents that provably dominates every other set with
one of its members is fixed as a container for good, which shrinks the instance; this is repeated until nothing
more can be fixed. Then the largest open document gets the largest one that fits beside it (best fit), the two
count as one, and the same criteria are applied to the shrunk instance, until they close the container. Each
partition packs its own documents in blocks; containers that stay loose are opened again and their documents
merge upward into fewer, fuller blocks, so no task ever sees more than a block.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tokens import VOCABULARY, sized
from seriesloom.runtime import cut

#: Items packed together; share of the capacity at which a container is settled below the top level.
BLOCK, SETTLED = 20_000, 0.99
#: Most container specifications that are read on the driver.
MAX_SPECS = 1000

ITEM = "spec_id int, container string, doc_id long, piece int, token_start long, n_tokens long, split boolean, rule string, settled boolean"
NAMES = [c.split()[0] for c in ITEM.split(", ")]


def closing(sizes: list[int], room: int) -> tuple[list[int], bool] | None:
    """What closes a container with so much room left, from the open sizes (ascending): indices, and whether the set
    dominates all others. None if three or more items fit and none fills the room exactly.

    Nothing fits - no item; an item fills the room exactly, or no two items fit - the largest that fits; no three
    fit - the largest single if it is as large as the best pair, and then it dominates; else the best pair, which
    uses the room best but does not dominate.
    """
    k = bisect_right(sizes, room) - 1
    if k < 0:
        return [], True
    if sizes[k] == room or k == 0 or sizes[0] + sizes[1] > room:
        return [k], True
    if k >= 2 and sizes[0] + sizes[1] + sizes[2] <= room:
        return None
    lo, hi, best, pair = 0, k, 0, None
    while lo < hi:
        s = sizes[lo] + sizes[hi]
        if s > room:
            hi -= 1
        else:
            if s > best:
                best, pair = s, [hi, lo]
            lo += 1
    return ([k], True) if sizes[k] >= best else (pair, False)


def reduce_sets(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Fixed sets (indices into sizes) by dominance, and the indices left over.

    ``sizes`` is sorted ascending. Every open item is asked in turn, from the largest, whether a set with it dominates
    all others (``closing``); passes are repeated while they fix something, as each set fixed changes what fits. If
    all that is left fits into one container, it is one.
    """
    fixed: list[list[int]] = []
    open_, ids = list(sizes), list(range(len(sizes)))
    changed = True
    while changed and open_:
        changed = False
        if sum(open_) <= capacity:
            fixed.append(ids)
            return fixed, []
        at = len(open_) - 1
        while at >= 0:
            room = capacity - open_[at]
            if at >= 3 and open_[0] + open_[1] + open_[2] <= room:  # three others fit: only an exact filling dominates
                k = bisect_left(open_, room)
                if k == len(open_) or open_[k] != room or (k == at and (k + 1 == len(open_) or open_[k + 1] != room)):
                    at -= 1
                    continue
            w, j = open_.pop(at), ids.pop(at)
            found = closing(open_, room)
            if found is None or not found[1]:
                open_.insert(at, w)
                ids.insert(at, j)
                at -= 1
                continue
            fixed.append([j, *(ids[k] for k in found[0])])
            for k in found[0]:
                del open_[k], ids[k]
                at -= k < at
            changed = True
            at = min(at - 1, len(open_) - 1) if at > 0 else -1
    return fixed, ids[::-1]


def complete(sizes: list[int], order: list[int], capacity: int) -> list[tuple[list[int], str]]:
    """Containers of the items left (``order`` from the largest) and how each was closed: by dominance, by dominance
    after best fit shrank the instance, or by the best pair."""
    ids = order[::-1]
    open_ = [sizes[i] for i in ids]
    out = []
    while open_:
        items, room, rule = [ids.pop()], capacity - open_.pop(), "dominance"
        while True:
            found = closing(open_, room)
            if found is None:
                k = bisect_right(open_, room) - 1
                room -= open_.pop(k)
                items.append(ids.pop(k))
                rule = "dominance after best fit"
                continue
            for k in found[0]:
                items.append(ids.pop(k))
                del open_[k]
            out.append((items, rule if found[1] else "best pair"))
            break
    return out


def pack(sizes: np.ndarray, capacity: int) -> list[tuple[list[int], str]]:
    """Containers of item indices with the rule that closed each; every size is at most the capacity."""
    order = np.argsort(sizes, kind="stable")
    ascending = sizes[order].tolist()
    fixed, left = reduce_sets(ascending, capacity)
    bins = [(b, "dominance") for b in fixed] + complete(ascending, left, capacity)
    return [([int(order[i]) for i in b], rule) for b, rule in bins]


def _emit(spec: int, capacity: int, least: int, rows: dict[str, np.ndarray], name: str, final: bool) -> pa.RecordBatch:
    """Pack one block of items of a specification. Below the top a container is settled if it is full enough or no
    item at all, of any block, could join it."""
    n = len(rows["n_tokens"])
    container, rules, settled = np.empty(n, object), np.empty(n, object), np.ones(n, bool)
    for b, (items, rule) in enumerate(pack(rows["n_tokens"], capacity)):
        container[items], rules[items] = f"{name}-{b}", rule
        used = int(rows["n_tokens"][items].sum())
        if not final and used < SETTLED * capacity and capacity - used >= least:
            settled[items] = False
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, spec, "int32")), pa.array(container, pa.string()), pa.array(rows["doc_id"]), pa.array(rows["piece"].astype("int32")), pa.array(rows["token_start"]), pa.array(rows["n_tokens"]), pa.array(rows["split"]), pa.array(rules, pa.string()), pa.array(settled)], NAMES
    )


def _pieces(doc_id: np.ndarray, n: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Items of documents: one each, or pieces of full capacity and a rest where a document exceeds it."""
    count = np.maximum(1, -(-n // capacity))
    at = np.repeat(np.arange(len(n)), count)
    ends = np.cumsum(count)
    piece = np.arange(len(at)) - np.repeat(ends - count, count)
    start = piece * capacity
    return {"doc_id": doc_id[at], "piece": piece, "token_start": start, "n_tokens": np.minimum(n[at] - start, capacity), "split": (count > 1)[at]}


def _first_level(specs: dict[int, int], least: dict[int, int], block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            t = pa.Table.from_batches(held)
            doc_id, n = t["doc_id"].to_numpy(), t["n_tokens"].to_numpy()
            for spec, capacity in sorted(specs.items()):
                yield _emit(spec, capacity, least[spec], _pieces(doc_id, n, capacity), f"0-{part}-{k}", False)

        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= block:
                yield from flush()
                k, held, rows = k + 1, [], 0
        if rows:
            yield from flush()

    return run


def _upper_level(specs: dict[int, int], least: dict[int, int], level: int, block: int, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        held: dict[int, list[pa.Table]] = {s: [] for s in specs}

        def flush(spec):
            t = pa.concat_tables(held[spec])
            rows = {c: t[c].to_numpy() for c in ("doc_id", "piece", "token_start", "n_tokens")} | {"split": t["split"].to_numpy().astype(bool)}
            return _emit(spec, specs[spec], least[spec], rows, f"{level}-{part}-{k}", final)

        for b in batches:
            t = pa.Table.from_batches([b])
            for spec in set(b["spec_id"].to_pylist()):
                held[spec].append(t.filter(pc.equal(t["spec_id"], spec)))
                if sum(map(len, held[spec])) >= block:
                    yield flush(spec)
                    k, held[spec] = k + 1, []
        for spec in specs:
            if held[spec]:
                yield flush(spec)

    return run


def pack_documents(documents: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """spec_id, container, doc_id, piece, token_start, n_tokens, split, rule: where each document goes, and how its
    container was closed.

    A document is split only if it has more tokens than the capacity: pieces of full capacity, the rest
    an item like any other. Documents with null or empty text have no tokens and lie in a container all
    the same. Specifications without positive capacity are left out. Container names are unique.

    Levels of merging go on until the loose items fit into one block or a level hardly settles any (less than a
    tenth; then they are packed in blocks as they are).
    """
    rows = specs.filter("spec_id is not null and capacity_tokens > 0").select("spec_id", F.col("capacity_tokens").cast("long")).limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} container specifications")
    known = {int(r[0]): int(r[1]) for r in rows}
    docs = cut(sized(documents, vocabulary).filter("doc_id is not null").selectExpr("cast(doc_id as long) as doc_id", "n_tokens"))
    rest = lambda c: F.when(F.col("n_tokens") <= c, F.col("n_tokens")).otherwise(F.col("n_tokens") % c)
    least = {s: 1 for s in known}
    if known:
        found = docs.agg(*[F.min(F.nullif(rest(c), F.lit(0))).alias(str(s)) for s, c in known.items()]).first().asDict()
        least = {s: found[str(s)] or 1 for s in known}
    level = cut(docs.mapInArrow(_first_level(known, least, block), ITEM))
    done = [level.filter("settled")]
    loose, before, k = level.filter("not settled"), None, 1
    while True:
        n = loose.count()
        final = n <= block or (before is not None and n > before * 0.9)
        parts = max(1, -(-n // block))
        spread = loose.repartition(parts, "spec_id", F.xxhash64("container") % parts) if parts > 1 else loose.coalesce(1)
        level = spread.mapInArrow(_upper_level(known, least, k, block, final), ITEM)
        if final:
            done.append(level)
            break
        level = cut(level)
        done.append(level.filter("settled"))
        loose, before, k = level.filter("not settled"), n, k + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("settled")


def oversize(packed: DataFrame) -> DataFrame:
    """spec_id, doc_id of each document that had to be split."""
    return packed.filter("split and piece = 0").select("spec_id", "doc_id")


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers, tokens, split documents, the least number of containers possible by size, the fill, and the containers
    closed by each rule, of each specification."""
    p = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("t"), F.sum(F.expr("if(split and piece = 0, 1, 0)")).alias("s"), F.max("rule").alias("rule"))
    by = lambda rule: F.sum((F.col("rule") == rule).cast("long"))
    p = p.groupBy("spec_id").agg(
        F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.sum("s").alias("n_split"), F.max("t").alias("fullest"),
        by("dominance").alias("n_dominance"), by("dominance after best fit").alias("n_shrunk"), by("best pair").alias("n_best_pair"),
    )
    out = p.join(specs.select("spec_id", "capacity_tokens"), "spec_id")
    return out.withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))).withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
