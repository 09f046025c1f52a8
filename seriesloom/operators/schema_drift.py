"""Schemas that drift between the files of a producer: every change reported, one consistent table.

Method: a column lifespan catalogue. The fields of each file (its footer, here the union over its JSON
entries) are exploded; lag and islands over each producer's files give the spans in which a field lives
under one type; span starts and ends are logged as changes; a start and an end that carry the same
values are a renaming and fill the alias table from which casts are generated.

Bodies are parsed once, in Arrow batches (Spark's variant functions take some ten times the CPU here). Only
names and kinds enter the catalogue, reduced before the shuffle; values are looked at for fields that start or
end where the other also happens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.runtime import cut

PRODUCER = ["artifact", "lab"]
#: Objects whose members are fields of their own.
NESTED = ("estimates",)
#: Most columns of the unified table; beyond it the long form is the table.
MAX_COLUMNS = 2000
#: Kinds of a value as bits of a file's mask.
BITS = {int: 1, float: 2, str: 4, bool: 8, list: 16, dict: 32}
NAMES = {"boolean": 8, "integer": 1, "list": 16, "number": 2, "object": 32, "string": 4}


def _refuse(text: str):
    raise ValueError(text)


def reader():
    """JSON reader that takes no NaN or Infinity."""
    return json.JSONDecoder(parse_constant=_refuse).decode


def members_of(body: str | None, nested: tuple[str, ...] = NESTED, decode=None) -> dict:
    """Fields of one entry: top-level names, and members of nested objects as ``name.member``; none for a null body or
    one that is no JSON object."""
    try:
        found = (decode or reader())(body) if body is not None else None
    except (ValueError, RecursionError):
        return {}
    if not isinstance(found, dict):
        return {}
    for name in nested:
        if isinstance(found.get(name), dict):
            found |= {f"{name}.{k}": v for k, v in found.pop(name).items()}
    return found


def _plain(v):
    """Whole numbers as integers, at any depth."""
    if type(v) is float:
        return int(v) if v.is_integer() and abs(v) < 2**53 else v
    if type(v) is list:
        return [_plain(x) for x in v]
    return {k: _plain(x) for k, x in v.items()} if type(v) is dict else v


def canonical_json(v) -> str:
    """One text for equal values: members in order, no blanks, 1.0 as 1."""
    if type(v) is float:
        return str(int(v)) if v.is_integer() and abs(v) < 2**53 else repr(v)
    if type(v) is int:
        return str(v)
    return json.dumps(_plain(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "replace").decode()


def parsed(entries: DataFrame, keep: tuple[str, ...] = ("run",), texts: bool = False, nested: tuple[str, ...] = NESTED) -> DataFrame:
    """artifact, lab, file_no, the columns to keep, and ``fields``: field, kind bit (0 for a JSON null) and a 64-bit hash
    of the value, or with ``texts`` its canonical JSON. One row for each entry, in a narrow step."""
    base = entries.select(*PRODUCER, F.col("file_no").cast("int").alias("file_no"), *keep, F.col("body").cast("string").alias("_body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = reader()
        for b in batches:
            names, kinds, values, ends = [], [], [], [0]
            for body in b.column(b.num_columns - 1).to_pylist():
                for name, v in members_of(body, nested, decode).items():
                    names.append(name if name.isascii() else name.encode("utf-8", "replace").decode())
                    if v is None:
                        kinds.append(0)
                        values.append(None)
                        continue
                    kinds.append(BITS[type(v)])
                    text = canonical_json(v)
                    values.append(text if texts else int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True))
                ends.append(len(names))
            value = pa.array(values, pa.string() if texts else pa.int64())
            fields = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.array(kinds, "int8")), value], ["field", "kind", "value"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)], [*b.schema.names[:-1], "fields"])

    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes[:-1])
    return base.mapInArrow(run, f"{schema}, fields array<struct<field:string,kind:tinyint,value:{'string' if texts else 'bigint'}>>")


def of_producers(rows: DataFrame) -> DataFrame:
    """Entries without artifact, lab or file number belong to no history."""
    return rows.filter("artifact is not null and lab is not null and file_no is not null")


def file_order(entries: DataFrame) -> DataFrame:
    """The existing files of each producer, numbered in order, with the number of files."""
    files = of_producers(entries.select(*PRODUCER, F.col("file_no").cast("int").alias("file_no"))).distinct()
    w = Window.partitionBy(*PRODUCER)
    return files.withColumn("ord", F.row_number().over(w.orderBy("file_no"))).withColumn("n_files", F.count("*").over(w))


def type_of(mask: Column) -> Column:
    """Name of a mask of kinds: number if whole and fractional ones mix, several joined by ``|``, null for none."""
    seen = F.when(mask.bitwiseAND(2) > 0, mask.bitwiseAND(62)).otherwise(mask)
    return F.nullif(F.concat_ws("|", *[F.when(seen.bitwiseAND(b) > 0, F.lit(n)) for n, b in NAMES.items()]), F.lit(""))


def lifespans(rows: DataFrame, order: DataFrame) -> DataFrame:
    """The catalogue: each field of each file with its type and its neighbours in the field's history.

    The type is that of the non-null values: number if whole and fractional ones mix, the kinds joined
    by ``|`` if others do, null if there are only nulls (then neither neighbour counts as retyped).
    """
    seen = of_producers(rows).select(*PRODUCER, "file_no", F.explode("fields").alias("f")).groupBy(*PRODUCER, "file_no", F.col("f.field").alias("field")).agg(F.bit_or(F.col("f.kind").cast("int")).alias("mask"))
    w = Window.partitionBy(*PRODUCER, "field").orderBy("ord")
    out = seen.withColumn("type", type_of(F.col("mask"))).drop("mask").join(order, [*PRODUCER, "file_no"])
    out = out.withColumn("prev_ord", F.lag("ord").over(w)).withColumn("prev_type", F.lag("type").over(w)).withColumn("next_ord", F.lead("ord").over(w))
    starts = F.coalesce(F.col("prev_ord") < F.col("ord") - 1, F.lit(True))
    return out.withColumn("starts", starts).withColumn("ends", F.coalesce(F.col("next_ord") > F.col("ord") + 1, F.lit(True))).withColumn("retyped", ~starts & (F.col("type") != F.col("prev_type")))


def spans(catalogue: DataFrame) -> DataFrame:
    """Islands of the catalogue: producer, field, type, first and last file of each span under one type."""
    w = Window.partitionBy(*PRODUCER, "field").orderBy("ord")
    numbered = catalogue.withColumn("span", F.sum((F.col("starts") | F.coalesce("retyped", F.lit(False))).cast("int")).over(w))
    return numbered.groupBy(*PRODUCER, "field", "span").agg(F.max("type").alias("type"), F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"), F.count("*").alias("n_files"))


def renamings(catalogue: DataFrame, rows: DataFrame) -> DataFrame:
    """artifact, lab, ord, old_field, field: a field that is gone and a new one with the same value in
    every run where both files hold a non-null one (at least one). Where several fit, the pair with most
    runs, then by names, and each field once. ``rows`` are parsed entries with ``run``."""
    step = [*PRODUCER, "ord"]
    ends = catalogue.filter("ends and ord < n_files").select(*PRODUCER, "file_no", "field", (F.col("ord") + 1).alias("ord"), F.lit(0).alias("new"))
    begins = catalogue.filter("starts and ord > 1").select(*PRODUCER, "file_no", "field", "ord", F.lit(1).alias("new"))
    both = Window.partitionBy(*step)
    open_ = ends.unionByName(begins).withColumn("kinds", F.max("new").over(both) - F.min("new").over(both)).filter("kinds = 1")
    asked = open_.groupBy(*PRODUCER, "file_no").agg(F.collect_list(F.struct("ord", "new", "field")).alias("asked"))
    hits = F.expr("flatten(transform(asked, a -> transform(filter(fields, f -> f.field = a.field and f.value is not null), f -> struct(a.ord, a.new, a.field, f.value))))")
    seen = of_producers(rows).filter("run is not null").join(asked, [*PRODUCER, "file_no"]).select(*PRODUCER, "run", F.explode(hits).alias("h"))
    # entries delivered twice fall together
    seen = cut(seen.groupBy(*PRODUCER, "run", "h.ord", "h.new", "h.field").agg(F.min("h.value").alias("value")))
    gone = seen.filter("new = 0").select(*step, "run", F.col("field").alias("old_field"), F.col("value").alias("old_value"))
    new = seen.filter("new = 1").select(*step, "run", "field", "value")
    equal = gone.join(new.withColumnRenamed("value", "old_value"), [*step, "run", "old_value"]).groupBy(*step, "old_field", "field").agg(F.count("*").alias("n_equal"))
    both = equal.join(gone.select(*step, "old_field", "run"), [*step, "old_field"]).join(new.select(*step, "field", "run"), [*step, "field", "run"])
    same = both.groupBy(*step, "old_field", "field", "n_equal").agg(F.count("*").alias("n_both")).filter("n_equal = n_both")
    best = lambda c, d: F.row_number().over(Window.partitionBy(*step, c).orderBy(F.desc("n_both"), d))
    return same.withColumn("a", best("old_field", "field")).withColumn("b", best("field", "old_field")).filter("a = 1 and b = 1").select(*step, "old_field", "field")


def history(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed entries, file order and catalogue, each computed once."""
    rows, order = cut(parsed(entries)), cut(file_order(entries))
    return rows, order, cut(lifespans(rows, order))


def changes(entries: DataFrame) -> DataFrame:
    """Each change from a file to the next existing one: artifact, lab, file_no, change, field, old_field.

    Runs on any number of producers and files; an empty table has no changes.
    """
    rows, order, catalogue = history(entries)
    at = order.select(*PRODUCER, "ord", "file_no")
    renamed = cut(renamings(catalogue, rows))
    ends = catalogue.filter("ends and ord < n_files").select(*PRODUCER, (F.col("ord") + 1).alias("ord"), "field")
    begins = catalogue.filter("starts and ord > 1").select(*PRODUCER, "ord", "field")
    key = [*PRODUCER, "ord", "field"]
    log = (
        renamed.select(*PRODUCER, "ord", F.lit("renamed").alias("change"), "field", "old_field")
        .unionByName(begins.join(renamed, key, "left_anti").withColumn("change", F.lit("added")).withColumn("old_field", F.col("field")))
        .unionByName(ends.join(renamed.select(*PRODUCER, "ord", F.col("old_field").alias("field")), key, "left_anti").withColumn("change", F.lit("removed")).withColumn("old_field", F.col("field")))
        .unionByName(catalogue.filter("retyped").select(*PRODUCER, "ord", F.lit("retyped").alias("change"), "field", F.col("field").alias("old_field")))
    )
    return log.join(at, [*PRODUCER, "ord"]).select(*PRODUCER, "file_no", "change", "field", "old_field")


def first_names(islands: DataFrame, renamed: DataFrame) -> DataFrame:
    """artifact, lab, field, first_ord, canonical, generation of each island (a field's unbroken presence).

    An island that a renaming starts belongs to the chain of the island it continues; the chain is named after the
    field of its first island. Links are followed by doubling, so a chain of n renamings takes log n joins. A chain
    whose first name was used before by a chain that was renamed away gets the next generation of the name: two
    chains of one name and generation never hold values in the same file.
    """
    key = [*PRODUCER, "field", "first_ord"]
    child = renamed.withColumnRenamed("ord", "first_ord")
    parent = islands.select(*PRODUCER, F.col("field").alias("old_field"), (F.col("last_ord") + 1).alias("first_ord"), F.col("first_ord").alias("up_ord"))
    links = cut(child.join(parent, [*PRODUCER, "old_field", "first_ord"]).select(*key, F.col("old_field").alias("up_field"), "up_ord"))
    away = links.select(*PRODUCER, F.col("up_field").alias("field"), F.col("up_ord").alias("first_ord"), F.lit(1).alias("away"))
    while not links.isEmpty():
        up = links.select(*PRODUCER, F.col("field").alias("up_field"), F.col("first_ord").alias("up_ord"), F.col("up_field").alias("top_field"), F.col("up_ord").alias("top_ord"))
        links = cut(links.join(up, [*PRODUCER, "up_field", "up_ord"], "left").select(*key, F.coalesce("top_field", "up_field").alias("up_field"), F.coalesce("top_ord", "up_ord").alias("up_ord"), F.col("top_field").isNotNull().alias("moved")))
        moved = not links.filter("moved").isEmpty()
        links = links.drop("moved")
        if not moved:
            break
    roots = islands.join(links, key, "left_anti").join(away, key, "left")
    before = Window.partitionBy(*PRODUCER, "field").orderBy("first_ord").rowsBetween(Window.unboundedPreceding, -1)
    roots = roots.select(*key, (F.lit(1) + F.coalesce(F.sum(F.coalesce("away", F.lit(0))).over(before), F.lit(0))).cast("int").alias("generation"))
    below = links.join(roots.select(*PRODUCER, F.col("field").alias("up_field"), F.col("first_ord").alias("up_ord"), "generation"), [*PRODUCER, "up_field", "up_ord"])
    return roots.withColumn("canonical", F.col("field")).unionByName(below.select(*key, "generation", F.col("up_field").alias("canonical")))


def aliases(entries: DataFrame) -> DataFrame:
    """Alias table: producer, file_no, field, canonical (the first name of the field's chain of renamings), generation
    (above 1 where an earlier chain of that name was renamed away), type."""
    rows, _, catalogue = history(entries)
    w = Window.partitionBy(*PRODUCER, "field").orderBy("ord")
    numbered = cut(catalogue.withColumn("first_ord", F.last(F.when(F.col("starts"), F.col("ord")), ignorenulls=True).over(w)))
    islands = numbered.groupBy(*PRODUCER, "field", "first_ord").agg(F.max("ord").alias("last_ord"))
    names = first_names(islands, cut(renamings(catalogue, rows)))
    return numbered.join(names, [*PRODUCER, "field", "first_ord"]).select(*PRODUCER, "file_no", "field", "canonical", "generation", "type")


#: Spark type of a canonical field by the kinds it was seen with.
CASTS = {"integer": "bigint", "number": "double", "string": "string", "boolean": "boolean", "list": "string", "object": "string"}


def named(entries: DataFrame) -> DataFrame:
    """Each entry with its fields under canonical names: entry_id, artifact, lab, file_no, run, values (canonical,
    generation, kind, json). Alias rows are few for a file, so entries meet them as one map."""
    names = aliases(entries).groupBy(*PRODUCER, "file_no").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("canonical", "generation")))).alias("names"))
    rows = parsed(entries, ("entry_id", "run"), True)
    values = F.transform("fields", lambda f: F.struct(F.col("names")[f["field"]]["canonical"].alias("canonical"), F.col("names")[f["field"]]["generation"].alias("generation"), f["kind"].alias("kind"), f["value"].alias("json")))
    return rows.join(names, [*PRODUCER, "file_no"], "left").select("entry_id", *PRODUCER, "file_no", "run", F.when(F.col("names").isNotNull(), values).alias("values"))


def long_table(entries: DataFrame) -> DataFrame:
    """Every non-null value under its canonical name: entry_id, artifact, lab, file_no, run, canonical, generation, type, json."""
    kind = F.expr("case " + " ".join(f"when v.kind = {b} then '{n}'" for n, b in NAMES.items()) + " end")
    return named(entries).select("entry_id", *PRODUCER, "file_no", "run", F.explode("values").alias("v")).filter("v.kind > 0").select("entry_id", *PRODUCER, "file_no", "run", "v.canonical", "v.generation", kind.alias("type"), "v.json")


def column_names(fields: list[tuple[str, int]]) -> list[str]:
    """A column for each canonical field and generation: f_ and the name with ``_`` for dots, from its second generation
    on with ``_g2``; names that would be equal without case get a number."""
    taken, out = set(), []
    for name, generation in fields:
        base = f"f_{name.replace('.', '_')}" + (f"_g{generation}" if generation > 1 else "")
        column, k = base, 1
        while column.lower() in taken:
            k += 1
            column = f"{base}_{k}"
        taken.add(column.lower())
        out.append(column)
    return out


def unified(entries: DataFrame) -> DataFrame:
    """One consistent wide table: entry_id, artifact, lab, file_no, run and a typed column for each canonical field and
    generation, cast by the alias table (bigint, double, boolean, else text; lists and objects as JSON). No value is
    lost: a column with kinds or numbers that its type can't hold is text. An entry without fields, or without
    producer or file number (it belongs to no history), keeps its row with nulls. The list of columns is read on the driver; it holds names only, and more than MAX_COLUMNS of them are
    refused (use ``long_table``)."""
    held = F.map_from_entries(F.transform("values", lambda x: F.struct(F.struct(x["canonical"].alias("canonical"), x["generation"].alias("generation")), F.struct(x["kind"].alias("kind"), x["json"].alias("json")))))
    rows = cut(named(entries).withColumn("held", held).drop("values"))  # the map is made once, not for each column
    v = rows.select(F.explode("held").alias("key", "value")).select("key.*", "value.*")
    fits = F.max(((F.col("kind") == 1) & F.col("json").try_cast("bigint").isNull()).cast("int"))
    kinds = v.groupBy("canonical", "generation").agg(F.bit_or(F.col("kind").cast("int")).alias("mask"), fits.alias("wide")).select("canonical", "generation", type_of(F.col("mask")).alias("type"), "wide").orderBy("canonical", "generation").limit(MAX_COLUMNS + 1).collect()
    if len(kinds) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} canonical fields")
    columns = []
    for r, name in zip(kinds, column_names([(r.canonical, r.generation) for r in kinds])):
        raw = F.try_element_at("held", F.struct(F.lit(r.canonical).alias("canonical"), F.lit(r.generation).alias("generation")))["json"]
        kind = "string" if r.wide or r.type not in CASTS else r.type
        text = F.coalesce(F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"], raw) if kind == "string" else raw
        columns.append(text.try_cast(CASTS[kind]).alias(name))
    return rows.select("entry_id", *PRODUCER, "file_no", "run", *columns)
